import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.session import local_session  # noqa: E402
from fleetlint.sources.corpus import files_from_rows  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """A ``files`` table from ``(repo, path, content)`` or ``(repo, path, content, size)`` rows."""

    def build(rows):
        rows = [tuple(r) + (len((r[2] or "").encode()),) if len(r) == 3 else tuple(r) for r in rows]
        return files_from_rows(spark.createDataFrame(rows, "repo string, path string, content string, size_bytes long"))

    return build
