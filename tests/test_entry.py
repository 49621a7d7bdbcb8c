"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck

SF = "/root/testdata/sf0.001"
FAST = (
    "corpus_scan", "first_n_files", "lang_table", "deps_js", "deps_py", "stack_row", "dep_rollup", "scan_general",
    "scan_javascript", "scan_python", "scan_go", "pack_typescript", "scan_documents", "scan_secrets", "dangerous_files",
    "service_usage", "scan_project", "quality_gate", "test_ratio", "untested_critical", "findings_diff", "copy_paste", "rate_limit_windows",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["repo", "rule", "category", "severity", "file", "line", "match"] and df.count() > 0


@pytest.mark.parametrize("name", FAST)
def test_equals_sql(spark, name):
    ok, _, why = compare(spark, duck(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, why
