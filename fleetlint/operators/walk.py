"""Which files a layer reads: directory pruning, suffixes, test paths, first N, root entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlint.catalog import paths, stacks, testing
from fleetlint.functions.tables import sql_literal
from fleetlint.functions.text import path_order
from fleetlint.plans.skew import top_k

RATIO_SUFFIXES = tuple(sorted({s for group in testing.RATIO_SUFFIXES.values() for s in group}))
# Every test-path pattern ends in one of these.
TEST_SUFFIXES = (".js", ".jsx", ".ts", ".tsx", ".py", ".go", ".rs", ".php", ".rb", ".java")


def strings(values: Sequence[str]) -> Column:
    """A constant array, as one parsed text."""
    return F.expr(f"CAST({sql_literal(tuple(values))} AS array<string>)")


def not_below(names: Sequence[str], dirs: Column | None = None) -> Column:
    """No directory of the path has one of these names."""
    return ~F.arrays_overlap(F.col("dirs") if dirs is None else dirs, strings(names))


def is_rule_source() -> Column:
    return F.col("suffix").isin(*paths.SOURCE_SUFFIXES) & not_below(paths.PATTERN_SKIP_DIRS)


def is_secret_source() -> Column:
    named = F.col("suffix").isin(*paths.SECRET_SUFFIXES) | F.col("name").startswith(".env")
    return named & not_below(paths.CORE_SKIP_DIRS)


def is_code() -> Column:
    return F.col("suffix").isin(*paths.CODE_SUFFIXES) & not_below(paths.CORE_SKIP_DIRS)


def is_ratio_source() -> Column:
    """May count as source in the test ratio (the repository's languages decide)."""
    return F.col("suffix").isin(*RATIO_SUFFIXES) & not_below(paths.CORE_SKIP_DIRS)


def test_languages() -> Column:
    """Languages whose test-path patterns match, for files outside skipped directories."""
    found = F.array_compact(F.array(*[
        F.when(F.col("path").rlike("(?dU)" + "|".join(patterns)), F.lit(language))
        for language, patterns in testing.TEST_PATHS.items()
    ]))
    return F.when(not_below(paths.CORE_SKIP_DIRS), found).otherwise(strings(()))


def is_test_for(test_langs: Column, languages: Column) -> Column:
    """A test path counts for the repository's languages, for all where none has patterns."""
    known = strings(list(testing.TEST_PATHS))
    return F.when(F.arrays_overlap(languages, known), F.arrays_overlap(test_langs, languages)).otherwise(
        F.size(test_langs) > 0)


def first_files(files: DataFrame, n: int = paths.MAX_FILES) -> DataFrame:
    """The first ``n`` rule sources of each repository in walk order, without their text."""
    sources = files.where(is_rule_source()).select("repo", "path")
    return top_k(sources, ["repo"], [path_order(F.col("path"))], n, spread=["path"], rank="file_rank")


def large_repos(files: DataFrame, n: int = paths.MAX_FILES) -> DataFrame:
    """Repositories with more than ``n`` rule sources."""
    counts = files.where(is_rule_source()).groupBy("repo").agg(F.count("*").alias("_sources"))
    return counts.where(F.col("_sources") > n).select("repo")


def file_cutoffs(files: DataFrame, n: int = paths.MAX_FILES) -> DataFrame:
    """``repo, last_path``: the path of the ``n``-th rule source of each repository that has one."""
    return first_files(files, n).where(F.col("file_rank") == n).select("repo", F.col("path").alias("last_path"))


def within_cutoff(path: str = "path") -> Column:
    return F.col("last_path").isNull() | (path_order(F.col(path)) <= path_order(F.col("last_path")))


def root_entries(files: DataFrame, markers: Sequence[str] = stacks.ROOT_MARKERS) -> DataFrame:
    """``repo, entry``: marker files or directories that exist at the repository root."""
    candidates = F.array(
        F.when(F.size("dirs") <= 1, F.col("path")),
        F.get("dirs", F.lit(0)),
        F.concat_ws("/", F.get("dirs", F.lit(0)), F.get("dirs", F.lit(1))),
    )
    found = F.filter(candidates, lambda c: c.isin(*markers))
    return files.select("repo", F.explode(found).alias("entry")).distinct()
