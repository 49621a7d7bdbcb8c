"""Checks that the written advice describes: long files, copied code, look-alike package names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlint.catalog.dependencies import POPULAR_NAMES
from fleetlint.functions.regex import bind
from fleetlint.functions.text import newline_count

MAX_LINES = 500  # fixed value: a file of this many lines or more is oversized


def line_count(content: Column) -> Column:
    """Lines of a text; a newline at its end opens no further line."""
    ends = content.endswith("\n")
    return F.when(content == "", 0).otherwise(newline_count(content) + F.when(ends, 0).otherwise(1))


def oversized_files(files: DataFrame, min_lines: int = MAX_LINES) -> DataFrame:
    return (
        files.where(F.col("content").isNotNull())
        .select("repo", F.col("path").alias("file"), line_count(F.col("content")).alias("lines"))
        .where(F.col("lines") >= min_lines)
    )


def normal_lines(content: Column) -> Column:
    """Lines without outer and repeated spaces, lower case, blank ones left out."""
    cleaned = F.transform(F.split(content, "\n", -1), lambda line: F.lower(
        F.regexp_replace(F.trim(F.regexp_replace(line, r"[ \t]+", " ")), "^ | $", "")))
    return F.filter(cleaned, lambda line: line != "")


def copied_blocks(files: DataFrame, k: int = 6) -> DataFrame:
    """Blocks of ``k`` normalised lines that occur in more than one file.

    Per block: its digest, how many files hold it, how often it occurs. Occurrences are
    counted per (block, file) first, so a block that a third of all files share reaches
    the last step as partial counts. No pairs of files are formed.
    """

    def digests(lines: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.size(lines) - k),
            lambda i: F.unhex(F.md5(F.array_join(F.slice(lines, i + 1, F.lit(k)), "\n"))))
        return F.when(F.size(lines) >= k, blocks)

    blocks = files.where(F.col("content").isNotNull()).select(
        "repo", "path", F.explode(bind(normal_lines(F.col("content")), digests)).alias("digest"))
    per_file = blocks.groupBy("digest", "repo", "path").agg(F.count("*").alias("n"))
    return (
        per_file.groupBy("digest").agg(
            F.count("*").alias("files"), F.sum("n").alias("occurrences"),
            F.min(F.struct("repo", "path")).alias("first"))
        .where(F.col("files") > 1)
        .select(F.lower(F.hex("digest")).alias("digest"), "files", "occurrences",
                F.col("first.repo").alias("first_repo"), F.col("first.path").alias("first_path"))
    )


def typosquats(deps: DataFrame, popular=POPULAR_NAMES, max_distance: int = 2) -> DataFrame:
    """Dependencies one or two edits away from a popular name.

    Each distinct name is compared once with the fixed list, inside its row; only the
    few suspects meet the dependency table again.
    """
    known = F.array(*[F.lit(name) for name in popular])
    near = F.filter(
        F.transform(known, lambda p: F.struct(
            F.levenshtein(F.lower("name"), p, max_distance).alias("distance"), p.alias("imitates"))),
        lambda x: x["distance"] > 0)
    suspects = (
        deps.select("name").distinct()
        .where(~F.lower("name").isin(*popular))
        .select("name", F.explode(near).alias("x")).select("name", "x.imitates", "x.distance")
    )
    return deps.select("repo", "ecosystem", "name").join(suspects, "name").select(
        "repo", "ecosystem", "name", "imitates", "distance")
