"""Performance layer: large images and missing web optimisations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlint.catalog import paths
from fleetlint.operators.walk import not_below, strings

# --- Fixed values: what is looked for, where, and how severe its absence is ---

NEXT_DIRS = ("src", "app", "pages", "components")
NEXT_FEATURES = {"next/image": "warning", "next/font": "info", "next/dynamic": "info"}
SUSPENSE = "Suspense"

# --- End of fixed values ----------------------------------------------------

_ADVICE = {
    "next/image": ("Images are served as they are.", "Use the Image component of next/image."),
    "next/font": ("Fonts may shift the layout while they load.", "Load fonts with next/font."),
    "next/dynamic": ("Every component loads at once.", "Split heavy ones with next/dynamic."),
    SUSPENSE: ("No Suspense boundary was found.", "Split routes with React.lazy and Suspense."),
}


def large_images(files: DataFrame, threshold: int = paths.LARGE_IMAGE_BYTES) -> DataFrame:
    """Images above the threshold; reads sizes only."""
    kb = F.bround(F.col("size_bytes") / 1024).cast("int")
    return (
        files.where(F.col("suffix").isin(*paths.IMAGE_SUFFIXES) & (F.col("size_bytes") > threshold)
                    & not_below(paths.IMAGE_SKIP_DIRS))
        .select("repo", F.lit("large_image").alias("type"), F.col("path").alias("file"), kb.alias("size_kb"),
                F.lit("warning").alias("severity"))
        .withColumn("message", F.format_string("An image of %d KB.", "size_kb"))
        .withColumn("fix", F.lit("Compress it or use a modern format."))
    )


def missing_optimizations(files: DataFrame, stack: DataFrame) -> DataFrame:
    """Features of Next.js and React that no component file of a repository mentions."""
    in_next = F.col("name").endswith(".tsx") & F.get("dirs", F.lit(0)).isin(*NEXT_DIRS)
    in_react = (F.col("name").endswith(".tsx") | F.col("name").endswith(".jsx")) & not_below(paths.REACT_SKIP_DIRS)
    features = list(NEXT_FEATURES)
    used = (
        files.where(F.col("suffix").isin(".tsx", ".jsx") & (in_next | in_react))
        .groupBy("repo").agg(
            *[F.bool_or(in_next & F.col("content").contains(f)).alias(f) for f in features],
            F.bool_or(in_react & F.col("content").contains(SUSPENSE)).alias(SUSPENSE))
    )
    is_next = F.array_contains("frameworks", "next.js")
    is_react = is_next | F.array_contains("frameworks", "react")
    rows = [
        F.when(is_next & ~F.coalesce(F.col(f"`{f}`"), F.lit(False)), F.struct(
            F.lit(i).alias("ord"), F.lit(f).alias("rule"), F.lit(NEXT_FEATURES[f]).alias("severity")))
        for i, f in enumerate(features)
    ] + [
        F.when(is_react & ~F.coalesce(F.col(SUSPENSE), F.lit(False)), F.struct(
            F.lit(len(features)).alias("ord"), F.lit(SUSPENSE).alias("rule"), F.lit("info").alias("severity")))
    ]
    message = F.create_map(*[x for k, (m, _) in _ADVICE.items() for x in (F.lit(k), F.lit(m))])
    fix = F.create_map(*[x for k, (_, f) in _ADVICE.items() for x in (F.lit(k), F.lit(f))])
    return (
        stack.select("repo", "frameworks").join(used, "repo", "left")
        .select("repo", F.explode(F.array_compact(F.array(*rows))).alias("m"))
        .select("repo", F.lit("missing_optimization").alias("type"), "m.rule", "m.severity")
        .withColumn("message", F.element_at(message, F.col("rule")))
        .withColumn("fix", F.element_at(fix, F.col("rule")))
    )


def performance_summary(repos: DataFrame, findings: DataFrame) -> DataFrame:
    counts = findings.groupBy("repo").agg(
        F.count_if(F.col("type") == "heavy_import").alias("bundle_risks"),
        F.count_if(F.col("type") == "large_image").alias("image_issues"),
        F.count_if(F.col("type") == "missing_optimization").alias("missing_optimizations"),
        F.count("*").alias("total_findings"))
    return repos.select("repo").distinct().join(counts, "repo", "left").na.fill(0)
