"""Stack detection: one row per repository, from paths and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlint.catalog import paths, stacks
from fleetlint.functions.tables import sql_literal
from fleetlint.operators.walk import not_below, root_entries, strings


def suffix_counts(files: DataFrame) -> DataFrame:
    """Files per repository and lower-cased suffix."""
    return (
        files.where(not_below(paths.STACK_SKIP_DIRS))
        .groupBy("repo", "suffix").agg(F.count("*").alias("file_count"))
    )


def _language_of(suffix: Column) -> Column:
    names = F.map_from_arrays(strings(list(stacks.SUFFIX_LANGUAGE)), strings(list(stacks.SUFFIX_LANGUAGE.values())))
    return F.element_at(names, suffix)


def _has_ending(language: str) -> Column:
    found = F.lit(False)
    for ending in stacks.LANGUAGE_MARKER_ENDINGS[language]:
        found = found | F.col("name").endswith(ending)
    return found


def root_profile(files: DataFrame) -> DataFrame:
    """``repo, entries``: the root markers of each repository, a set of bounded size."""
    return root_entries(files).groupBy("repo").agg(F.collect_set("entry").alias("entries"))


def languages(files: DataFrame) -> DataFrame:
    """``repo, languages, primary_language``; languages by file count, then catalog order.

    Every repository has a row. The counts are fixed-width sums that Spark adds up
    before the shuffle, so the size of a repository does not matter.
    """
    counted = not_below(paths.STACK_SKIP_DIRS)
    per_file = files.select(
        "repo",
        F.when(counted, _language_of(F.col("suffix"))).alias("language"),
        *[(counted & _has_ending(name)).alias(f"_{name}") for name in stacks.LANGUAGE_MARKER_ENDINGS],
    )
    counts = per_file.groupBy("repo").agg(
        *[F.count_if(F.col("language") == name).alias(name) for name in stacks.LANGUAGES],
        *[F.bool_or(f"_{name}").alias(f"_{name}") for name in stacks.LANGUAGE_MARKER_ENDINGS],
    )
    entries = F.coalesce(F.col("entries"), strings(()))

    def row(order: int, name: str) -> Column:
        has_marker = F.arrays_overlap(entries, strings(stacks.LANGUAGE_MARKERS.get(name, ())))
        if name in stacks.LANGUAGE_MARKER_ENDINGS:
            has_marker = has_marker | F.col(f"_{name}")
        return F.struct(
            (-F.col(name)).alias("_rank"), F.lit(order).alias("_order"), F.lit(name).alias("name"),
            F.col(name).alias("file_count"), has_marker.alias("has_marker"))

    table = F.array(*[row(i, name) for i, name in enumerate(stacks.LANGUAGES)])
    ordered = F.array_sort(F.filter(table, lambda r: r["file_count"] > 0))
    shown = F.transform(ordered, lambda r: F.struct(
        r["name"].alias("name"), r["file_count"].alias("file_count"), r["has_marker"].alias("has_marker"),
        F.when(r["has_marker"] | (r["file_count"] > stacks.CONFIDENT_FILE_COUNT), "high").otherwise("low")
        .alias("confidence")))
    return (
        counts.join(root_profile(files), "repo", "left")
        .select("repo", shown.alias("languages"))
        .withColumn("primary_language", F.coalesce(F.get("languages", F.lit(0))["name"], F.lit("unknown")))
    )


def language_names(files: DataFrame) -> DataFrame:
    """``repo, language_names``: what the other layers need to know of the stack."""
    counted = files.where(not_below(paths.STACK_SKIP_DIRS))
    return (
        counted.select("repo", _language_of(F.col("suffix")).alias("language"))
        .where(F.col("language").isNotNull())
        .groupBy("repo").agg(F.array_sort(F.collect_set("language")).alias("language_names"))
    )


def language_table(languages_df: DataFrame) -> DataFrame:
    """Long form: one row per repository and language, with its position."""
    return languages_df.select("repo", F.posexplode("languages").alias("pos", "l")).select(
        "repo", (F.col("pos") + 1).alias("position"), "l.name", "l.file_count", "l.has_marker", "l.confidence")


def _dep_markers() -> Column:
    return F.expr("array(" + ", ".join(
        f"named_struct('ord', {i}, 'framework', {sql_literal(name)}, 'part', {sql_literal(part)})"
        for i, (name, (parts, _)) in enumerate(stacks.FRAMEWORKS.items()) for part in parts) + ")")


def _tools(table: dict, entries: Column) -> Column:
    """Catalog names, in catalog order, with a marker among the root entries."""
    return F.array_compact(F.array(*[
        F.when(F.arrays_overlap(entries, strings(markers)), F.lit(name)) for name, markers in table.items()
    ]))


def frameworks(deps: DataFrame, profile: DataFrame) -> DataFrame:
    """``repo, frameworks``: a marker is part of a dependency name, or a config file exists."""
    by_dep = (
        deps.select("repo", "name").distinct()
        .select("repo", F.explode(F.filter(_dep_markers(), lambda m: F.col("name").contains(m["part"]))).alias("m"))
        .select("repo", "m.ord", "m.framework")
    )
    config_rows = F.array_compact(F.array(*[
        F.when(F.arrays_overlap(F.col("entries"), strings(configs)),
               F.struct(F.lit(i).alias("ord"), F.lit(name).alias("framework")))
        for i, (name, (_, configs)) in enumerate(stacks.FRAMEWORKS.items()) if configs
    ]))
    by_config = profile.select("repo", F.explode(config_rows).alias("m")).select("repo", "m.ord", "m.framework")
    rows = by_dep.unionByName(by_config)
    ordered = F.array_sort(F.collect_set(F.struct("ord", "framework")))
    return rows.groupBy("repo").agg(F.transform(ordered, lambda r: r["framework"]).alias("frameworks"))


def toolchain(profile: DataFrame) -> DataFrame:
    """Package manager, build tools, runtimes and test runners from the root entries."""
    entries = F.col("entries")
    manager = F.get(_tools(stacks.PACKAGE_MANAGERS, entries), F.lit(0))
    return profile.select(
        "repo",
        F.coalesce(manager, F.lit("unknown")).alias("package_manager"),
        _tools(stacks.BUILD_TOOLS, entries).alias("build_tools"),
        _tools(stacks.RUNTIMES, entries).alias("runtimes"),
        _tools(stacks.TEST_RUNNERS, entries).alias("test_runners"),
    )


def stack(files: DataFrame, deps: DataFrame, languages_df: DataFrame | None = None) -> DataFrame:
    """The stack row of every repository; ``languages_df`` may be a stored :func:`languages`.

    All inputs are grouped by ``repo`` already, so the joins add no shuffle.
    """
    profile = root_profile(files)
    none = strings(())
    return (
        (languages(files) if languages_df is None else languages_df)
        .join(frameworks(deps, profile), "repo", "left")
        .join(toolchain(profile), "repo", "left")
        .join(deps.groupBy("repo").agg(F.count_distinct("name").alias("total_deps")), "repo", "left")
        .select(
            "repo", "languages", "primary_language",
            F.coalesce("frameworks", none).alias("frameworks"),
            F.coalesce("package_manager", F.lit("unknown")).alias("package_manager"),
            F.coalesce("build_tools", none).alias("build_tools"),
            F.coalesce("runtimes", none).alias("runtimes"),
            F.coalesce("test_runners", none).alias("test_runners"),
            F.coalesce("total_deps", F.lit(0)).alias("total_deps"),
        )
    )
