"""Dependency audit: heavy, deprecated, metered and duplicate packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlint.catalog import dependencies as catalog
from fleetlint.functions.tables import values_table

_CATALOG_COLUMNS = ("type", "package_key", "severity", "service", "message")


def audit_catalog(spark, with_advice: bool = False) -> DataFrame:
    """The lookup table of the audit: a fixed number of rows, safe to broadcast."""
    heavy = catalog.HEAVY_JS + catalog.HEAVY_PYTHON + (catalog.ADVICE_ONLY_HEAVY if with_advice else ())
    rows = [("heavy_dependency", name, severity, None, advice) for name, severity, advice in heavy]
    rows += [("deprecated", name, "warning", None, advice) for name, advice in catalog.DEPRECATED]
    rows += [("cost_risk", name, severity, service, advice) for name, service, severity, advice in catalog.METERED]
    return values_table(spark, _CATALOG_COLUMNS, rows)


def catalog_findings(merged: DataFrame, with_advice: bool = False) -> DataFrame:
    """One finding for each catalog row whose package a repository declares."""
    table = F.broadcast(audit_catalog(merged.sparkSession, with_advice))
    return merged.join(table, F.lower("name") == F.col("package_key")).select(
        "repo", "type", F.col("name").alias("package"), "severity", "service", "message")


def duplicate_findings(merged: DataFrame) -> DataFrame:
    """Groups of packages for one purpose of which a repository declares more than one."""
    members = values_table(merged.sparkSession, ("group_id", "ord", "member", "advice"), [
        (g, i, member, advice)
        for g, (advice, names) in enumerate(catalog.SAME_PURPOSE) for i, member in enumerate(names)
    ])
    # A group has seven members at most, so the collected set is bounded.
    grouped = (
        merged.select("repo", F.lower("name").alias("member")).join(F.broadcast(members), "member")
        .groupBy("repo", "group_id", "advice")
        .agg(F.array_sort(F.collect_set(F.struct("ord", "member"))).alias("found"))
        .where(F.size("found") > 1)
    )
    packages = F.transform("found", lambda m: m["member"])
    return grouped.select(
        "repo", F.lit("duplicate_functionality").alias("type"), F.lit("info").alias("severity"),
        packages.alias("packages"),
        F.concat("advice", F.lit(": "), F.array_join(packages, ", ")).alias("message"))


def dependency_findings(merged: DataFrame, with_advice: bool = False) -> DataFrame:
    return catalog_findings(merged, with_advice).unionByName(duplicate_findings(merged), allowMissingColumns=True)


def dependency_summary(repos: DataFrame, merged: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts per repository; repositories without dependencies have zeros."""
    totals = merged.groupBy("repo").agg(F.count("*").alias("total_deps"))
    kinds = {
        "heavy_count": "heavy_dependency", "deprecated_count": "deprecated",
        "cost_risk_count": "cost_risk", "duplicate_count": "duplicate_functionality",
    }
    counts = findings.groupBy("repo").agg(
        *[F.count_if(F.col("type") == kind).alias(name) for name, kind in kinds.items()],
        F.count_if(F.col("severity") == "critical").alias("critical_count"))
    return (
        repos.select("repo").distinct().join(totals, "repo", "left").join(counts, "repo", "left")
        .na.fill(0)
    )


def bundle_findings(deps: DataFrame) -> DataFrame:
    """JavaScript packages that make a bundle heavy."""
    sizes = values_table(deps.sparkSession, ("package_key", "size_kb"), catalog.BUNDLE_KB)
    joined = deps.where(F.col("ecosystem") == "js").join(F.broadcast(sizes), F.lower("name") == F.col("package_key"))
    return joined.select(
        "repo", F.lit("heavy_import").alias("type"), F.col("name").alias("package"),
        F.col("size_kb").alias("estimated_size_kb"),
        F.when(F.col("size_kb") >= catalog.BUNDLE_WARNING_KB, "warning").otherwise("info").alias("severity"),
        F.format_string("%s puts about %d KB into the bundle.", "name", "size_kb").alias("message"),
        F.format_string("Load %s on demand or pick something smaller.", "name").alias("fix"))
