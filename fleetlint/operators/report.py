"""Findings of all layers in one table, and everything reported from it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlint.functions.tables import sql_literal
from fleetlint.functions.text import path_order
from fleetlint.plans.skew import top_k

# --- Fixed values: severity ranks, layer order, caps ------------------------

SEVERITY_RANK = {"critical": 0, "warning": 1, "info": 2}
OTHER_RANK = 3
REPORT_LAYERS = ("dependencies", "patterns", "performance", "security", "cost", "tests")
TASK_LAYERS = ("dependencies", "patterns", "security", "cost", "performance", "tests")
TASK_CATEGORY = {
    "dependencies": "dependency", "security": "security", "cost": "cost",
    "performance": "performance", "tests": "testing",
}
REPORT_INFO_CAP = 20
TASK_INFO_CAP = 30
NOTE_CHARS = 80
SHOWN_LANGUAGES = 5
SHOWN_FRAMEWORKS = 3

# --- End of fixed values ----------------------------------------------------

FINDING_SCHEMA = (
    "repo string, layer string, type string, rule string, category string, severity string, message string, "
    "fix string, file string, line int, match string, package string, packages array<string>, service string, "
    "service_id string, billing_model string, risk_level string, detected_via array<string>, secret_type string, "
    "match_preview string, size_kb int, estimated_size_kb int, trap string, match_key string"
)
_FIELDS = [tuple(field.split(" ", 1)) for field in FINDING_SCHEMA.replace(", ", ",").split(",")]


def as_findings(df: DataFrame, layer: str) -> DataFrame:
    """Bring one detector's rows to the common schema; unused fields are null."""
    have = {name: f"`{name}`" for name in df.columns} | {"layer": sql_literal(layer)}
    return df.selectExpr(*[f"CAST({have.get(name, 'NULL')} AS {kind}) AS {name}" for name, kind in _FIELDS])


def union_findings(layers: Mapping[str, list[DataFrame]]) -> DataFrame:
    """All layers; ``layers`` maps a layer name to the tables of its detectors."""
    result = None
    for layer in REPORT_LAYERS:
        for df in layers.get(layer, ()):
            rows = as_findings(df, layer)
            result = rows if result is None else result.unionByName(rows, allowMissingColumns=True)
    return result


def severity_rank(severity: Column | None = None) -> Column:
    severity = F.col("severity") if severity is None else severity
    rank = F.lit(OTHER_RANK)
    for name, value in SEVERITY_RANK.items():
        rank = F.when(severity == name, value).otherwise(rank)
    return rank


def layer_rank(order=REPORT_LAYERS) -> Column:
    return F.array_position(F.array(*[F.lit(name) for name in order]), F.col("layer"))


def stable_order(order=REPORT_LAYERS) -> list[Column]:
    """Order inside a severity: layer, then walk order, line and rule."""
    return [
        layer_rank(order), F.col("type").asc_nulls_first(), path_order(F.col("file")).asc_nulls_first(),
        F.col("line").asc_nulls_first(), F.col("rule").asc_nulls_first(), F.col("category").asc_nulls_first(),
        F.col("package").asc_nulls_first(), F.col("service_id").asc_nulls_first(), F.col("message"),
        F.col("match").asc_nulls_first(), F.col("match_preview").asc_nulls_first(),
    ]


def sorted_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy("repo", severity_rank(), *stable_order())


def _for_all(counts: DataFrame, repos: DataFrame | None) -> DataFrame:
    """``counts`` with zeros for the repositories that have none; without ``repos`` as it is."""
    return counts if repos is None else repos.select("repo").distinct().join(counts, "repo", "left").na.fill(0)


def findings_cube(findings: DataFrame) -> DataFrame:
    """Findings counted for every combination of severity, layer and category, totals included.

    One ``cube`` aggregation (partial aggregation, so a repository with a third of all
    findings is summed map-side); ``level`` is ``grouping_id``: bit 2 set where severity is
    summed over, bit 1 for layer, bit 0 for category. A null category is a group of its own.
    """
    return findings.cube("severity", "layer", "category").agg(
        F.grouping_id().alias("level"), F.count("*").alias("findings"),
        F.countDistinct("repo").alias("repos"))


def severity_counts(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Findings per severity; with ``repos`` also a row for each repository without any."""
    return _for_all(findings.groupBy("repo").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK],
        F.count("*").alias("total")), repos)


def _capped(findings: DataFrame, cap: int, order) -> DataFrame:
    """All rows but at most ``cap`` infos per repository; how many are left out is in ``more``.

    The cap is the report's own feature. Infos are cut per salt before they are ranked,
    and counted by a partial aggregation, so no task holds all infos of a repository.
    """
    infos = findings.where(F.col("severity") == "info")
    shown = top_k(infos, ["repo"], stable_order(order), cap, spread=["layer", "file", "line", "rule", "message"])
    left_out = infos.groupBy("repo").agg(
        F.greatest(F.count("*") - cap, F.lit(0)).alias("more"))
    first = shown.join(left_out, "repo", "left").drop("rank")
    return findings.where(F.col("severity") != "info").withColumn("more", F.lit(0).cast("bigint")).unionByName(first)


def report_rows(findings: DataFrame, cap: int = REPORT_INFO_CAP) -> DataFrame:
    """The rows of the report table."""
    return _capped(findings, cap, REPORT_LAYERS)


def task_findings(findings: DataFrame, test_counts: DataFrame) -> DataFrame:
    """Findings as tasks: a category per layer, and one task per missing kind of test."""
    category = F.col("category")
    for layer, name in TASK_CATEGORY.items():
        category = F.when(F.col("layer") == layer, name).otherwise(category)
    kinds = test_counts.select("repo", F.explode("missing_test_types").alias("kind"))
    missing = as_findings(kinds.select(
        "repo", F.lit("missing_test_type").alias("type"), F.lit("testing").alias("category"),
        F.lit("warning").alias("severity"), F.format_string("There are no %s tests.", "kind").alias("message"),
        F.format_string("Write %s tests.", "kind").alias("fix")), "tests")
    return findings.withColumn("category", category).unionByName(missing)


def task_queue(tasks: DataFrame, cap: int = TASK_INFO_CAP) -> DataFrame:
    """Tasks with their severity rank, infos capped."""
    return _capped(tasks, cap, TASK_LAYERS).withColumn("severity_rank", severity_rank())


def detected_services(services: DataFrame) -> DataFrame:
    return services.select(
        "repo", "service", "billing_model", F.upper("risk_level").alias("risk"),
        F.left("message", F.lit(NOTE_CHARS)).alias("notes"))


def summaries(stack: DataFrame, dependencies: DataFrame, security: DataFrame, cost: DataFrame,
              performance: DataFrame, tests: DataFrame, patterns: DataFrame) -> DataFrame:
    """One wide row per repository from the roll-ups of all layers.

    Every input is one row per repository and already grouped by it, so nothing large
    is shuffled. Columns that several layers share carry the layer as a prefix.
    """

    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select("repo", *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != "repo"])

    hits = patterns.groupBy("repo").agg(
        F.count("*").alias("total_findings"),
        F.count_if(F.col("severity") == "critical").alias("critical_count"))
    wide = stack
    for df, prefix in ((dependencies, "dep"), (security, "sec"), (cost, "cost"),
                       (performance, "perf"), (tests, "test"), (hits, "pat")):
        wide = wide.join(named(df, prefix), "repo", "left")
    return wide.na.fill(0, ["pat_total_findings", "pat_critical_count"])


def stack_lines(stack: DataFrame) -> DataFrame:
    """The stack block of the report as text columns."""
    none = F.lit("None detected")

    def listed(column: Column) -> Column:
        return F.when(F.size(column) > 0, F.array_join(column, ", ")).otherwise(none)

    shown = F.transform(F.slice("languages", 1, SHOWN_LANGUAGES), lambda x: F.format_string(
        "%s (%d files)", x["name"], x["file_count"]))
    return stack.select(
        "repo", "primary_language", F.array_join(shown, ", ").alias("languages"),
        listed(F.col("frameworks")).alias("frameworks"), "package_manager",
        listed(F.col("build_tools")).alias("build_tools"), listed(F.col("runtimes")).alias("runtimes"), "total_deps")


def plan_header(wide: DataFrame) -> DataFrame:
    return wide.select(
        "repo", "primary_language",
        F.when(F.size("frameworks") > 0, F.array_join("frameworks", ", ")).otherwise("None").alias("frameworks"),
        F.col("sec_critical_count").alias("security_critical"),
        F.upper("cost_total_monthly_risk").alias("cost_risk"),
        F.upper("test_coverage_estimate").alias("test_coverage"))


def scan_summary(wide: DataFrame) -> DataFrame:
    """Seven rows per repository: category, status, findings."""
    top = F.slice("frameworks", 1, SHOWN_FRAMEWORKS)
    rows = [
        ("Stack", F.concat_ws(" / ", "primary_language", F.when(F.size("frameworks") > 0, F.array_join(top, ", "))
                              .otherwise("N/A")), F.lit("")),
        ("Dependencies", F.format_string("%d total", "dep_total_deps"),
         F.format_string("%d heavy, %d deprecated", "dep_heavy_count", "dep_deprecated_count")),
        ("Security", F.when(F.col("sec_critical_count") > 0, "CRITICAL").otherwise("OK"),
         F.format_string("%d findings (%d critical)", "sec_total_findings", "sec_critical_count")),
        ("Cost Risk", F.upper("cost_total_monthly_risk"),
         F.format_string("%d services, %d traps", "cost_service_count", "cost_scaling_traps")),
        ("Performance", F.format_string("%d issues", "perf_total_findings"), F.lit("")),
        ("Tests", F.upper("test_coverage_estimate"),
         F.format_string("%d/%d ratio", "test_test_file_count", "test_source_file_count")),
        ("Patterns", F.format_string("%d findings", "pat_total_findings"), F.lit("")),
    ]
    table = F.array(*[
        F.struct(F.lit(i + 1).alias("position"), F.lit(category).alias("category"), status.alias("status"),
                 found.alias("findings"))
        for i, (category, status, found) in enumerate(rows)
    ])
    return wide.select("repo", F.inline(table))


def critical_gate(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Critical findings of the security, dependency and pattern layers, and whether they block.

    With ``repos`` a repository that was scanned and is clean has a row too.
    """
    counted = F.col("layer").isin("security", "dependencies", "patterns") & (F.col("severity") == "critical")
    counts = findings.groupBy("repo").agg(F.count_if(counted).alias("critical_count"))
    return _for_all(counts, repos).withColumn(
        "blocked", F.col("critical_count") > 0)


_DIFF_KEY = ("repo", "rule", "file", "match")


def findings_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``new``, ``fixed`` and ``kept`` findings by repository, rule, file and match.

    Where both sides have a ``match_key``, the hash of the whole match, it belongs to the key and to the
    result: matches that only agree in what is shown of them are different findings.
    Both sides are counted per key in one aggregation, with partial sums before its
    shuffle: a key that occurs very often costs one row per input partition.
    """
    whole = ["match_key"] if "match_key" in before.columns and "match_key" in after.columns else []
    columns = [*_DIFF_KEY, *whole, "severity"]
    both = (
        before.select(*columns, F.lit(1).alias("b"), F.lit(0).alias("a"))
        .unionByName(after.select(*columns, F.lit(0).alias("b"), F.lit(1).alias("a")))
    )
    counted = both.groupBy(*columns).agg(F.sum("b").alias("before_count"), F.sum("a").alias("after_count"))
    status = (
        F.when(F.col("before_count") == 0, "new").when(F.col("after_count") == 0, "fixed").otherwise("kept")
    )
    return counted.withColumn("status", status)


def quality_gate(diff: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """A repository passes when no critical finding is new or occurs more often than before.

    With ``repos`` a repository without findings in both states has a row and passes.
    """
    more = F.greatest(F.col("after_count") - F.col("before_count"), F.lit(0))
    worse = F.sum(F.when(F.col("severity") == "critical", more).otherwise(0))
    return _for_all(diff.groupBy("repo").agg(worse.alias("new_critical")), repos).withColumn(
        "passed", F.col("new_critical") == 0)


def area_findings(findings: DataFrame, keyword: str) -> DataFrame:
    """Findings in files whose path mentions a feature."""
    return findings.where(F.lower("file").contains(keyword.lower()))
