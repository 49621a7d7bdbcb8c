"""Security layer: leaked secrets, sensitive files, risky authentication code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlint.catalog import paths
from fleetlint.functions.text import file_name
from fleetlint.operators.walk import not_below, strings
from fleetlint.plans.skew import join_per_repo

# --- Fixed values -----------------------------------------------------------

PREVIEW_HEAD = 8  # leading characters of a secret that stay visible

# Response headers a site should send. Rows for a report only: a corpus of files holds
# no responses, so nothing is computed from them.
ADVISED_HEADERS = (
    ("x-frame-options", "Pages can be framed by other sites."),
    ("content-security-policy", "Injected scripts are not held back."),
    ("strict-transport-security", "A connection can be downgraded."),
    ("x-content-type-options", "Browsers may guess content types."),
)

# --- End of fixed values ----------------------------------------------------


def mask(match: Column, match_end: Column) -> Column:
    """The first eight and the last four characters of a secret."""
    return F.concat(F.left(match, F.lit(PREVIEW_HEAD)), F.lit("..."), match_end)


def secret_findings(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("kind") == "secret").select(
        "repo", F.lit("exposed_secret").alias("type"), F.col("rule").alias("secret_type"),
        F.col("path").alias("file"), "line", "severity", "message", "fix",
        mask(F.col("match"), F.col("match_end")).alias("match_preview"), "match_key")


def auth_findings(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("kind") == "auth").select(
        "repo", F.lit("auth_risk").alias("type"), "rule", F.col("path").alias("file"), "line",
        "severity", "message", "fix")


def dangerous_files(files: DataFrame) -> DataFrame:
    """Sensitive names that the root .gitignore does not mention.

    One finding per matching ending, for files and for directories, outside skipped
    directories. Few rows survive the name test, and only those meet the .gitignore text.
    """
    endings = strings(paths.SENSITIVE_ENDINGS)
    levels = F.transform(
        F.sequence(F.lit(1), F.size("dirs")),
        lambda n: F.array_join(F.slice("dirs", F.lit(1), n), "/"))
    sensitive_dirs = F.when(
        F.exists("dirs", lambda d: F.exists(endings, lambda e: d.endswith(e))), levels)
    entries = F.concat(F.array("path"), F.coalesce(sensitive_dirs, strings(())))
    # ``sequence`` counts down from 1 to 0 for root files, hence the emptiness test.
    entries = F.when(F.size("dirs") > 0, entries).otherwise(F.array("path"))
    named = files.select("repo", F.explode(entries).alias("file")).select(
        "repo", "file", file_name(F.col("file")).alias("name"))
    found = named.select(
        "repo", "file", "name",
        F.explode(F.filter(endings, lambda e: F.col("name").endswith(e))).alias("ending"))
    found = found.where(not_below(paths.CORE_SKIP_DIRS, F.split("file", "/"))).distinct()
    ignored = files.where(F.col("path") == ".gitignore").select("repo", F.col("content").alias("_ignore"))
    listed = F.coalesce(
        F.col("_ignore").contains(F.col("ending")) | F.col("_ignore").contains(F.col("name")), F.lit(False))
    return (
        join_per_repo(found, ignored, spread=["file"]).where(~listed)
        .select("repo", F.lit("dangerous_file").alias("type"), "file", F.col("ending").alias("rule"),
                F.lit("critical").alias("severity"),
                F.format_string("%s is not ignored and may be committed.", "name").alias("message"),
                F.format_string("Ignore %s and look for it in the history.", "name").alias("fix"))
    )


def security_summary(repos: DataFrame, findings: DataFrame) -> DataFrame:
    counts = findings.groupBy("repo").agg(
        F.count_if(F.col("type") == "exposed_secret").alias("secrets"),
        F.count_if(F.col("type") == "dangerous_file").alias("dangerous_files"),
        F.count_if(F.col("type") == "auth_risk").alias("auth_risks"),
        F.count("*").alias("total_findings"),
        F.count_if(F.col("severity") == "critical").alias("critical_count"))
    return repos.select("repo").distinct().join(counts, "repo", "left").na.fill(0)
