"""Cost layer: metered services and scaling traps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlint.catalog import paths
from fleetlint.catalog.services import SERVICES
from fleetlint.functions.tables import values_table
from fleetlint.functions.text import path_order
from fleetlint.plans.skew import top_k

MAX_EVIDENCE = 5  # fixed value: evidence shown for a service


def env_evidence(files: DataFrame) -> DataFrame:
    """``repo, service_id, ord, evidence`` for service keys in the root environment files."""
    keys = F.array(*[
        F.struct(F.lit(s.service_id).alias("service_id"), F.lit(i).alias("ord"), F.lit(key).alias("key"))
        for s in SERVICES for i, key in enumerate(s.env_keys)
    ])
    return (
        files.where(F.col("path").isin(*paths.ENV_FILES))
        .select("repo", F.explode(F.filter(keys, lambda k: F.col("content").contains(k["key"]))).alias("k"))
        .select("repo", "k.service_id", "k.ord", F.concat(F.lit("env:"), "k.key").alias("evidence"))
        .distinct()
    )


def code_evidence(hits: DataFrame) -> DataFrame:
    """One row per file and service, from hits of the service rules."""
    return hits.where(F.col("kind") == "service").select(
        "repo", F.col("rule").alias("service_id"), "path", F.concat(F.lit("code:"), "path").alias("evidence"))


def evidence_counts(env: DataFrame, code: DataFrame, shown: int = MAX_EVIDENCE) -> DataFrame:
    """``repo, service_id, n_evidence, shown, more_evidence``: all evidence of a service, and how much the list leaves out.

    Counted by a partial aggregation, so every piece of evidence is counted, also beyond
    what :func:`service_findings` shows.
    """
    both = env.select("repo", "service_id").unionByName(code.select("repo", "service_id"))
    return both.groupBy("repo", "service_id").agg(F.count("*").alias("n_evidence")).select(
        "repo", "service_id", "n_evidence", F.least("n_evidence", F.lit(shown)).alias("shown"),
        F.greatest(F.col("n_evidence") - shown, F.lit(0)).alias("more_evidence"))


def service_findings(env: DataFrame, code: DataFrame) -> DataFrame:
    """One finding per repository and service with its first evidence.

    Keys come first in catalog order, then files in walk order. Only the first few of
    each group reach the final aggregation, so a service that every file of a huge
    repository mentions costs no more than any other.
    """
    both = env.select("repo", "service_id", "ord", F.lit("").alias("path"), "evidence").unionByName(
        code.select("repo", "service_id", F.lit(len(SERVICES)).alias("ord"), "path", "evidence"))
    first = top_k(both, ["repo", "service_id"], [F.col("ord"), path_order(F.col("path"))], MAX_EVIDENCE,
                  spread=["evidence"])
    profiles = values_table(
        env.sparkSession,
        ("service_id", "service_ord", "service", "billing_model", "risk_level", "severity", "message", "fix"),
        [(s.service_id, i, s.name, s.billing_model, s.risk_level, s.severity, s.message, s.fix)
         for i, s in enumerate(SERVICES)])
    evidence = F.transform(F.array_sort(F.collect_list(F.struct("rank", "evidence"))), lambda r: r["evidence"])
    return (
        first.groupBy("repo", "service_id").agg(evidence.alias("detected_via"))
        .join(F.broadcast(profiles), "service_id")
        .select("repo", F.lit("cost_service").alias("type"), "service_id", "service_ord", "service",
                "billing_model", "risk_level", "detected_via", "severity", "message", "fix")
    )


def trap_findings(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("kind") == "trap").select(
        "repo", F.lit("scaling_trap").alias("type"), F.col("rule").alias("trap"), F.col("path").alias("file"),
        "severity", "message", "fix")


def cost_summary(repos: DataFrame, services: DataFrame, traps: DataFrame) -> DataFrame:
    """Counts and the monthly risk level of each repository."""
    by_service = services.groupBy("repo").agg(
        F.count("*").alias("service_count"),
        F.count_if(F.col("risk_level") == "high").alias("high_risk_services"))
    by_trap = traps.groupBy("repo").agg(F.count("*").alias("scaling_traps"))
    joined = (
        repos.select("repo").distinct().join(by_service, "repo", "left").join(by_trap, "repo", "left").na.fill(0)
    )
    risk = (
        F.when(F.col("high_risk_services") >= 2, "high")
        .when((F.col("high_risk_services") >= 1) | (F.col("service_count") >= 3), "medium")
        .otherwise("low")
    )
    return joined.select(
        "repo", risk.alias("total_monthly_risk"), "service_count", "high_risk_services", "scaling_traps",
        (F.col("service_count") + F.col("scaling_traps")).alias("total_findings"))
