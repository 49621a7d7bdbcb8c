"""The registered queries: every operator over whole tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import corpus
from fleetlint.catalog import rules as R
from fleetlint.catalog.services import SERVICE_RULES
from fleetlint.catalog.packs import PACKS
from fleetlint.functions.text import slugify
from fleetlint.operators import (
    cost, dependencies, knowledge, manifests, packs, performance, report, rule_table, scan, security, stack, testing, walk,
)
from fleetlint.plans import skew
from fleetlint.plans.fleet import FleetScan
from fleetlint.plans.storage import materialise, new_path
from fleetlint.sources.corpus import files_from_texts, read_tree
from fleetlint.sources.sinks import replace_repos, write_buckets, write_tree
from fleetlint.streaming import rate_limit, rescan, run

FIRST_N = 20
MIN_LINES = 40
COPY_LINES = 6
AREA = "auth"
STREAM_LIMIT = 1
QUERIES = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(column: str):
    return F.array_join(column, ",").alias(column)


def documents(spark, sf_dir, columns=("source",)):
    docs = corpus.spread_documents(spark, sf_dir)
    return files_from_texts(docs, F.col("source"), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")), F.col("text"))


def _fleet(spark, sf_dir, **options):
    """The whole analysis over a stored corpus, as it runs on a cluster."""
    return FleetScan(materialise(corpus.files(spark, sf_dir), "files"), **options)


def as_text_rules(rules):
    """The same rules for any text, whatever its path."""
    return tuple(replace(r, kind="text", extensions=None) for r in rules)


HARDCODED = as_text_rules([r for r in R.GENERAL if r.rule_id == "hardcoded_secret"])
TEXT_SECRETS = as_text_rules(R.SECRETS)
TEXT_GENERAL = as_text_rules(R.GENERAL)

# --- Sources and walks ------------------------------------------------------


@query
def corpus_scan(spark, sf_dir):
    return corpus.files(spark, sf_dir).select(
        "repo", "path", "name", "suffix", joined("dirs"), "size_bytes",
        F.coalesce(F.md5("content"), F.lit("")).alias("content_md5"))


@query
def tree_roundtrip(spark, sf_dir):
    """The derived corpus written as a folder tree and read back by ``read_tree`` (byte-range tasks)."""
    root = new_path(spark, "tree")
    write_tree(corpus.files(spark, sf_dir), root)
    return read_tree(spark, root).select(
        "repo", "path", "name", "suffix", joined("dirs"), "size_bytes",
        F.coalesce(F.md5("content"), F.lit("")).alias("content_md5"))


@query
def eligible_files(spark, sf_dir):
    tests = {
        "rule_source": walk.is_rule_source(), "secret_source": walk.is_secret_source(), "code": walk.is_code(),
        "ratio_source": walk.is_ratio_source(),
        "stack_counted": walk.not_below(walk.paths.STACK_SKIP_DIRS),
        "image_dirs": walk.not_below(walk.paths.IMAGE_SKIP_DIRS),
        "react_dirs": walk.not_below(walk.paths.REACT_SKIP_DIRS),
    }
    return corpus.files(spark, sf_dir).groupBy("repo").agg(
        F.count("*").alias("files"), *[F.count_if(test).alias(name) for name, test in tests.items()])


@query
def first_n_files(spark, sf_dir):
    return walk.first_files(corpus.files(spark, sf_dir), FIRST_N).select("repo", "path", "file_rank")


@query
def root_markers(spark, sf_dir):
    return walk.root_entries(corpus.files(spark, sf_dir))


@query
def test_files(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    return testing.test_files(files, stack.language_names(files))


# --- Stack ------------------------------------------------------------------


@query
def lang_counts(spark, sf_dir):
    return stack.suffix_counts(corpus.files(spark, sf_dir))


@query
def lang_table(spark, sf_dir):
    return stack.language_table(stack.languages(corpus.files(spark, sf_dir)))


@query
def deps_js(spark, sf_dir):
    return manifests.package_json_deps(corpus.files(spark, sf_dir))


@query
def deps_py(spark, sf_dir):
    return manifests.python_deps(corpus.files(spark, sf_dir))


@query
def deps_go(spark, sf_dir):
    return manifests.go_deps(corpus.files(spark, sf_dir))


@query
def deps_cargo(spark, sf_dir):
    return manifests.cargo_deps(corpus.files(spark, sf_dir))


@query
def deps_merged(spark, sf_dir):
    return manifests.merged_dependencies(manifests.dependencies(corpus.files(spark, sf_dir)))


@query
def frameworks(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    found = stack.frameworks(manifests.dependencies(files), stack.root_profile(files))
    return found.select("repo", joined("frameworks"))


def _toolchain(spark, sf_dir):
    return stack.toolchain(stack.root_profile(corpus.files(spark, sf_dir)))


@query
def package_manager(spark, sf_dir):
    return _toolchain(spark, sf_dir).select("repo", "package_manager")


@query
def build_tools(spark, sf_dir):
    return _toolchain(spark, sf_dir).select("repo", joined("build_tools"))


@query
def runtimes(spark, sf_dir):
    return _toolchain(spark, sf_dir).select("repo", joined("runtimes"))


@query
def test_runners(spark, sf_dir):
    return _toolchain(spark, sf_dir).select("repo", joined("test_runners"))


@query
def stack_row(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    return report.stack_lines(stack.stack(files, manifests.dependencies(files)))


# --- Dependencies -----------------------------------------------------------


def _merged(spark, sf_dir):
    return manifests.merged_dependencies(manifests.dependencies(corpus.files(spark, sf_dir)))


def _catalog(spark, sf_dir, kind, *columns, with_advice=False):
    found = dependencies.catalog_findings(_merged(spark, sf_dir), with_advice)
    return found.where(F.col("type") == kind).select("repo", "package", "severity", *columns)


@query
def dep_heavy(spark, sf_dir):
    return _catalog(spark, sf_dir, "heavy_dependency", "message", with_advice=True)


@query
def dep_deprecated(spark, sf_dir):
    return _catalog(spark, sf_dir, "deprecated", "message")


@query
def dep_payg(spark, sf_dir):
    return _catalog(spark, sf_dir, "cost_risk", "service", "message")


@query
def dep_duplicates(spark, sf_dir):
    return dependencies.duplicate_findings(_merged(spark, sf_dir)).select("repo", joined("packages"), "message")


@query
def dep_rollup(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    merged = manifests.merged_dependencies(manifests.dependencies(files))
    return dependencies.dependency_summary(files, merged, dependencies.dependency_findings(merged))


@query
def bundle_risks(spark, sf_dir):
    return dependencies.bundle_findings(manifests.package_json_deps(corpus.files(spark, sf_dir))).select(
        "repo", "package", "estimated_size_kb", "severity", "message")


@query
def typosquats(spark, sf_dir):
    return knowledge.typosquats(manifests.dependencies(corpus.files(spark, sf_dir)))


# --- Rule scans -------------------------------------------------------------


def _scan_set(rules):
    def build(spark, sf_dir):
        files = corpus.files(spark, sf_dir)
        found = scan.scan_project(files, stack.language_names(files), rules, max_files=None)
        return found.select("repo", "rule", "category", "severity", "file", "line", "match")
    return build


for _name, _rules in R.RULE_SETS.items():
    QUERIES[f"scan_{_name}"] = _scan_set(_rules)


@query
def scan_project(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    found = scan.scan_project(files, stack.language_names(files))
    return found.select("repo", "rule", "category", "severity", "file", "line", "match")


@query
def scan_dedupe(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    found = scan.scan_project(files, stack.language_names(files), R.JAVASCRIPT, max_files=None, dedupe=True)
    return found.select("repo", "rule", "file", "line", "match")


def _scan_pack(name):
    def build(spark, sf_dir):
        hits = scan.scan_rules(corpus.files(spark, sf_dir), packs.pack_rules(name))
        return hits.select("repo", "rule_set", "rule", "severity", F.col("path").alias("file"), "line", "match")
    return build


for _name in PACKS:
    QUERIES[f"pack_{_name}"] = _scan_pack(_name)

TABLE_RULES = 1000


def table_rules(spark):
    """The catalog packs (``typescript`` extends ``javascript``), 1,000 generated rules and one bad pattern, as rows."""
    generated = [("generated", f"call_{k}", "info", rf"\b(?:old|legacy)_api_{k}\s*\(", "A retired call.", "Use the new one.",
                  None, True, True) for k in range(TABLE_RULES)]
    bad = [("generated", "unclosed_group", "info", r"(unclosed\s+group", "", "", None, True, True)]
    return rule_table.rules_table(spark, PACKS).unionByName(spark.createDataFrame(generated + bad, rule_table.RULE_SCHEMA))


@query
def pack_table_scan(spark, sf_dir):
    """Matches of all rule rows over the corpus in one plan, and a row with the problem of each rejected rule."""
    rules = table_rules(spark)
    hits = rule_table.scan_table(corpus.files(spark, sf_dir), rules).withColumn("problem", F.lit(None).cast("string"))
    problems = rule_table.rejected(rules).select(
        F.lit(None).cast("string").alias("repo"), F.lit(None).cast("string").alias("path"), "pack", "rule_id",
        F.lit(None).cast("string").alias("severity"), F.lit(None).cast("int").alias("line"),
        *[F.lit(None).cast("string").alias(c) for c in ("match", "match_end", "match_key")], "problem")
    return hits.unionByName(problems)


@query
def scan_documents(spark, sf_dir):
    hits = scan.scan_rules(documents(spark, sf_dir), TEXT_GENERAL)
    return hits.select("repo", "rule", "severity", F.col("path").alias("file"), "line", "match")


@query
def document_secret_counts(spark, sf_dir):
    hits = scan.scan_rules(documents(spark, sf_dir), HARDCODED)
    return report.severity_counts(hits)


@query
def scan_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    files = files_from_texts(pages, F.regexp_extract("url", "^[a-z]+://([^/]+)", 1),
                             F.concat("page_id", F.lit(".html")), F.col("html"))
    hits = scan.scan_rules(files, TEXT_GENERAL)
    return hits.select("repo", "rule", "severity", F.col("path").alias("file"), "line", "match")


# A user's own rules are data too. The last one repeats a group without bound.
MARKUP_RULES = (
    R.Rule("text", "markup", "inline_script", "warning", r"<script>[^<]*"),
    R.Rule("text", "markup", "inline_style", "info", r"<style>[^<]*"),
    R.Rule("text", "markup", "plain_http", "warning", r'href="http://[^"]+"'),
    R.Rule("text", "markup", "link_list", "info", r"(?:<li><a href=[^>]*>[^<]*</a></li>){2,}"),
)
TURN_RULES = (
    R.Rule("text", "turns", "short_line", "info", r"^[^\n]{1,40}$"),
    R.Rule("text", "turns", "long_run", "info", r"[^ \n]{18,}"),
)


@query
def scan_pages_custom(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    files = files_from_texts(pages, F.regexp_extract("url", "^[a-z]+://([^/]+)", 1),
                             F.concat("page_id", F.lit(".html")), F.col("html"))
    hits = scan.scan_rules(files, MARKUP_RULES)
    return hits.select("repo", "rule", "severity", F.col("path").alias("file"), "line", "match")


@query
def scan_turns_custom(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    files = files_from_texts(turns, F.col("conv_id").cast("string"),
                             F.concat_ws("_", "role", "turn"), F.col("text"))
    hits = scan.scan_rules(files, TURN_RULES)
    return hits.select("repo", "rule", F.col("path").alias("file"), "line", "match")


@query
def scan_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    files = files_from_texts(turns, F.col("conv_id").cast("string"),
                             F.concat_ws("_", "role", "turn"), F.col("text"))
    hits = scan.scan_rules(files, HARDCODED + TEXT_SECRETS)
    return hits.select("repo", "rule", "severity", F.col("path").alias("file"), "line", "match")


# --- Performance ------------------------------------------------------------


@query
def large_images(spark, sf_dir):
    return performance.large_images(corpus.files(spark, sf_dir)).select("repo", "file", "size_kb", "message")


@query
def missing_opts(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    found = performance.missing_optimizations(files, stack.stack(files, manifests.dependencies(files)))
    return found.select("repo", "rule", "severity")


@query
def performance_rollup(spark, sf_dir):
    fleet = _fleet(spark, sf_dir)
    found = fleet.bundle.select("repo", "type").unionByName(fleet.images.select("repo", "type")).unionByName(
        fleet.missing_optimizations.select("repo", "type"))
    return performance.performance_summary(fleet.repos, found)


# --- Security ---------------------------------------------------------------


@query
def scan_secrets(spark, sf_dir):
    found = security.secret_findings(scan.scan_rules(corpus.files(spark, sf_dir), R.SECRETS))
    return found.select("repo", "secret_type", "file", "line", "severity", "match_preview")


@query
def mask_secrets(spark, sf_dir):
    hits = scan.scan_rules(documents(spark, sf_dir), HARDCODED)
    return hits.select("repo", F.col("path").alias("file"), "line",
                       security.mask(F.col("match"), F.col("match_end")).alias("match_preview"))


@query
def dangerous_files(spark, sf_dir):
    return security.dangerous_files(corpus.files(spark, sf_dir)).select("repo", "file", "rule", "severity")


@query
def scan_auth(spark, sf_dir):
    found = security.auth_findings(scan.scan_rules(corpus.files(spark, sf_dir), R.AUTH))
    return found.select("repo", "rule", "file", "line", "severity")


@query
def security_rollup(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    hits = scan.scan_rules(files, R.SECRETS + R.AUTH)
    found = hits.select("repo", F.when(F.col("kind") == "secret", "exposed_secret").otherwise("auth_risk").alias("type"),
                        "severity")
    sensitive = security.dangerous_files(files).select("repo", "type", "severity")
    return security.security_summary(files, found.unionByName(sensitive))


# --- Cost -------------------------------------------------------------------


@query
def env_evidence(spark, sf_dir):
    return cost.env_evidence(corpus.files(spark, sf_dir)).select("repo", "service_id", "ord", "evidence")


def _services(files, hits):
    return cost.service_findings(cost.env_evidence(files), cost.code_evidence(hits))


@query
def service_usage(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    found = _services(files, scan.scan_rules(files, SERVICE_RULES))
    return found.select("repo", "service_id", "service", "billing_model", "risk_level", "severity",
                        joined("detected_via"))


@query
def service_evidence(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    return cost.evidence_counts(cost.env_evidence(files), cost.code_evidence(scan.scan_rules(files, SERVICE_RULES)))


@query
def detected_services(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    return report.detected_services(_services(files, scan.scan_rules(files, SERVICE_RULES)))


@query
def scaling_traps(spark, sf_dir):
    found = cost.trap_findings(scan.scan_rules(corpus.files(spark, sf_dir), R.TRAPS))
    return found.select("repo", "trap", "file", "severity")


@query
def monthly_risk(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    services = _services(files, scan.scan_rules(files, SERVICE_RULES))
    return cost.cost_summary(files, services, cost.trap_findings(scan.scan_rules(files, R.TRAPS)))


# --- Tests ------------------------------------------------------------------


def _test_counts(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    return testing.test_counts(files, stack.language_names(files))


@query
def test_ratio(spark, sf_dir):
    return _test_counts(spark, sf_dir).select(
        "repo", "source_file_count", "test_file_count", "test_ratio_percent", "coverage_estimate")


@query
def test_kinds(spark, sf_dir):
    return _test_counts(spark, sf_dir).select(
        "repo", "has_unit_tests", "has_integration_tests", "has_e2e_tests", joined("missing_test_types"))


@query
def test_antipatterns(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    found = testing.smell_findings(scan.scan_rules(files, R.TEST_SMELLS), stack.language_names(files))
    return found.select("repo", "rule", "file", "line", "severity")


@query
def untested_critical(spark, sf_dir):
    return _fleet(spark, sf_dir, max_files=None, rules=testing.CRITICAL_RULES).untested.select(
        "repo", "category", "file")


@query
def test_rollup(spark, sf_dir):
    fleet = _fleet(spark, sf_dir, max_files=None, rules=testing.CRITICAL_RULES + R.TEST_SMELLS)
    return testing.test_summary(fleet.test_counts, fleet.stack, fleet.untested, fleet.smells).select(
        "repo", "source_file_count", "test_file_count", "untested_critical_paths", "test_anti_patterns",
        joined("test_runners"), "total_findings")


# --- Findings and reports ---------------------------------------------------


@query
def findings_union(spark, sf_dir):
    found = _fleet(spark, sf_dir).findings
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in
             ("type", "rule", "category", "file", "package", "service_id", "secret_type", "trap")]
    return found.select("repo", "layer", "severity", F.coalesce("line", F.lit(0)).alias("line"), *blank)


@query
def findings_ordered(spark, sf_dir):
    """All findings in report order (severity, repository, layer, file, line, then the rest), numbered over the whole table."""
    found = findings_union(spark, sf_dir).withColumn("_severity", report.severity_rank())
    order = [F.col(c).asc_nulls_first() for c in ("_severity", "repo", "layer", "file", "line", "type", "rule", "category",
                                                  "package", "service_id", "secret_type", "trap")]
    return skew.global_positions(found, order).drop("_severity")


@query
def findings_cube(spark, sf_dir):
    found = _fleet(spark, sf_dir).findings
    return report.findings_cube(found.withColumn("category", F.coalesce("category", F.lit(""))))


@query
def severity_rollup(spark, sf_dir):
    fleet = _fleet(spark, sf_dir)
    return report.severity_counts(fleet.findings, fleet.repos)


def _row_shape(rows, *extra):
    return rows.select("repo", "severity", F.col("layer"), F.coalesce("category", F.lit("")).alias("category"),
                       F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"),
                       "message", *extra)


@query
def report_capped(spark, sf_dir):
    fleet = _fleet(spark, sf_dir)
    rows = report.report_rows(fleet.stored_findings)
    return rows.groupBy("repo", "severity", "layer").agg(F.count("*").alias("shown"), F.max("more").alias("more"))


@query
def task_queue(spark, sf_dir):
    rows = report.task_queue(_fleet(spark, sf_dir).tasks)
    return rows.groupBy("repo", "severity_rank", "severity", "category").agg(
        F.count("*").alias("shown"), F.max("more").alias("more"))


@query
def scan_summary(spark, sf_dir):
    return report.scan_summary(_fleet(spark, sf_dir).summaries)


@query
def layer_summaries(spark, sf_dir):
    return _fleet(spark, sf_dir).summaries.select(
        "repo", "total_deps", F.col("dep_heavy_count").alias("heavy"), F.col("dep_deprecated_count").alias("deprecated"),
        F.col("sec_total_findings").alias("sec"), F.col("sec_critical_count").alias("sec_critical"),
        F.col("perf_total_findings").alias("perf"), F.col("pat_total_findings").alias("pat"),
        F.col("cost_service_count").alias("service_count"), F.col("cost_scaling_traps").alias("scaling_traps"),
        F.col("test_test_file_count").alias("test_file_count"), F.col("test_source_file_count").alias("source_file_count"))


@query
def plan_header(spark, sf_dir):
    return report.plan_header(_fleet(spark, sf_dir).summaries)


@query
def critical_gate(spark, sf_dir):
    fleet = _fleet(spark, sf_dir)
    return report.critical_gate(fleet.findings, fleet.repos)


def _two_states(spark, sf_dir):
    states = []
    for shift in (0, 1):
        files = corpus.files(spark, sf_dir, shift)
        hits = scan.scan_rules(files, R.GENERAL + R.DATABASE)
        states.append(hits.withColumnRenamed("path", "file"))
    return report.findings_diff(*states)


def _state(spark, sf_dir, shift):
    """The findings of a state, stored: they are written, compared and replaced from one scan."""
    hits = scan.scan_rules(corpus.files(spark, sf_dir, shift), R.GENERAL + R.DATABASE)
    return materialise(
        hits.select("repo", "rule", F.col("path").alias("file"), "line", "severity", "match", "match_key"), "state")


@query
def findings_replaced(spark, sf_dir):
    """Findings stored by repository bucket, then the repositories whose findings changed replaced by their later state."""
    path = new_path(spark, "findings")
    before, after = _state(spark, sf_dir, 0), _state(spark, sf_dir, 1)
    write_buckets(before, path)

    def fingerprint(df):
        return df.groupBy("repo").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rule", "file", "line", "match_key").cast("decimal(38,0)")).alias("h"))

    a, b = fingerprint(before).alias("a"), fingerprint(after).alias("b")
    changed = a.join(b, "repo", "full_outer").where(~F.col("a.n").eqNullSafe(F.col("b.n")) | ~F.col("a.h").eqNullSafe(F.col("b.h")))
    replace_repos(after, changed.select("repo"), path)
    return spark.read.parquet(path).drop("bucket", "match_key")


@query
def findings_diff(spark, sf_dir):
    return _two_states(spark, sf_dir).drop("match_key")


@query
def quality_gate(spark, sf_dir):
    return report.quality_gate(_two_states(spark, sf_dir), corpus.files(spark, sf_dir, 0).unionByName(corpus.files(spark, sf_dir, 1)))


@query
def area_findings(spark, sf_dir):
    hits = scan.scan_rules(corpus.files(spark, sf_dir), R.GENERAL).withColumnRenamed("path", "file")
    return report.area_findings(hits, AREA).select("repo", "rule", "file", "line", "match")


@query
def feature_slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", slugify(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


# --- Streams and advice -----------------------------------------------------


@query
def rescan_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "documents").schema
    docs = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents*.parquet")
    changes = files_from_texts(docs, F.col("source"), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")), F.col("text"))
    stamped = changes.withColumn("changed_at", F.timestamp_seconds(F.regexp_extract("path", "([0-9]+)", 1).cast("long")))
    hits = rescan.rescan_available(stamped, HARDCODED, new_path(spark, "rescan"))
    return hits.select("repo", "rule", F.col("path").alias("file"), "line", "match")


def _minutes(windows):
    return windows.select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")],
                          "event_type", "requests")


@query
def rate_limit_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _minutes(rate_limit.over_limit(events, ["event_type"], STREAM_LIMIT))


@query
def rate_limit_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    closed = run.available_now(rate_limit.over_limit(stamped, ["event_type"], STREAM_LIMIT), "rates")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _minutes(closed.unionByName(rate_limit.still_open(events, ["event_type"], STREAM_LIMIT)))


@query
def oversized_files(spark, sf_dir):
    return knowledge.oversized_files(documents(spark, sf_dir), MIN_LINES)


@query
def copy_paste(spark, sf_dir):
    return knowledge.copied_blocks(documents(spark, sf_dir), COPY_LINES)
