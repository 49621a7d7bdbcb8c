from collections import Counter

from pyspark.sql import functions as F

from fleetlint.catalog.rules import GENERAL, Rule
from fleetlint.operators import packs, report, scan
from fleetlint.plans.fleet import FleetScan
from fleetlint.plans.skew import join_per_repo, top_k
from fleetlint.plans.storage import materialise
from fleetlint.sources.sinks import write_findings


def findings_table(spark, rows):
    df = spark.createDataFrame(rows, "repo string, rule string, severity string, file string, line int, match string, message string")
    return report.as_findings(df, "patterns")


def test_caps_and_overflow(spark):
    rows = [("r", "x", "info", f"f{i:03d}", i, "m", "t") for i in range(45)] + [("r", "y", "critical", "g", 1, "m", "t")] * 30
    rows += [("s", "x", "info", "f", 1, "m", "t")]
    out = report.report_rows(findings_table(spark, rows))
    count = {(r.repo, r.severity): (r["count"], r.more) for r in out.groupBy("repo", "severity").agg(
        F.count("*").alias("count"), F.max("more").alias("more")).collect()}
    assert count == {("r", "info"): (20, 25), ("r", "critical"): (30, 0), ("s", "info"): (1, 0)}
    assert {r.file for r in out.where("repo = 'r' and severity = 'info'").collect()} == {f"f{i:03d}" for i in range(20)}


def test_sorting_and_counts(spark):
    df = findings_table(spark, [("r", "a", s, "f", 1, "m", "t") for s in ("info", "odd", "critical", "warning")])
    assert [r.severity for r in report.sorted_findings(df).collect()] == ["critical", "warning", "info", "odd"]
    row = report.severity_counts(df).first()
    assert (row.critical, row.warning, row.info, row.total) == (1, 1, 1, 4)


def test_diff_and_gates(spark):
    before = findings_table(spark, [("r", "a", "critical", "f", 1, "m", "t"), ("r", "b", "info", "f", 1, "m", "t")])
    after = findings_table(spark, [("r", "b", "info", "f", 9, "m", "t"), ("r", "c", "critical", "f", 2, "m", "t"), ("s", "b", "info", "f", 1, "m", "t")])
    diff = report.findings_diff(before, after)
    assert {(r.repo, r.rule): r.status for r in diff.collect()} == {
        ("r", "a"): "fixed", ("r", "b"): "kept", ("r", "c"): "new", ("s", "b"): "new"}
    assert {r.repo: r.passed for r in report.quality_gate(diff).collect()} == {"r": False, "s": True}
    assert {r.repo: r.blocked for r in report.critical_gate(after).collect()} == {"r": True, "s": False}
    assert report.area_findings(after.withColumn("file", F.lit("src/Auth/x")), "auth").count() == 3


def corpus_rows(repo):
    return [(repo, "package.json", '{"dependencies": {"moment": "1", "react": "1", "request": "1"}}'),
            (repo, "src/auth/login.py", "TODO\nlogin token\nimport openai.x"), (repo, "tests/test_x.py", "sleep(1000)"),
            (repo, ".env", "OPENAI_API_KEY=1"), (repo, "a.js", "eval(x); cookie"), (repo, "b.ts", "// @ts-ignore"),
            (repo, "img.png", None, 600_000)]


def test_one_repository_alone_gives_the_same(spark, make_files):
    both = FleetScan(make_files(corpus_rows("a") + corpus_rows("b") + [("b", "c.py", "TODO")])).findings
    alone = FleetScan(make_files(corpus_rows("a"))).findings
    key = lambda df: Counter(tuple(map(str, r)) for r in df.collect())
    assert key(both.where("repo = 'a'")) == key(alone)


def test_reports_of_a_fleet(spark, make_files):
    fleet = FleetScan(make_files(corpus_rows("a")))
    stored = fleet.stored_findings
    total = stored.count()
    layers = {r.layer: r["count"] for r in stored.groupBy("layer").count().collect()}
    assert sum(layers.values()) == total and set(layers) == set(report.REPORT_LAYERS)
    summary = {r.category: (r.status, r.findings) for r in report.scan_summary(fleet.summaries).collect()}
    assert summary["Stack"][0].startswith("python / react") and summary["Dependencies"] == ("3 total", "2 heavy, 1 deprecated")
    assert summary["Security"][0] == "CRITICAL" and summary["Cost Risk"] == ("MEDIUM", "1 services, 0 traps")
    assert summary["Patterns"][0] == f"{layers['patterns']} findings"
    header = report.plan_header(fleet.summaries).first()
    assert header.primary_language == "python" and header.cost_risk == "MEDIUM"
    tasks = fleet.tasks
    assert tasks.count() == total + 2  # integration and e2e tests are missing
    assert {r.category for r in tasks.where("layer = 'patterns'").collect()} >= {"general", "javascript", "typescript"}


def test_write_findings(spark, tmp_path):
    df = findings_table(spark, [("r", "a", "critical", "f", 1, "m", "t"), ("s", "a", "info", "f", 1, "m", "t")])
    write_findings(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("severity = 'info'").count() == 1


def test_top_k_and_join_on_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 50)).alias("repo"), "id")
    got = {(r.repo, r.id, r.rank) for r in top_k(df, ["repo"], [F.col("id")], 5, ["id"]).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r.repo, []).append(r.id)
    assert got == {(k, v, i) for k, ids in groups.items() for i, v in enumerate(sorted(ids)[:5], 1)}
    dims = df.groupBy("repo").agg(F.max("id").alias("m")).where("repo <> 'r2'")
    for how in ("left", "inner"):
        plain = Counter(map(tuple, df.join(dims, "repo", how).select("repo", "id", "m").collect()))
        assert plain == Counter(map(tuple, join_per_repo(df, dims, ["id"], how).select("repo", "id", "m").collect()))


def test_materialise_keeps_rows_and_cuts_lineage(spark):
    df = materialise(spark.range(10).withColumn("a", F.array("id")), "t")
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().executedPlan().toString()


def test_packs(spark, make_files, tmp_path):
    (tmp_path / "base.yaml").write_text(
        "name: base\npatterns:\n  a: {pattern: 'foo', severity: info, message: m, fix: f, extensions: [.py]}\n"
        "  bad: {pattern: '(', severity: info, message: m, fix: f}\n")
    (tmp_path / "child.yaml").write_text(
        "name: child\nextends: base\npatterns:\n  a: {pattern: 'bar', severity: critical, message: m, fix: f}\n  b: {pattern: '(?P<x>q)', severity: info, message: m, fix: f}\n")
    loaded, problems = packs.load_packs(str(tmp_path))
    assert [(p, r) for p, r, _ in problems] == [("base", "bad")]
    rules = packs.pack_rules("child", loaded)
    assert [(r.rule_id, r.pattern, r.rule_set) for r in rules] == [("a", "bar", "child"), ("b", "(?P<x>q)", "child")]
    hits = scan.scan_rules(make_files([("r", "x.js", "bar\nq")]), rules)
    assert sorted((h.rule, h.line) for h in hits.collect()) == [("a", 1), ("b", 2)]
    assert len(packs.pack_rules("typescript")) == 12 and len(packs.pack_rules("javascript")) == 10


def test_rules_that_java_rejects_are_reported(spark):
    odd = Rule("pattern", "x", "odd", "info", r"a{1,2}{3}")
    bad = Rule("pattern", "x", "bad", "info", r"(?<=a+)b")
    good, problems = packs.valid_rules([GENERAL[0], bad], spark)
    assert good == (GENERAL[0],) and problems[0][0] == "bad"
    assert packs.valid_rules([odd])[1] and packs.valid_rules([GENERAL[0]])[1] == []


def test_rules_that_only_python_can_run_do_not_stop_the_others(spark, make_files):
    rules = [Rule("pattern", "x", "named", "info", r"(?P<my_name>abc)"), Rule("pattern", "x", "again", "info", r"(?P<q>ab)(?P=q)"),
             Rule("pattern", "x", "plain", "info", r"zz")]
    assert packs.valid_rules(rules, spark) == (tuple(rules), [])
    hits = scan.scan_rules(make_files([("r", "x.js", "abc\nabab\nzz")]), rules).collect()
    assert sorted((h.rule, h.line, h.match) for h in hits) == [("again", 2, "abab"), ("named", 1, "abc"), ("plain", 3, "zz")]


def test_clean_repositories_have_rows(spark):
    one = spark.createDataFrame([("r", "k", "f", "m", "critical", "security")], "repo string, rule string, file string, match string, severity string, layer string")
    repos = spark.createDataFrame([("r",), ("clean",)], "repo string")
    assert {tuple(r) for r in report.severity_counts(one, repos).collect()} == {("r", 1, 0, 0, 1), ("clean", 0, 0, 0, 0)}
    assert {tuple(r) for r in report.critical_gate(one, repos).collect()} == {("r", 1, True), ("clean", 0, False)}
    diff = report.findings_diff(one.limit(0), one)
    assert {tuple(r) for r in report.quality_gate(diff, repos).collect()} == {("r", 1, False), ("clean", 0, True)}


def test_another_copy_of_a_critical_finding_fails_the_gate(spark):
    one = spark.createDataFrame([("r", "k", "f", "m", "critical")], "repo string, rule string, file string, match string, severity string")
    diff = report.findings_diff(one, one.union(one))
    assert [(r.new_critical, r.passed) for r in report.quality_gate(diff).collect()] == [(1, False)]
    assert [r.passed for r in report.quality_gate(report.findings_diff(one, one)).collect()] == [True]


def test_long_matches_that_begin_alike_are_different_findings(spark, make_files):
    start = "key=" + "a" * 200
    rules = [Rule("pattern", "general", "k", "critical", r"key=\w+"), Rule("pattern", "general", "p", "critical", r"(?P<my_name>key=\w+)")]
    states = [scan.scan_rules(make_files([("r", "x.js", start + end), ("s", "x.js", start)]), rules).withColumnRenamed("path", "file")
              for end in ("1", "2")]
    diff = report.findings_diff(*states)
    assert {tuple(r) for r in report.quality_gate(diff).collect()} == {("r", 2, False), ("s", 0, True)}
    assert Counter(r.status for r in diff.collect()) == {"new": 2, "fixed": 2, "kept": 2}


def test_global_positions_number_every_row_in_order(spark):
    from pyspark.sql import functions as F

    from fleetlint.plans.skew import global_positions

    rows = [("hot" if i % 3 else f"r{i % 17}", i % 5, None if i % 11 == 0 else f"f{i % 7}") for i in range(2000)]
    rows += [("hot", 1, "same")] * 50
    df = spark.createDataFrame(rows, "repo string, level int, file string")
    order = [F.col("level").asc_nulls_first(), F.col("repo").asc_nulls_first(), F.col("file").asc_nulls_first()]
    got = sorted((r.position, r.level, r.repo, r.file) for r in global_positions(df, order, parts=7).collect())
    assert [g[0] for g in got] == list(range(1, len(rows) + 1))
    key = [(lvl, repo, (file is not None, file)) for _, lvl, repo, file in got]
    assert key == sorted(key)
    empty = spark.createDataFrame([], "repo string, level int, file string")
    assert global_positions(empty, order).count() == 0


def test_evidence_beyond_the_shown_list_is_counted(spark):
    from fleetlint.operators import cost

    env = spark.createDataFrame([("a", "stripe", 0, "env:STRIPE_KEY")], "repo string, service_id string, ord int, evidence string")
    code = spark.createDataFrame([("a", "stripe", f"src/f{i}.js", f"code:src/f{i}.js") for i in range(12)]
                                 + [("b", "twilio", "x.py", "code:x.py")], "repo string, service_id string, path string, evidence string")
    got = {(r.repo, r.service_id): (r.n_evidence, r.shown, r.more_evidence) for r in cost.evidence_counts(env, code).collect()}
    assert got == {("a", "stripe"): (13, 5, 8), ("b", "twilio"): (1, 1, 0)}


def test_replace_repos_rewrites_only_their_buckets(spark, tmp_path):
    import os

    from fleetlint.sources.sinks import replace_repos, write_buckets

    schema = "repo string, rule string, line int"
    before = spark.createDataFrame([(f"r{i}", "x", j) for i in range(40) for j in range(3)], schema)
    path = str(tmp_path / "findings")
    write_buckets(before, path, buckets=8)

    def files():
        return {d: sorted(os.listdir(os.path.join(path, d))) for d in os.listdir(path) if d.startswith("bucket=")}

    first = files()
    after = spark.createDataFrame([("r1", "y", 9), ("r2", "y", 8)], schema)
    changed = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "repo string")
    touched = replace_repos(after, changed, path, buckets=8)
    again = files()
    for folder, names in first.items():
        if int(folder.split("=")[1]) not in touched:
            assert again[folder] == names
    want = sorted([(f"r{i}", "x", j) for i in range(40) if i not in (1, 2, 3) for j in range(3)] + [("r1", "y", 9), ("r2", "y", 8)])

    def table():
        return sorted(tuple(r) for r in spark.read.parquet(path).select("repo", "rule", "line").collect())

    assert table() == want
    replace_repos(after, changed, path, buckets=8)
    assert table() == want
    only = spark.createDataFrame([(r,) for r in sorted({r.repo for r in before.collect()})], "repo string")
    replace_repos(spark.createDataFrame([], schema), only, path, buckets=8)
    assert files() == {}  # every bucket emptied, so no folder is left


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_replaced_findings_come_from_stored_states(spark, tmp_path):
    from checks import queries

    spark.createDataFrame([(i, f"TODO {i}", "s") for i in range(40)], "doc_id long, text string, source string").write.parquet(
        str(tmp_path / "documents.parquet"))
    state = queries._state(spark, str(tmp_path), 0)
    assert "Generate" not in _plan(state) and "regexp_replace" not in _plan(state)
    assert state.count() > 0


def test_the_task_queue_counts_tests_once(spark, make_files):
    fleet = FleetScan(make_files([("r", "a.py", "x = 1"), ("r", "test_a.py", "assert a")]))
    assert "Aggregate" not in _plan(fleet.test_counts)
    assert [tuple(r) for r in fleet.test_counts.select("repo", "test_file_count").collect()] == [("r", 1)]
