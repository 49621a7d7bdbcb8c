import re

from pyspark.sql import functions as F

from fleetlint.functions import text
from fleetlint.operators import walk
from fleetlint.sources import corpus


def test_path_parts(spark, make_files):
    rows = {r.path: r for r in make_files([("r", p, "") for p in (
        ".env", "prod.env", "a/B.test.TS", "noext", "x/.hidden/y.tar.gz", "trailing.")]).collect()}
    assert {p: (r.name, r.stem, r.suffix, r.dirs) for p, r in rows.items()} == {
        ".env": (".env", ".env", "", []), "prod.env": ("prod.env", "prod", ".env", []),
        "a/B.test.TS": ("B.test.TS", "B.test", ".ts", ["a"]), "noext": ("noext", "noext", "", []),
        "x/.hidden/y.tar.gz": ("y.tar.gz", "y.tar", ".gz", ["x", ".hidden"]), "trailing.": ("trailing.", "trailing.", "", [])}


def test_decode_drops_bad_bytes_and_normalises_newlines(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb\r\nc\rd\xc3\xa9" + "\ue000x\ue001".encode()),)], "raw binary")
    assert df.select(text.decode_text(F.col("raw"))).first()[0] == "ab\nc\nd\u00e9\ufffdx\ufffd"
    df = spark.createDataFrame([(bytearray(b"a\xff" + "\ufffdb".encode()),)], "raw binary")
    assert df.select(text.decode_text(F.col("raw"))).first()[0] == "a\ufffdb"


def test_percent_rounds_like_python(spark):
    pairs = [(t, s) for s in range(1, 420, 3) for t in range(0, 200, 7)] + [(1, 16), (7, 2000), (1, 80), (3, 80), (21, 16), (1, 0)]
    df = spark.createDataFrame(pairs, "t long, s long").select(
        "t", "s", text.percent_1(F.col("t"), F.greatest("s", F.lit(1))).alias("p"))
    wrong = [(r.t, r.s, r.p) for r in df.collect() if r.p != round(r.t / max(r.s, 1) * 100, 1)]
    assert not wrong


def test_slugify(spark):
    names = ["User Login!", "--A--b--", "\u00dcber 5", "", "***", "a_b"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.slugify(F.col("n")).alias("s"))
    for row in df.collect():
        assert row.s == (re.sub(r"[^a-z0-9]+", "-", row.n.lower()).strip("-") or "feature")


def test_read_tree(spark, tmp_path):
    for path, body in {"one/src/__init__.py": b"x = 1\r\ny", "one/.env": b"K=1", "two.x/deep/er/b.js": b"\xfe\xffz",
                       "two.x/c.png": b"1234", "two.x/node_modules/m.js": b"", "stray.txt": b"no repository"}.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(body)
    files = corpus.read_tree(spark, str(tmp_path), prune=("node_modules",))
    rows = sorted((r.repo, r.path, r.suffix, r.size_bytes, r.content or "") for r in files.collect())
    assert rows == [("one", ".env", "", 3, "K=1"), ("one", "src/__init__.py", ".py", 8, "x = 1\ny"),
                    ("two.x", "c.png", ".png", 4, ""), ("two.x", "deep/er/b.js", ".js", 3, "z")]
    assert corpus.list_tree(spark, str(tmp_path)).count() == 5


def test_suffix_filter_reaches_the_stored_table(spark, make_files, tmp_path):
    from fleetlint.catalog.rules import PATTERN_RULES, SECRETS
    from fleetlint.operators.scan import scan
    make_files([("r", "a.py", "TODO"), ("r", ".env", "x")]).write.parquet(str(tmp_path / "files"))
    stored = corpus.read_table(spark, str(tmp_path / "files"))
    for rules in (PATTERN_RULES, PATTERN_RULES + SECRETS):
        plan = scan(stored, rules)._jdf.queryExecution().executedPlan().toString()
        pushed = re.search(r"PushedFilters: \[(.*?)ReadSchema", plan).group(1)
        assert "In(suffix" in pushed and "size_bytes" not in plan.split("ReadSchema")[1]


def test_eligibility(spark, make_files):
    files = make_files([("r", p, "x") for p in (
        "a.py", "env/a.py", ".env/a.py", "bin/a.py", "dist/a.py", "A.JS", "conf.YAML", ".env.test", "vendor/.env")])
    got = {r.path: (r.rule, r.secret, r.code) for r in files.select(
        "path", walk.is_rule_source().alias("rule"), walk.is_secret_source().alias("secret"), walk.is_code().alias("code")).collect()}
    assert got == {
        "a.py": (True, True, True), "env/a.py": (False, True, True), ".env/a.py": (True, True, True),
        "bin/a.py": (False, True, True), "dist/a.py": (False, False, False), "A.JS": (True, True, True),
        "conf.YAML": (False, True, False), ".env.test": (False, True, False), "vendor/.env": (False, False, False)}


def test_root_entries_see_files_and_folders(spark, make_files):
    files = make_files([("r", p, "") for p in ("Makefile", "terraform/x/y.tf", "sub/Makefile", "config/routes.rb", ".vercel/a")])
    assert sorted(r.entry for r in walk.root_entries(files).collect()) == [".vercel", "Makefile", "config/routes.rb", "terraform"]


def test_unreadable_files_are_recorded_and_other_errors_fail(spark, tmp_path):
    import pyarrow as pa
    import pytest

    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.py").write_text("x")
    (tmp_path / "r" / "gone.py").write_text("y")
    files, errors = corpus._read_tree(spark, str(tmp_path), ())
    (tmp_path / "r" / "gone.py").unlink()  # after the listing
    assert [r.path for r in files.collect()] == ["a.py"] and [r.path for r in errors.collect()] == ["r/gone.py"]
    files, errors = corpus.read_tree_with_errors(spark, str(tmp_path))
    assert [r.path for r in files.collect()] == ["a.py"] and errors.count() == 0
    gone = list(corpus._list_folders(str(tmp_path), ())([pa.RecordBatch.from_pydict({"folder": ["none"]})]))
    assert [(b.column("entry")[0].as_py(), b.column("error")[0].is_valid) for b in gone] == [("none", True)]
    for run, columns in ((corpus._list_folders(str(tmp_path), ()), {"folder": ["r" * 300]}),
                         (corpus._read_files(str(tmp_path)), {"repo": ["r"], "path": ["x" * 300], "size_bytes": [1]})):
        with pytest.raises(OSError):
            list(run([pa.RecordBatch.from_pydict(columns)]))
