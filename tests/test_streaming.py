import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlint.catalog.rules import GENERAL
from fleetlint.operators.scan import scan_rules
from fleetlint.sources.corpus import FILE_COLUMNS
from fleetlint.streaming import rate_limit, rescan, run

START = dt.datetime(2024, 1, 1)


def write(df, path, name):
    df.coalesce(1).write.parquet(f"{path}/{name}")


def stream_of(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_rescan_equals_batch_and_skips_unchanged_files(spark, make_files, tmp_path):
    first = make_files([("r", "a.py", "TODO"), ("r", "b.py", "x\nFIXME")]).withColumn("changed_at", F.lit(START))
    again = make_files([("r", "a.py", "TODO"), ("r", "b.py", "x\n\nFIXME")]).withColumn("changed_at", F.lit(START + dt.timedelta(minutes=5)))
    write(first, tmp_path / "in", "1")
    write(again, tmp_path / "in", "2")
    stream = stream_of(spark, first.schema, str(tmp_path / "in"))
    got = rescan.rescan_available(stream, GENERAL, str(tmp_path / "out"))
    batch = scan_rules(first.unionByName(again).select(*FILE_COLUMNS).distinct(), GENERAL)
    key = lambda df: sorted((r.path, r.rule, r.line) for r in df.collect())
    assert key(got) == key(batch) == [("a.py", "todo_fixme", 1), ("b.py", "todo_fixme", 2), ("b.py", "todo_fixme", 3)]


def test_rescan_reads_reverted_and_late_versions(spark, make_files, tmp_path):
    def state(name, text, minutes):
        return make_files([("r", name, text)]).withColumn("changed_at", F.lit(START + dt.timedelta(minutes=minutes)))

    states = [state("a.py", "TODO", 0), state("a.py", "x\nTODO", 5), state("a.py", "TODO", 6), state("a.py", "TODO", 7),
              state("b.py", "FIXME", -9000), state("a.py", None, 9)]
    for i, rows in enumerate(states):
        write(rows, tmp_path / "in", str(i))
    got = rescan.rescan_available(stream_of(spark, states[0].schema, str(tmp_path / "in")), GENERAL, str(tmp_path / "out"))
    assert sorted((r.path, r.line, r.changed_at.minute) for r in got.collect()) == [
        ("a.py", 1, 0), ("a.py", 1, 6), ("a.py", 2, 5), ("b.py", 1, 0)]
    whole = rescan.changed_versions(reduce(DataFrame.unionByName, states).where("content IS NOT NULL").select(
        "repo", "path", "changed_at", F.col("content").alias("version")), None, "changed_at")
    assert whole.count() == 4


def test_rate_limit_drops_late_events(spark, tmp_path):
    def events(rows):
        return spark.createDataFrame([(START + dt.timedelta(seconds=s), u) for s, u in rows], "ts timestamp, user string")

    # Spark filters late rows by the watermark of the batch before the last one.
    batches = [events([(i, "a") for i in range(12)] + [(30, "b")]), events([(3600, "a")]), events([(3700, "a")]),
               events([(5, "b")] * 50 + [(7200, "a")])]
    for i, batch in enumerate(batches):
        write(batch, tmp_path / "in", str(i))
    stream = stream_of(spark, batches[0].schema, str(tmp_path / "in"))
    rows = run.available_now(rate_limit.over_limit(stream, ["user"], rate_limit.AUTH_PER_MINUTE), "t").collect()
    assert [(r.user, r.requests) for r in rows] == [("a", 12)]
    whole = reduce(DataFrame.unionByName, batches)
    everything = rate_limit.over_limit(whole, ["user"], rate_limit.AUTH_PER_MINUTE).collect()
    assert sorted((r.user, r.requests) for r in everything) == [("a", 12), ("b", 51)]
