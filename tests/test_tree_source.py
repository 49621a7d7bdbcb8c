"""Folder trees: written, listed and read back in tasks of bounded bytes."""

from pyspark.sql import functions as F

from fleetlint.sources import corpus
from fleetlint.sources.sinks import write_tree


def test_byte_ranges_bound_every_task(spark, make_files, tmp_path):
    rows = [("hot", f"src/f{i}.py", "x = 1\n" * (50 + i % 40)) for i in range(300)]
    rows += [(f"r{k}", f"a/b{i}.js", "let y = 2;\n" * (10 + k)) for k in range(20) for i in range(5)]
    rows += [("big", "one.txt", "z" * 60_000), ("hot", ".env", "A=1\n"), ("empty", "e.md", "")]
    files = make_files(rows)
    write_tree(files, str(tmp_path))
    listed = corpus.list_tree(spark, str(tmp_path))
    target = 8_000
    ranged = corpus.by_byte_ranges(listed, target)
    per_task = ranged.groupBy(F.spark_partition_id().alias("p")).agg(
        F.sum("size_bytes").alias("bytes"), F.max("size_bytes").alias("largest"), F.count("*").alias("n")).collect()
    total = sum(len(r[2].encode()) for r in rows)
    assert sum(r["n"] for r in per_task) == len(rows)
    assert sum(r["bytes"] for r in per_task) == total
    assert all(r["bytes"] <= target + r["largest"] for r in per_task)
    assert ranged.rdd.getNumPartitions() == -(-total // target)
    back = {(r.repo, r.path): r.content for r in corpus.read_tree(spark, str(tmp_path)).collect()}
    assert back == {(r[0], r[1]): r[2] for r in rows}


def test_byte_ranges_of_an_empty_listing(spark):
    listed = spark.createDataFrame([], "repo string, path string, size_bytes long")
    assert corpus.by_byte_ranges(listed, 1000).count() == 0
