"""Sinks of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_findings(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by layer and severity.

    A folder for each repository would mean millions of tiny files for a fleet;
    rows are sorted by repository within each file, so row-group statistics prune
    a read of one repository.
    """
    (
        findings.sortWithinPartitions("layer", "severity", "repo", "file", "line")
        .write.mode(mode).partitionBy("layer", "severity").parquet(path)
    )


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Write a ``files`` table as a folder tree ``root/<repo>/<path>`` and return what was written.

    Each task writes the files of its own rows (texts as UTF-8; a file without text, such as
    an image, as ``size_bytes`` zero bytes), so no file passes through the driver. The result,
    ``repo, path, size_bytes``, is stored, which is the action that writes the tree.
    """
    from fleetlint.plans.storage import materialise

    root = root.rstrip("/")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            repos, paths, sizes, written = [], [], [], []
            for repo, path, size, content in zip(*(batch.column(c).to_pylist() for c in ("repo", "path", "size_bytes", "content"))):
                data = content.encode("utf-8", "surrogatepass") if content is not None else bytes(size or 0)
                target = f"{base}/{repo}/{path}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(target, compression=None) as out:
                    out.write(data)
                repos.append(repo)
                paths.append(path)
                sizes.append(size)
                written.append(len(data))
            yield pa.RecordBatch.from_pydict({"repo": pa.array(repos, pa.string()), "path": pa.array(paths, pa.string()),
                                              "size_bytes": pa.array(written, pa.int64())})

    rows = files.select("repo", "path", "size_bytes", "content").mapInArrow(run, "repo string, path string, size_bytes long")
    return materialise(rows, "written-tree")


BUCKETS = 64


def _bucket(buckets: int):
    from pyspark.sql import functions as F

    return F.pmod(F.xxhash64("repo"), F.lit(buckets)).cast("int")


def write_buckets(findings: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store findings partitioned by a hash bucket of the repository (``bucket=<n>`` folders)."""
    findings.withColumn("bucket", _bucket(buckets)).write.mode("overwrite").partitionBy("bucket").parquet(path)


def replace_repos(findings: DataFrame, changed: DataFrame, path: str, buckets: int = BUCKETS) -> list[int]:
    """Replace the stored findings of the repositories in ``changed`` by their rows in ``findings``.

    Only the buckets of changed repositories are rewritten (dynamic partition overwrite);
    inside them, the rows of unchanged repositories are carried over, so writing the same
    repositories twice gives the same table. A bucket left without rows is removed. The
    rows to write are stored first, since a job may not overwrite what it reads. Returns the
    rewritten buckets (at most ``buckets`` numbers).
    """
    from pyspark.sql import functions as F

    from fleetlint.plans.storage import materialise

    spark = findings.sparkSession
    repos = changed.select("repo").distinct()
    touched = sorted(r["b"] for r in repos.select(_bucket(buckets).alias("b")).distinct().collect())
    if not touched:
        return []
    old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).join(repos, "repo", "left_anti")
    new = findings.join(repos, "repo", "left_semi").withColumn("bucket", _bucket(buckets))
    rows = materialise(old.unionByName(new.select(*old.columns)), "replaced-buckets")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    filled = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
    jvm = spark.sparkContext._jvm
    for b in set(touched) - filled:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/bucket={b}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return touched
