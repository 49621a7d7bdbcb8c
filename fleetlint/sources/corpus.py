"""Sources of the ``files`` table: ``repo, path, name, stem, suffix, dirs, size_bytes, content``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlint.catalog.paths import IMAGE_SUFFIXES
from fleetlint.functions import text
from fleetlint.plans.storage import materialise

FILE_COLUMNS = ("repo", "path", "name", "stem", "suffix", "dirs", "size_bytes", "content")


def with_path_parts(df: DataFrame) -> DataFrame:
    """Add the columns that derive from ``path``."""
    return (
        df.withColumn("name", text.file_name(F.col("path")))
        .withColumn("suffix", text.suffix(F.col("name")))
        .withColumn("stem", text.stem(F.col("name")))
        .withColumn("dirs", text.directories(F.col("path")))
    )


def files_from_rows(df: DataFrame) -> DataFrame:
    """From ``repo, path, content`` (text) and optionally ``size_bytes``."""
    if "size_bytes" not in df.columns:
        df = df.withColumn("size_bytes", F.octet_length("content").cast("long"))
    df = df.withColumn("content", text.clean_text(F.col("content")))
    return with_path_parts(df).select(*FILE_COLUMNS)


def list_tree(spark: SparkSession, root: str, prune: Sequence[str] = ()) -> DataFrame:
    """``repo, path, size_bytes`` of all files below ``root/<repo>/…``, hidden ones included.

    Spark's own file sources skip names that start with a dot or an underscore, which
    would lose ``.env``, ``.gitignore`` and ``__init__.py``. So folders are listed by
    tasks, one level of all repositories at a time: a huge repository is spread over as
    many tasks as it has folders. Folders named in ``prune`` are not entered.
    :func:`list_tree_with_errors` also names the folders that are gone or forbidden.
    """
    return list_tree_with_errors(spark, root, prune)[0]


def list_tree_with_errors(spark: SparkSession, root: str, prune: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """:func:`list_tree`, and ``path, error`` of the folders that are gone or may not be read.

    Any other I/O error fails its task, so that Spark tries it again.
    """
    root = root.rstrip("/")
    folders = spark.createDataFrame([("",)], "folder string")
    levels, failed = [], []
    while True:
        found = materialise(folders.mapInArrow(_list_folders(root, tuple(prune)), _ENTRY_SCHEMA), "listing")
        failed.append(found.where(F.col("error").isNotNull()).select(F.col("entry").alias("path"), "error"))
        found = found.where(F.col("error").isNull())
        levels.append(found.where(~F.col("is_dir") & F.col("entry").contains("/")))
        deeper = found.where("is_dir").select(F.col("entry").alias("folder"))
        count = deeper.count()
        if count == 0:
            break
        folders = deeper.repartition(min(count, 4 * spark.sparkContext.defaultParallelism), "folder")
    files = reduce(DataFrame.unionByName, levels)
    return files.select(
        F.substring_index("entry", "/", 1).alias("repo"),
        F.regexp_replace("entry", r"^[^/]*/", "").alias("path"), "size_bytes"), reduce(DataFrame.unionByName, failed)


def read_tree(spark: SparkSession, root: str, prune: Sequence[str] = ()) -> DataFrame:
    """The ``files`` table of a folder of repositories; the first folder names the repository.

    Images keep their size but no text. Files that are gone or forbidden are left out
    (:func:`read_tree_with_errors` names them), bytes
    that are no UTF-8 are dropped. Reading is shared among tasks by path, so no task
    depends on how the files are spread over repositories.
    """
    return _read_tree(spark, root, prune)[0]


def read_tree_with_errors(spark: SparkSession, root: str, prune: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """:func:`read_tree`, and ``path, error`` of the files and folders that are gone or may not be read.

    Any other I/O error fails its task, so that Spark tries it again. What was read is stored once, so both tables tell of the same read.
    """
    return _read_tree(spark, root, prune, stored=True)


def _read_tree(spark: SparkSession, root: str, prune: Sequence[str], stored: bool = False) -> tuple[DataFrame, DataFrame]:
    root = root.rstrip("/")
    listed, failed = list_tree_with_errors(spark, root, prune)
    image = text.suffix(text.file_name(F.col("path"))).isin(*IMAGE_SUFFIXES)
    images = listed.where(image).select("repo", "path", "size_bytes", F.lit(None).cast("string").alias("content"))
    raw = by_byte_ranges(listed.where(~image)).mapInArrow(_read_files(root), _RAW_SCHEMA)
    if stored:
        raw = materialise(raw, "raw-files")
    failed = failed.unionByName(raw.where(F.col("error").isNotNull()).select(F.concat_ws("/", "repo", "path").alias("path"), "error"))
    texts = raw.where(F.col("error").isNull()).select("repo", "path", "size_bytes", text.decode_text(F.col("raw")).alias("content"))
    return with_path_parts(images.unionByName(texts)).select(*FILE_COLUMNS), failed


def split_bytes(spark: SparkSession) -> int:
    """Bytes of files a reading task takes: the session's ``spark.sql.files.maxPartitionBytes``."""
    value = spark.conf.get("spark.sql.files.maxPartitionBytes", "128m")
    return int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(value))


def byte_ranges(listed: DataFrame, target: int) -> tuple[DataFrame, int]:
    """``repo, path, size_bytes, part``: files cut into ranges of about ``target`` bytes by a running sum.

    The running sum is distributed: each partition of the stored listing sums its own files
    (ordered by repository and path), and the partitions' totals, one row per partition,
    become offsets. A file's part is ``floor(start / target)`` of the byte where it starts, so
    a part holds at most ``target`` bytes plus the end of one file that starts in it. A
    repository with a third of all bytes is cut like any other range.
    """
    spark = listed.sparkSession
    stored = materialise(listed.select("repo", "path", F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size_bytes")),
                         "listing-sizes").withColumn("_pid", F.spark_partition_id())
    totals = sorted((r["_pid"], r["t"]) for r in stored.groupBy("_pid").agg(F.sum("size_bytes").alias("t")).collect())
    offsets, total = [], 0
    for pid, t in totals:
        offsets.append((pid, total))
        total += t
    parts = max(1, -(-total // target))
    if not offsets:
        return stored.select("repo", "path", "size_bytes", F.lit(0).cast("long").alias("part")), 1
    starts = spark.createDataFrame(offsets, "_pid int, _offset long")
    within = Window.partitionBy("_pid").orderBy("repo", "path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = stored.withColumn("_end", F.sum("size_bytes").over(within)).join(F.broadcast(starts), "_pid")
    start = F.col("_offset") + F.col("_end") - F.col("size_bytes")
    return placed.select("repo", "path", "size_bytes", F.least(F.floor(start / target), F.lit(parts - 1)).cast("long").alias("part")), parts


def by_byte_ranges(listed: DataFrame, target: int | None = None) -> DataFrame:
    """``repo, path, size_bytes`` with each byte range of :func:`byte_ranges` in a partition of its own.

    Only the narrow listing rows move; partition ``i`` holds exactly range ``i`` (an identity
    partitioner, which the DataFrame API has not), and the file texts are read afterwards
    inside that partition.
    """
    spark = listed.sparkSession
    ranged, parts = byte_ranges(listed, target or split_bytes(spark))
    placed = (ranged.rdd.map(lambda r: (r["part"], (r["repo"], r["path"], r["size_bytes"])))
              .partitionBy(parts, lambda part: part).values())
    return spark.createDataFrame(placed, "repo string, path string, size_bytes long")


_ENTRY_SCHEMA = "entry string, is_dir boolean, size_bytes bigint, error string"
_RAW_SCHEMA = "repo string, path string, size_bytes bigint, raw binary, error string"
#: Errors that another try cannot mend; they are recorded.
_LASTING = (FileNotFoundError, PermissionError)
_BATCH_BYTES = 32 << 20
_BATCH_ROWS = 50_000


def _list_folders(root: str, prune: tuple[str, ...]):
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                try:
                    infos = system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base))
                except _LASTING as error:
                    yield pa.RecordBatch.from_pydict({
                        "entry": pa.array([folder], pa.string()), "is_dir": pa.array([True], pa.bool_()),
                        "size_bytes": pa.array([None], pa.int64()), "error": pa.array([str(error)], pa.string())})
                    continue
                kept = [i for i in infos if i.base_name not in prune]
                for start in range(0, len(kept), _BATCH_ROWS):
                    part = kept[start:start + _BATCH_ROWS]
                    yield pa.RecordBatch.from_pydict({
                        "entry": pa.array([f"{folder}/{i.base_name}" if folder else i.base_name for i in part], pa.string()),
                        "is_dir": pa.array([i.type == fs.FileType.Directory for i in part], pa.bool_()),
                        "size_bytes": pa.array([i.size for i in part], pa.int64()), "error": pa.nulls(len(part), pa.string())})

    return run


def _read_files(root: str):
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)

        def flush(rows):
            return pa.RecordBatch.from_pydict({
                "repo": pa.array([r[0] for r in rows], pa.string()), "path": pa.array([r[1] for r in rows], pa.string()),
                "size_bytes": pa.array([r[2] for r in rows], pa.int64()), "raw": pa.array([r[3] for r in rows], pa.binary()),
                "error": pa.array([r[4] for r in rows], pa.string())})

        rows, held = [], 0
        for batch in batches:
            for repo, path, size in zip(*(batch.column(c).to_pylist() for c in ("repo", "path", "size_bytes"))):
                try:
                    with system.open_input_stream(f"{base}/{repo}/{path}", compression=None) as stream:
                        raw, failure = stream.read(), None
                except _LASTING as error:
                    raw, failure = None, str(error)
                rows.append((repo, path, size, raw, failure))
                held += len(raw or b"")
                if held >= _BATCH_BYTES:
                    yield flush(rows)
                    rows, held = [], 0
        if rows:
            yield flush(rows)

    return run


def write_table(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a ``files`` table. Rows are sorted by suffix and path within each file, so
    the many plans that read a few suffixes or one file name skip most row groups."""
    files.sortWithinPartitions("suffix", "name", "path").write.mode(mode).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored ``files`` table; ``suffix`` filters reach its parquet scan."""
    return spark.read.parquet(path).select(*FILE_COLUMNS)


def files_from_texts(df: DataFrame, repo: Column, path: Column, content: Column) -> DataFrame:
    """Any text table (documents, pages, chat turns) as a corpus."""
    return files_from_rows(df.select(repo.alias("repo"), path.alias("path"), content.alias("content")))
