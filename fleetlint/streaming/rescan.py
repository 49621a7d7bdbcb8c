"""Re-scan of changed files as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from fleetlint.catalog.rules import Rule
from fleetlint.operators.scan import scan_rules

_FILE = ["repo", "path"]


def changed_versions(heads: DataFrame, known: DataFrame | None, event_time: str) -> DataFrame:
    """Rows of ``heads`` that differ from the file's version before them, in the order of ``event_time``.

    Before the first row of a file stands its latest version in ``known``, if it has one. Both
    are narrow tables ``repo, path, <event_time>, version``; of ``known`` only files of
    ``heads`` are aggregated.
    """
    order = Window.partitionBy(*_FILE).orderBy(event_time, "version")
    rows = heads.distinct().withColumn("before", F.lag("version").over(order))
    if known is not None:
        latest = known.join(heads.select(*_FILE).distinct(), _FILE, "left_semi").groupBy(*_FILE).agg(
            F.max_by("version", F.struct(event_time, "version")).alias("latest"))
        rows = rows.join(latest, _FILE, "left").withColumn("before", F.coalesce("before", "latest"))
    return rows.where(~F.col("before").eqNullSafe(F.col("version"))).select(*heads.columns)


def rescan(changes: DataFrame, rules: Sequence[Rule], path: str, event_time: str = "changed_at") -> DataStreamWriter:
    """A writer that puts hits of changed files into ``path/rows``; start it with any trigger.

    A file is scanned whenever its text differs from the version before it, also when it
    returns to an earlier text or arrives late: the event time only orders versions and
    drops nothing. What was seen is kept as narrow rows in ``path/known``, one part per micro-batch,
    so a batch costs its own texts and a semi join. A batch that is run again
    after a failure overwrites its own parts and reads only those of batches before it.
    Null contents have no version and no hits; a null event time counts as the earliest.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(F.col("content").isNotNull()).withColumn("version", F.sha2("content", 256))
        heads = rows.select(*_FILE, event_time, "version")
        known = None
        if batch_id > 0:
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in heads.schema) + ", batch long"
            known = spark.read.schema(schema).parquet(f"{path}/known").where(F.col("batch") < batch_id).drop("batch")
        changed = changed_versions(heads, known, event_time)
        same = [rows[c].eqNullSafe(changed[c]) for c in heads.columns]
        fresh = rows.join(changed, same, "left_semi").dropDuplicates(heads.columns).drop("version")
        scan_rules(fresh, rules, carry=(event_time,)).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        heads.distinct().write.mode("overwrite").parquet(f"{path}/known/batch={batch_id}")

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/state")


def rescan_available(changes: DataFrame, rules: Sequence[Rule], path: str, event_time: str = "changed_at") -> DataFrame:
    """Scan everything that has arrived and return all hits so far; no input gives an empty table."""
    spark = changes.sparkSession
    schema = scan_rules(changes, rules, carry=(event_time,)).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/rows/batch=-1")
    rescan(changes, rules, path, event_time).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/rows")
