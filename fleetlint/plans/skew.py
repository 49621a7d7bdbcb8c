"""Helpers that keep one very large repository from ending in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def join_per_repo(facts: DataFrame, dims: DataFrame, spread: Sequence[str],
                  how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join rows with a table that has at most one row for each repository.

    The repository is salted by the columns in ``spread`` and each dimension row is
    copied once per salt, so a repository with a third of all rows is shared by
    ``salts`` tasks (adaptive execution may split further, or broadcast ``dims``
    when its measured size allows).
    """
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = dims.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, ["repo", "_salt"], how).drop("_salt")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          spread: Sequence[str], rank: str = "rank", salts: int = 64) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1.

    Groups are cut down to ``k`` rows within each salt first, so that no task ever
    sorts a whole group; Spark additionally limits within each input partition.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_local", F.row_number().over(first))
        .where(F.col("_local") <= k)
        .drop("_local", "_salt")
        .withColumn(rank, F.row_number().over(last))
        .where(F.col(rank) <= k)
    )


def global_positions(df: DataFrame, order: Sequence[Column], name: str = "position", parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: each row's place (from 1) in ``order`` over the whole table.

    No window over all rows (one task): rows are range-partitioned by the order and sorted in
    each partition, a row's index inside its partition comes from
    ``monotonically_increasing_id`` (partition in the upper bits, index in the lower 33), and
    the partitions' row counts, one row per partition, become offsets. Rows equal in every
    column of ``order`` share a range, so ties fall into one partition and are numbered
    there in an undefined but complete way. The sorted table is stored once so that the
    numbers and the counts come from one run.
    """
    from fleetlint.plans.storage import materialise

    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    tagged = materialise(ordered.withColumn("_mid", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_mid", 33).cast("int")
    counts = sorted((r["_part"], r["n"]) for r in tagged.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    if not offsets:
        return tagged.drop("_mid").withColumn(name, F.lit(None).cast("long"))
    starts = spark.createDataFrame(offsets, "_part int, _offset long")
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (tagged.withColumn("_part", part).join(F.broadcast(starts), "_part")
            .withColumn(name, F.col("_offset") + local + 1).drop("_part", "_offset", "_mid"))
