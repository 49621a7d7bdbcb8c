"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(df: DataFrame, column: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once per row.

    Inside a higher-order function an outer expression would be evaluated again for
    each element; as the element of a one-element array it is bound before.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if they have no other copy."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


#: What empties the memories that this worker process keeps between its tasks.
_KEPT: list[Callable[[], None]] = []


def kept_between_tasks(cached: Callable) -> Callable:
    """Marks a cached function whose values are large: work that does not use them empties it first."""
    _KEPT.append(cached.cache_clear)
    return cached


def _alone(function: Callable) -> Callable:
    """``function`` in a worker that first gives back what earlier work of other kinds left there."""

    def run(*args):
        from fleetlint.llm import tables

        for clear in tables._KEPT:
            clear()
        return function(*args)

    return run


def map_arrow(df: DataFrame, function: Callable, schema: str, uses_kept: bool = False) -> DataFrame:
    """``mapInArrow`` whose workers find this package; ``uses_kept``: the function uses what is kept between tasks."""
    find_package(df.sparkSession)
    return df.mapInArrow(function if uses_kept else _alone(function), schema)


def map_groups(df: DataFrame, keys: list[str], function: Callable, schema: str) -> DataFrame:
    """``applyInArrow`` per group, whose workers find this package."""
    find_package(df.sparkSession)

    def run(table):
        return _alone(function)(table)

    return df.groupBy(*keys).applyInArrow(run, schema)
