"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, or a folder of the warehouse where none is set.

    Both are places that every executor and the driver can reach; a machine's own
    temporary folder is never used.
    """
    path = spark.conf.get(CONF, None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/fleetlint/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    The lineage ends here, an expensive scan is not repeated by later branches,
    and the optimizer knows the true size of the table when it picks joins.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Delete the stored intermediates of all jobs that used this shared folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/fleetlint")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
