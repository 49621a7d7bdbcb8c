"""Run a streaming query over everything that is there and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from fleetlint.plans.storage import shared_dir


def available_now(stream: DataFrame, name: str) -> DataFrame:
    """Append the stream to a parquet table in the shared folder, then read the table."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/fleetlint/{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
