"""Small constant tables, planned as local relations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession


def sql_literal(value) -> str:
    """A Spark SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (tuple, list)):
        return "array(" + ", ".join(sql_literal(v) for v in value) + ")"
    # "${" would be taken for a configuration variable inside a SQL text.
    text = str(value).replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("$", "\\u0024")
    return f"'{text}'"


def values_table(spark: SparkSession, columns: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def find_package(spark) -> None:
    """Let Python workers import this package from where the driver has it, if they have no other copy."""
    import os
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
