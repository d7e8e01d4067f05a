"""Run a user's statement: bounded, with bound parameters, and described without reading a row."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskweave.operators.bounds import ceiling
from maskweave.plans.lineage import query_only


def run(spark: SparkSession, sql: str, params: dict[str, Any] | None = None, max_rows: int = 0, allowed: int = 0, flag: str = "truncated") -> DataFrame:
    """Result of a query up to the row ceiling, and on each row whether the ceiling cut it. Parameters are bound, so a value
    never becomes statement text. One row more than the ceiling is read; only those rows meet in the window."""
    rows = ceiling(max_rows, allowed)
    out = spark.sql(query_only(spark, sql), args=params or {})
    if flag.lower() in (c.lower() for c in out.columns):
        raise ValueError(f"the query has a column {flag} of its own: name another flag")
    return out.limit(rows + 1).withColumn(flag, F.count("*").over(W.partitionBy(F.lit(1))) > rows).limit(rows)


def describe(spark: SparkSession, sql: str, params: dict[str, Any] | None = None) -> list[tuple[str, str]]:
    """Name and type of each output column; analysis only, no job."""
    return [(f.name, f.dataType.simpleString()) for f in spark.sql(query_only(spark, sql), args=params or {}).schema.fields]
