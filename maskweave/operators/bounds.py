"""Bounds on a result set: rows, bytes, and which of the two cut it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_ROWS = 1000
DEFAULT_BYTES = 1 << 20
KEPT_RESULTS = 200


def ceiling(requested: int = 0, allowed: int = 0) -> int:
    """Rows a result may have: a request can lower the ceiling, never raise it."""
    top = allowed if allowed > 0 else DEFAULT_ROWS
    return min(top, requested) if requested > 0 else top


def ceiling_column(requested: Column, allowed: Column) -> Column:
    top = F.when(allowed > 0, allowed).otherwise(F.lit(DEFAULT_ROWS))
    return F.when(requested > 0, F.least(top, requested)).otherwise(top)


def row_bytes(df: DataFrame, masked: bool = True) -> Column:
    """Bytes of a row as the reader gets it, in JSON with one separator; or the raw width of its values."""
    if masked:
        return F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})) + 1
    return sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(0))


def bounded(df: DataFrame, order: list[Column], rows: int, limit_bytes: int = DEFAULT_BYTES, masked: bool = True) -> DataFrame:
    """The longest prefix within both bounds, with the total read and the reason of a cut on each row.

    The row ceiling comes first, as a top-n with one row to spare. Only those few rows reach the one
    window without a partition, so the single task there never grows with the table.
    """
    top = df.orderBy(*order).limit(rows + 1)
    w = W.orderBy(*order)
    running = w.rowsBetween(W.unboundedPreceding, 0)
    counted = top.select(
        "*",
        F.row_number().over(w).alias("_n"),
        F.sum(row_bytes(df, masked)).over(running).alias("_bytes"),
        F.count("*").over(W.partitionBy(F.lit(1))).alias("_read"),
    )
    inside = (F.col("_n") <= rows) & (F.col("_bytes") <= limit_bytes)
    size_cut = F.max((F.col("_n") <= rows) & (F.col("_bytes") > limit_bytes)).over(W.partitionBy(F.lit(1)))
    reason = F.when(F.col("_size_cut"), "size").when(F.col("_read") > rows, "rows").otherwise("")
    return (
        counted.withColumn("_size_cut", size_cut).where(inside)
        .withColumn("truncated_by", reason)
        .drop("_n", "_bytes", "_read", "_size_cut")
    )


def cut_reason(rows_cut: Column, size_cut: Column) -> Column:
    """Size wins where both bounds cut."""
    return F.when(size_cut, "size").when(rows_cut, "rows").otherwise("")


def latest(results: DataFrame, order: list[Column], keep: int = KEPT_RESULTS) -> DataFrame:
    return results.orderBy(*order).limit(keep)
