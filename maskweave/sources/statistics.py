"""Mergeable statistics of text columns: a sketch of the values, their bytes and their cells, per column and day.

A day's sketches are written once and merged ever after, so statistics of a growing table cost a scan of its new days. No cell's
value is shuffled. An estimate is exact to well under one in a hundred for few values, and off by about two in a hundred for
many; columns whose estimate lies near a bound that a rule compares it with are counted exactly afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.functions.types import TEXT, family
from maskweave.sources.schema import KEY, exact_stats
from maskweave.session import cut_lineage


def sketches(df: DataFrame, relation: str, day: Column | None = None, schema: str = "main", columns: list[str] | None = None) -> DataFrame | None:
    """(schema, relation, column, day, sketch, bytes, cells) of the text columns, or of those named; null cells count in none.

    One aggregation covers all columns. Without a day there is one row per column with a null day. A table without text
    columns gives None, one without rows gives no rows.
    """
    names = [f.name for f in df.schema.fields if family(f.dataType, f.metadata) == TEXT and (columns is None or f.name in columns)]
    if not names:
        return None
    aggs = []
    for i, n in enumerate(names):
        cell = F.col(f"`{n}`")
        aggs += [F.hll_sketch_agg(cell).alias(f"_s{i}"), F.sum(F.octet_length(cell).cast("long")).alias(f"_b{i}"), F.count(cell).alias(f"_c{i}")]
    per_day = df.groupBy((F.lit(None).cast("date") if day is None else day.cast("date")).alias("_day")).agg(*aggs)
    entries = F.array(*(
        F.struct(
            F.lit(schema).alias("schema"), F.lit(relation).alias("relation"), F.lit(n).alias("column"), F.col("_day").alias("day"),
            F.col(f"_s{i}").alias("sketch"), F.coalesce(f"_b{i}", F.lit(0)).alias("bytes"), F.col(f"_c{i}").alias("cells"),
        ) for i, n in enumerate(names)
    ))
    return per_day.select(F.inline(entries))


def stored(found: DataFrame, path: str) -> None:
    """Write the days of ``found`` under ``path``. A day written again replaces that day and leaves the others."""
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def merged(found: DataFrame, *by: str) -> DataFrame:
    """Statistics per column, or per column and the columns ``by``: estimated distinct values and average width in bytes."""
    return found.groupBy(*KEY, *by).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).cast("double").alias("distinct"),
        F.when(F.sum("cells") > 0, F.sum("bytes") / F.sum("cells")).alias("avg_width"),
    )


def settled(tables: dict[str, DataFrame], bound: int = 100, schema: str = "main") -> DataFrame:
    """Statistics for a rule that compares distinct counts with ``bound``: estimates, but exact counts where the estimate lies
    between half and twice the bound. Only such columns are read again, and they have few values to shuffle."""
    parts = [p for p in (sketches(df, name, schema=schema) for name, df in sorted(tables.items())) if p is not None]
    stats = cut_lineage(merged(reduce(DataFrame.unionByName, parts)))
    near: dict[str, list[str]] = {}
    for r in stats.where(F.col("distinct").between(bound / 2, bound * 2)).select("relation", "column").collect():  # names of columns
        near.setdefault(r.relation, []).append(r["column"])
    if not near:
        return stats
    exact = reduce(DataFrame.unionByName, [exact_stats(tables[t], schema, t, sorted(names)) for t, names in sorted(near.items())])
    sure = exact.select(*KEY, F.col("distinct").alias("sure"))
    return stats.join(F.broadcast(sure), list(KEY), "left").select(*KEY, F.coalesce("sure", "distinct").alias("distinct"), "avg_width")
