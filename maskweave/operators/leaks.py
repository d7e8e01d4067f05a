"""Leak audit: which known values show in output text, per kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.operators.emission import fold_column, surroundings
from maskweave.session import cut_lineage

NUMERIC_VALUE = "^[0-9.]+$"


def strings_of(df: DataFrame) -> DataFrame:
    """Every string of a table, (text): one row per cell, nested values as their JSON text."""
    cells = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        cells.append(F.to_json(col) if nested else col.cast("string"))
    return df.select(F.explode(F.array(*cells)).alias("text")).where("text is not null")


def stands_alone(text: Column, start: Column, end: Column) -> Column:
    """Whether neither neighbour of a place in folded text is a digit, a dot or a letter a to z."""
    before = F.substr(text, start, F.lit(1))
    after = F.substr(text, end + 1, F.lit(1))
    edge = (start > 0) & before.rlike("[.0-9a-z]")
    return ~edge & ~after.rlike("[.0-9a-z]")


def truth_entries(truth: DataFrame) -> DataFrame:
    """Known values (kind, value) as search entries; the folded value itself is what a hit reports."""
    folded = fold_column(F.col("value"))
    return truth.where(F.length("value") > 0).select(
        folded.alias("pattern"), folded.alias("token"), F.lit(False).alias("short")
    ).distinct()


def leaked_values(outputs: list[DataFrame], truth: DataFrame) -> DataFrame:
    """Known values that show somewhere in the outputs, (kind, value). A value of digits and dots counts
    only where it stands alone, since a tag can hold the same digits by chance.

    Output text is searched where it lies and never shuffled; what travels is the pieces around likely places, and one row per
    value and partition. Ten values and millions run the same plan.
    """
    return _leaked(outputs, cut_lineage(truth.select("kind", "value").distinct()))


def _leaked(outputs: list[DataFrame], truth: DataFrame) -> DataFrame:
    texts = reduce(DataFrame.unionByName, [strings_of(o) for o in outputs])
    hits = surroundings(texts, truth_entries(truth))
    alone = stands_alone(F.col("folded"), F.col("start"), F.col("end"))
    seen = hits.groupBy(F.col("token").alias("value")).agg(F.max(alone).alias("alone"))
    known = truth.select("kind", fold_column(F.col("value")).alias("value")).distinct()
    counted = F.col("alone") | ~F.col("value").rlike(NUMERIC_VALUE)
    return known.join(seen, "value").where(counted).select("kind", "value")


def leak_counts(outputs: list[DataFrame], truth: DataFrame) -> DataFrame:
    """Leaked values per kind, a row for each kind, so that a clean kind shows its zero."""
    truth = cut_lineage(truth.select("kind", "value").distinct())
    found = _leaked(outputs, truth).groupBy("kind").agg(F.count_distinct("value").alias("leaks"))
    return truth.select("kind").distinct().join(found, "kind", "left").select(
        "kind", F.coalesce("leaks", F.lit(0)).alias("leaks")
    )
