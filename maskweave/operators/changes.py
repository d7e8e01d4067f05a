"""Writes as change-sets: preview, commit and text form. Nothing is stored until the caller writes it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.functions.text import value_text

SHOWN = 50


def row_struct(df: DataFrame, prefix: str = "") -> Column:
    return F.struct(*(F.col(f"{prefix}`{c}`").alias(c) for c in df.columns))


def update_preview(df: DataFrame, where: Column, new: dict[str, Column]) -> DataFrame:
    """Rows an UPDATE would change, as they are and as they would be."""
    after = F.struct(*(new.get(c, F.col(c)).alias(c) for c in df.columns))
    return df.where(where).select(row_struct(df).alias("old"), after.alias("new"))


def delete_preview(df: DataFrame, where: Column) -> DataFrame:
    old = row_struct(df)
    return df.where(where).select(old.alias("old"), F.when(F.lit(False), old).alias("new"))


def insert_preview(rows: DataFrame) -> DataFrame:
    new = row_struct(rows)
    return rows.select(F.when(F.lit(False), new).alias("old"), new.alias("new"))


def shown(changes: DataFrame, order: list[Column], limit: int = SHOWN) -> DataFrame:
    """The first changes by ``order``, each with the number of changes left out."""
    omitted = F.greatest(changes.agg(F.count("*")).scalar() - limit, F.lit(0))
    return changes.orderBy(*order).limit(limit).withColumn("omitted", omitted)


def updated(df: DataFrame, where: Column, new: dict[str, Column]) -> DataFrame:
    """The table after an UPDATE. A condition that is null changes nothing."""
    hit = F.coalesce(where, F.lit(False))
    return df.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns))


def deleted(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def inserted(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows)


def upserted(df: DataFrame, source: DataFrame, keys: list[str], delete: Column | None = None) -> DataFrame:
    """The table after a MERGE: matched rows take the source's values, new ones are added, and matched
    rows for which ``delete`` holds, over the source's columns, are dropped. Source keys must be unique."""
    values = [c for c in df.columns if c not in keys]
    s = source.withColumn("_matched", F.lit(True))
    if delete is not None:
        s = s.withColumn("_delete", F.coalesce(delete, F.lit(False)))
    else:
        s = s.withColumn("_delete", F.lit(False))
    renamed = s.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in values), "_matched", "_delete")
    t = df.withColumn("_present", F.lit(True))
    # Only a row that was there can be deleted: an unmatched source row is added, whatever the condition says.
    gone = F.col("_present") & F.col("_delete")
    out = t.join(renamed, keys, "full").where(~F.coalesce(gone, F.lit(False)))
    merged = {c: F.when(F.col("_matched"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in values}
    return out.select(*(merged.get(c, F.col(c)) for c in df.columns))


def execution_report(changes: DataFrame, executed: DataFrame, operation: str) -> DataFrame:
    """Rows previewed and rows really changed, side by side: the data may have moved between the two."""
    previewed = changes.agg(F.count("*").alias("previewed_rows"))
    return previewed.select(
        F.lit(operation).alias("operation"), "previewed_rows", executed.agg(F.count("*")).scalar().alias("executed_rows")
    )


def side_as_text(changes: DataFrame, side: str) -> DataFrame:
    """One side of a change-set as text for a reader."""
    fields = changes.schema[side].dataType.fields
    return changes.select(*(value_text(F.col(f"{side}.`{f.name}`"), f.dataType.simpleString()).alias(f.name) for f in fields))


def returned(changes: DataFrame, side: str = "new") -> DataFrame:
    """RETURNING rows, ready to be masked like any output."""
    return changes.where(F.col(side).isNotNull()).select(f"{side}.*")


def changed_columns(changes: DataFrame) -> DataFrame:
    """How often each column differs between the two sides."""
    names = [f.name for f in changes.schema["old"].dataType.fields]
    counts = [F.count(F.when(~F.col(f"old.`{n}`").eqNullSafe(F.col(f"new.`{n}`")), 1)).alias(n) for n in names]
    pairs = F.array(*(F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").alias("changed")) for n in names))
    return changes.agg(*counts).select(F.inline(pairs))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
