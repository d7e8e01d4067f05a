"""Mixing sources to target weights by systematic sampling, with a distributed prefix sum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskweave.llm.common import split_words


def targets(
    sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Sources in code point order, null last, take the weights in turn and split ``share`` of all words. A target
    stops at ``most`` times its source, and what is over is split again by weight. That ends at one level: each
    target is the smaller of its stop and level * weight. The level follows from running sums in the order
    in which sources reach their stop. This table has one row per source, never one per document.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("reach", F.col("source_size") * most / F.col("weight"))
    order = Window.orderBy("reach", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (
        F.sum("source_size").over(whole) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    ) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # The first source whose stop lies above the level sets it; all sources after it are below their stops.
    found = ranked.withColumn("level", level).withColumn("open", F.col("reach") > F.col("level"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("reach"), F.col("source_size"), F.col("level")))).over(whole)
    return found.select(
        "source",
        "source_size",
        F.least(
            F.col("source_size") * F.lit(most),
            F.coalesce(level["level"] * F.col("weight"), F.col("source_size") * F.lit(most)),
        ).alias("target"),
    )


def _unit(text: Column) -> Column:
    """A number in [0, 1) from a text, the same in each run."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    text: str = "text",
) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (copies times size, the words that the mix takes).

    Within a source, documents lie in the order of size, then of a hash of their id; their expected copies
    (target / source size, at most ``most``) are summed up in this order from one random offset, and a document
    is emitted once per whole number that the sum crosses. In the order of size the words taken differ from the
    target by about one long document. The sum is exact arithmetic on ranks: ranks start at the count of all smaller (source, size,
    bucket) cells, so no source, and no size shared by a third of all rows, meets in one task.

    Null texts have size 0, a null source is a source of its own, repeated rows are documents of their own.
    Columns of ``docs`` with the new names are replaced.
    """
    named = docs.drop("size", "source_size", "target", "copies", "taken").withColumn(
        "size", F.size(split_words(F.coalesce(F.col(text), F.lit("")))).cast("long")
    )
    # A text key for the source, since null must equal null; an id's order in its cell comes from a hash.
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = named.select("*", source.alias("_s"), key.alias("_key"), F.substring(key, 1, 3).alias("_bucket"))
    cells = rows.groupBy("_s", "size", "_bucket").agg(F.count("*").alias("_n"))
    per_size = cells.groupBy("_s", "size").agg(F.sum("_n").alias("_n"))
    sizes = per_size.groupBy("_s").agg(F.sum(F.col("_n") * F.col("size")).alias("source_size"))
    named_sizes = sizes.select(
        F.when(F.col("_s") != "", F.expr("substring(_s, 2)")).alias("source"), "source_size"
    )
    goals = targets(named_sizes, weights, share, most).select(source.alias("_s"), "source_size", "target")
    by_size = Window.partitionBy("_s").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_size.select("_s", "size", F.coalesce(F.sum("_n").over(by_size), F.lit(0)).alias("_at"))
    in_size = Window.partitionBy("_s", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cells.select("_s", "size", "_bucket", F.coalesce(F.sum("_n").over(in_size), F.lit(0)).alias("_in"))
    plan = firsts.join(starts, ["_s", "size"]).join(goals, "_s")
    cell = Window.partitionBy("_s", "size", "_bucket").orderBy("_key")
    placed = rows.withColumn("_rank", F.row_number().over(cell) - 1).join(plan, ["_s", "size", "_bucket"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = F.col("_at") + F.col("_in") + F.col("_rank")
    offset = _unit(F.concat(F.lit(seed + "/"), F.col("_s")))
    copies = F.least(F.floor(offset + (at + 1) * rate) - F.floor(offset + at * rate), F.ceil(rate))
    return (
        placed.withColumn("copies", copies.cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_s", "_key", "_bucket", "_rank", "_at", "_in")
    )


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it has copies."""
    copies = F.col("copies").cast("int")
    repeated = F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))
    return mixed.withColumn("_copy", F.explode(repeated)).drop("_copy")
