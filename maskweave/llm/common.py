"""Shared pieces: words (runs without ASCII white space), the learning fold, tables written to the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space between words, as the characters themselves.
SPACES = " \t\n\x0b\x0c\r"


def split_words(text: Column) -> Column:
    """The words of a text that is not null. Splitting a trimmed text is faster than collecting matches."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning: one id in five, by the CRC of its decimal text. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Only a local session may go without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="maskweave-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _forest(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.RecordBatch]:
    """Edges ``(u, v)`` as stars around the smallest id that they reach, centre included, some ``at_once`` vertices at a time."""
    above: dict = {}

    def root(x):
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    def stars(schema: pa.Schema) -> pa.RecordBatch:
        ids = list(above)
        found = pa.RecordBatch.from_arrays([pa.array(ids, schema[0].type), pa.array(map(root, ids), schema[1].type)], names=["u", "v"])
        above.clear()
        return found

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((root(u), root(v)))
            above[high] = low
        if len(above) >= at_once:
            yield stars(batch.schema)
    if above:
        yield stars(batch.schema)


def components(edges: DataFrame, rounds: int = 60, at_once: int = 250_000) -> DataFrame:
    """``(id, component)`` for every end of ``edges (a, b)``: the smallest id that can be reached.

    Each task first joins what its own edges connect, some ``at_once`` vertices at a time, which leaves few rounds to
    do. Then alternating large-star and small-star steps. A hub's neighbours are never gathered: each step is a map-side
    minimum per vertex joined back to the edges, a join that Spark can split. Each step is a plan of its own, small and
    without broadcasts, since the driver plans, describes and serves every one of them. A self-edge keeps its vertex.
    """
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    kind = ends.schema["u"].dataType.simpleString()
    now = written(ends.mapInArrow(lambda batches: _forest(batches, at_once), f"u {kind}, v {kind}"), "edges")
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = now.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v >= u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large, "edges-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u")
        # A vertex that is its own minimum keeps a self-edge, so that it is not lost.
        small = small.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        now = written(small.distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
