"""Masking, bindings and the activity log as streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from maskweave.operators.bindings import TTL_SECONDS
from maskweave.operators.masking import Masking, mask
from maskweave.sources.activity import with_day
from maskweave.streaming.latest import LatestLog


def masked_stream(stream: DataFrame, settings: Masking) -> DataFrame:
    """Rows masked as they arrive: the batch projection, unchanged and without state."""
    return mask(stream, settings)


EVENTS_SCHEMA = "session string, token string, kind string, namespace string, value string, at timestamp"
OUTCOME = ["session", "token", "kind", "value", "status", "at"]
_FOLD_SCHEMA = "session string, token string, kind string, namespace string, value string, status string, micros long, expires long"
_HELD = "held"


def _fold(frames: Iterator[pd.DataFrame], ttl: int) -> Iterator[pd.DataFrame]:
    """Outcomes of sorted events, a frame at a time, and the binding of each token that changed, as a last row of kind ``held``."""
    token, held, changed, last = None, None, False, 0
    names = [c.split()[0] for c in _FOLD_SCHEMA.split(", ")]

    def binding():
        return [(*token, _HELD, held[0], held[1], None, last, held[2])] if changed else []

    for frame in frames:
        out = []
        for e in frame.itertuples(index=False):
            if (e.session, e.token) != token:
                out += binding()
                token, held, changed = (e.session, e.token), None, False
            if e.kind == _HELD:
                held = (e.namespace, e.value, e.expires)
                continue
            alive = held is not None and held[2] > e.micros
            status, value = "bound", None
            if e.kind == "resolve":
                status, value = ("ok", held[1]) if alive else ("stale_token", None)
            elif alive and (held[0], held[1]) != (e.namespace, e.value):
                status = "collision"
            elif not alive:
                held = (e.namespace, e.value, 0)
            if status in ("ok", "bound"):
                held, changed, last = (held[0], held[1], max(held[2], e.micros + ttl * 1_000_000)), True, e.micros
            out.append((*token, e.kind, None, value, status, e.micros, 0))
        yield pd.DataFrame(out, columns=names)
    if changed:
        yield pd.DataFrame(binding(), columns=names)


def folded(events: DataFrame, held: DataFrame | None, ttl_seconds: int) -> DataFrame:
    """``bind`` and ``resolve`` events with a time, in the order of (time, kind, value) against the bindings held before.

    The rows of a token meet in one partition and are sorted there, which spills; the fold then keeps one binding and one
    Arrow batch. A stateful operator gets the rows of a key unsorted, so it would have to hold all of them first.
    """
    rows = events.select("session", "token", "kind", "namespace", "value", F.unix_micros("at").alias("micros"), F.lit(0).cast("long").alias("expires"))
    if held is not None:
        asked = rows.select("session", "token").distinct()
        same = [held[c].eqNullSafe(asked[c]) for c in ("session", "token")]
        before = held.join(asked, same[0] & same[1], "left_semi")
        rows = rows.unionByName(before.select("session", "token", F.lit(_HELD).alias("kind"), "namespace", "value", F.lit(0).cast("long").alias("micros"), "expires"))
    place = F.when(F.col("kind") == _HELD, 0).otherwise(1)
    ordered = rows.repartition("session", "token").sortWithinPartitions("session", "token", place, "micros", "kind", "value", "namespace")
    return ordered.mapInPandas(lambda frames: _fold(frames, ttl_seconds), _FOLD_SCHEMA)


def after_close(outcomes: DataFrame, closed: DataFrame) -> DataFrame:
    """Outcomes with everything at or after its session's end turned away. What such a session still holds is never shown
    again and goes when it expires."""
    over = F.col("closed_at").isNotNull() & (F.col("at") >= F.col("closed_at")) & ~F.col("kind").eqNullSafe("close")
    return (
        outcomes.join(closed.select("session", "closed_at"), "session", "left")
        .withColumn("status", F.when(over, "session_closed").otherwise(F.col("status")))
        .withColumn("value", F.when(over, F.lit(None).cast("string")).otherwise(F.col("value")))
        .drop("closed_at")
    )


class SessionLog:
    """Bindings and session ends as a stream, kept under ``path``: outcomes by batch, live bindings, closed sessions.

    The first value keeps its token, use extends its life, another value for the token is a collision. ``bind`` and
    ``resolve`` events are answered in the order of their time within a micro-batch, and batch after batch. An event more than
    ``delay_seconds`` older than the newest use of any binding has the status ``late``, one without a time ``untimed``,
    one of another kind ``unknown``; none of them changes a binding. Each batch writes the bindings that it
    changed; one that expired before any event that may still come is left out when runs are merged. Repeating a batch
    reads what was held before it and so gives the same tables.
    """

    def __init__(self, spark: SparkSession, path: str, ttl_seconds: int = TTL_SECONDS, delay_seconds: int = 86_400, fan: int = 8):
        self.spark, self.path, self.ttl, self.delay, self.fan = spark, path.rstrip("/"), ttl_seconds, delay_seconds, fan
        self.held = LatestLog(spark, f"{self.path}/held", ["session", "token"], "number", fan)
        self.closed = LatestLog(spark, f"{self.path}/closed", ["session"], "earliness", fan)

    def start(self, events: DataFrame) -> DataStreamWriter:
        return events.writeStream.foreachBatch(self.step).outputMode("append")

    def outcomes(self) -> DataFrame:
        """All outcomes so far, (session, token, kind, value, status, at)."""
        return self.spark.read.parquet(f"{self.path}/outcomes").select(*OUTCOME)

    def step(self, batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            ends = batch.where("kind = 'close' AND session IS NOT NULL AND at IS NOT NULL")
            self.closed.append(ends.select("session", F.col("at").alias("closed_at"), (-F.unix_micros("at")).alias("earliness")), number)
            held = self.held.read(before=number)  # the same when the batch is repeated
            horizon = None if held is None else held.agg(F.max("expires")).first()[0]
            horizon = None if horizon is None else horizon - (self.ttl + self.delay) * 1_000_000
            live = F.lit(True) if horizon is None else F.col("expires") > horizon
            late = F.lit(False) if horizon is None else F.unix_micros("at") < horizon
            status = (
                F.when(F.col("kind") == "close", "closed").when(~F.coalesce(F.col("kind").isin("bind", "resolve"), F.lit(False)), "unknown")
                .when(F.col("at").isNull(), "untimed").when(late, "late")
            )
            told = batch.withColumn("status", status)
            fold = folded(told.where("status IS NULL"), None if held is None else held.where(live), self.ttl)
            answered = fold.withColumn("at", F.timestamp_micros("micros"))
            others = told.where("status IS NOT NULL").select(
                "session", "token", "kind", "namespace", F.lit(None).cast("string").alias("value"), "status",
                F.unix_micros("at").alias("micros"), F.lit(0).cast("long").alias("expires"), "at",
            )
            rows = answered.unionByName(others).withColumn("part", F.when(F.col("status").isNull(), _HELD).otherwise("outcome"))
            work = f"{self.path}/work/batch={number}"
            rows.write.mode("overwrite").partitionBy("part").parquet(work)
            done = self.spark.read.schema(rows.schema).parquet(work)
            shown = after_close(done.where("part = 'outcome'").select(*OUTCOME), self.closed.read())
            shown.write.mode("overwrite").parquet(f"{self.path}/outcomes/batch={number}")
            changed = done.where(F.col("part") == _HELD).select("session", "token", "namespace", "value", "expires", F.lit(number).alias("number"))
            self.held.append(changed, number, live)
        finally:
            batch.unpersist()


def append_log(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The activity log as a stream: one folder per UTC day, each record written exactly once."""
    return (
        with_day(stream).writeStream.format("parquet").partitionBy("day")
        .option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    )


def upsert_log(stream: DataFrame, log: LatestLog) -> DataStreamWriter:
    """Keep the latest record of each key: an outcome replaces its intent. Bytes written follow the batch, not the
    table, and repeating a batch changes nothing."""
    return stream.writeStream.foreachBatch(log.append).outputMode("append")


def first_per_id(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Only the first record of each id, with state bounded by the watermark."""
    return stream.withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"])
