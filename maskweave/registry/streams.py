"""Streaming queries run to completion over the given tables, beside their batch answer."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from maskweave.operators.masking import ColumnPolicy, Masking
from maskweave.registry.base import LOG, key, query, sql_token, table
from maskweave.streaming import streams as S
from maskweave.streaming.latest import LatestLog


def _folder(spark) -> str:
    """A new folder for a stream's state and output: below the cluster's checkpoint folder, which all executors see.
    Only a local session may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/maskweave-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="maskweave-stream-")


def _stream(spark, folder: str, name: str):
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet*")


@query("stream_mask_equals_batch", f"""
SELECT c_custkey, {sql_token('person', 'c_name')} AS c_name, '⟨redacted⟩' AS c_nationkey, '⟨redacted⟩' AS c_acctbal, c_mktsegment FROM customer
""")
def stream_mask_equals_batch(spark, folder):
    policies = {"c_custkey": ColumnPolicy("allow"), "c_name": ColumnPolicy("token", "person"), "c_mktsegment": ColumnPolicy("scan")}
    at = _folder(spark)
    masked = S.masked_stream(_stream(spark, folder, "customer"), Masking(policies, key=key(spark)))
    run = masked.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(masked.schema).parquet(f"{at}/out")


def _as_log(events):
    """Events as log records, in the shape a stream of them has."""
    return events.select(
        F.concat(F.lit("r"), F.floor(F.col("event_id") / 2).cast("long")).alias("id"), F.col("ts").cast("timestamp").alias("at"),
        F.col("event_id").alias("seq"), F.concat(F.lit("s"), "user_id").alias("session_id"), "event_type", "value",
    )


@query("stream_latest_record", f"""
WITH l AS ({LOG}) SELECT id, seq, session_id FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1
""")
def stream_latest_record(spark, folder):
    """Each micro-batch adds a run of its latest records; the latest of all is chosen on reading."""
    at = _folder(spark)
    latest = LatestLog(spark, f"{at}/log", ["id"], "seq")
    log = _as_log(_stream(spark, folder, "events"))
    S.upsert_log(log, latest).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return latest.read().select("id", "seq", "session_id")


@query("stream_day_folders", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS records FROM events GROUP BY ALL")
def stream_day_folders(spark, folder):
    at = _folder(spark)
    S.append_log(_as_log(_stream(spark, folder, "events")), f"{at}/out", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("records"))


def _binding_events(events):
    """Events as offers and questions: a view asks, anything else offers its user to a token of 64."""
    return events.select(
        F.concat(F.lit("session-"), F.col("user_id") % 8).alias("session"), F.concat(F.lit("t"), F.col("event_id") % 64).alias("token"),
        F.when(F.col("event_type") == "view", "resolve").otherwise("bind").alias("kind"), F.lit("user").alias("namespace"),
        F.concat(F.lit("u"), F.col("user_id") % 3).alias("value"), F.col("ts").cast("timestamp").alias("at"),
    )


# The binding of each token, event by event.
_BINDINGS = """
WITH RECURSIVE e AS (
  SELECT concat('session-', user_id % 8) AS session, concat('t', event_id % 64) AS token, CASE event_type WHEN 'view' THEN 'resolve' ELSE 'bind' END AS kind,
         concat('u', user_id % 3) AS value, epoch_us(ts) AS micros FROM events
), o AS (SELECT *, row_number() OVER (PARTITION BY session, token ORDER BY micros, kind, value) AS n FROM e),
s AS (
  SELECT DISTINCT session, token, CAST(0 AS BIGINT) AS n, '' AS kind, '' AS status, CAST(NULL AS VARCHAR) AS held, CAST(0 AS BIGINT) AS expires FROM o
  UNION ALL
  SELECT o.session, o.token, o.n, o.kind,
         CASE WHEN o.kind = 'resolve' THEN CASE WHEN s.expires > o.micros THEN 'ok' ELSE 'stale_token' END
              WHEN s.expires > o.micros AND s.held <> o.value THEN 'collision' ELSE 'bound' END,
         CASE WHEN s.expires > o.micros THEN s.held WHEN o.kind = 'bind' THEN o.value END,
         CASE WHEN s.expires > o.micros AND (o.kind = 'resolve' OR s.held = o.value) THEN o.micros + 86400000000
              WHEN s.expires > o.micros THEN s.expires WHEN o.kind = 'bind' THEN o.micros + 86400000000 ELSE 0 END
  FROM s JOIN o ON o.session = s.session AND o.token = s.token AND o.n = s.n + 1
)
SELECT session, token, kind, status, CASE WHEN status = 'ok' THEN held END AS value, count(*) AS n FROM s WHERE n > 0 GROUP BY ALL
"""


@query("stream_bindings", _BINDINGS)
def stream_bindings(spark, folder):
    at = _folder(spark)
    log = S.SessionLog(spark, f"{at}/log", ttl_seconds=86_400, delay_seconds=40 * 86_400)
    events = _binding_events(_stream(spark, folder, "events"))
    log.start(events).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return log.outcomes().groupBy("session", "token", "kind", "status", "value").agg(F.count("*").alias("n"))


@query("stream_session_end", """
WITH e AS (SELECT concat('session-', user_id % 8) AS session, ts AS "at", event_type FROM events),
     c AS (SELECT session, min("at") AS closed_at FROM e WHERE event_type = 'signup' AND session IN ('session-1', 'session-2') GROUP BY session)
SELECT session, count(CASE WHEN "at" >= closed_at AND NOT (event_type = 'signup' AND session IN ('session-1', 'session-2')) THEN 1 END) AS turned_away FROM e LEFT JOIN c USING (session) GROUP BY session
""")
def stream_session_end(spark, folder):
    at = _folder(spark)
    raw = _stream(spark, folder, "events")
    closing = F.when((F.col("event_type") == "signup") & F.col("session").isin("session-1", "session-2"), "close").otherwise(F.col("kind"))
    events = raw.select(
        F.concat(F.lit("session-"), F.col("user_id") % 8).alias("session"), F.concat(F.lit("t"), F.col("event_id") % 64).alias("token"),
        F.lit("bind").alias("kind"), F.lit("user").alias("namespace"), F.col("event_type").alias("value"), F.col("ts").cast("timestamp").alias("at"), "event_type",
    ).withColumn("kind", closing).drop("event_type")
    log = S.SessionLog(spark, f"{at}/log")
    log.start(events).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return log.outcomes().groupBy("session").agg(F.count(F.when(F.col("status") == "session_closed", 1)).alias("turned_away"))
