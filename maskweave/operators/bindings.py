"""Bindings: which value each token stands for, for how long, and who came first.

"First" needs an order, and a distributed job has none of its own: the caller names an order column,
and equal orders go to the smaller value, so the owner is the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.functions import policy as P
from maskweave.functions import tokens as K

TTL_SECONDS = 3600
BIND_KEYS = ["session", "token"]


def with_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows with the current key of their session. The key table has one row per session and version,
    so its size is measured by the optimiser at run time before it is broadcast."""
    current = keys.where("current").select("conn", "session", "version", "ipad", "opad")
    return df.join(current, ["conn", "session"], "left")


def mint(
    inputs: DataFrame, keys: DataFrame, now: Column, fold: frozenset[str] = frozenset(),
    ttl: int = TTL_SECONDS, hex_len: int = K.TAG_HEX, compose: bool = True,
) -> DataFrame:
    """Candidate bindings of input values: (session, conn, namespace, value, seq) in, with a token out.

    The stored value is normalised without folding case; the hashed one follows its namespace's rule.
    A row with a bad namespace, an empty connection or no key has no token, and is shown as the marker.
    """
    stored = K.normalise(F.col("value"), False, compose)
    keyed = with_keys(inputs, keys).withColumn("value", stored)
    folded = F.col("namespace").isin(*fold) if fold else F.lit(False)
    keyed = keyed.withColumn("normalised", F.when(folded, F.lower("value")).otherwise(F.col("value")))
    token = K.token(K.joined_key(), F.col("namespace"), F.col("normalised"), hex_len)
    valid = P.valid_namespace(F.col("namespace")) & (F.col("conn") != "")
    return keyed.select(
        "session", "conn", F.when(valid, token).alias("token"), "namespace", "value", "normalised",
        F.lit(P.TOKEN).alias("policy"), "version", "seq",
        (now + F.make_interval(secs=F.lit(ttl))).alias("expires"),
    )


def bind(candidates: DataFrame) -> DataFrame:
    """One binding per session and token: the first value keeps it.

    A repeated value extends the lifetime. Repeats are reduced map-side, so one value held by a third
    of the rows costs one row per partition in the shuffle.
    """
    same = candidates.where("token IS NOT NULL").groupBy(*BIND_KEYS, "namespace", "normalised").agg(
        F.min_by(F.struct("value", "conn", "policy", "version", "seq"), F.struct("seq", "value")).alias("b"),
        F.max("expires").alias("expires"),
    )
    first = F.min_by(F.struct("namespace", "normalised", "b", "expires"), F.struct("b.seq", "normalised"))
    return same.groupBy(*BIND_KEYS).agg(first.alias("o"), (F.count("*") - 1).alias("losers")).select(
        *BIND_KEYS, "o.namespace", "o.normalised", "o.b.value", "o.b.conn", "o.b.policy", "o.b.version",
        "o.b.seq", "o.expires", "losers",
    )


def collided(bindings: DataFrame) -> DataFrame:
    """Tokens that more than one value would share, with their owner: with 64-bit tags, next to none."""
    return bindings.where("losers > 0").select(*BIND_KEYS, F.struct("namespace", "normalised").alias("owner"))


def tokens_or_redacted(candidates: DataFrame, bindings: DataFrame) -> DataFrame:
    """Candidates with the text to show: the token, or the marker where another value owns it.

    The join side holds collided tokens only, so the optimiser broadcasts it when it has measured
    that it is small, and splits hot tokens when it is not.
    """
    joined = candidates.join(collided(bindings), BIND_KEYS, "left")
    mine = F.struct("namespace", "normalised")
    lost = F.col("owner").isNotNull() & (F.col("owner") != mine)
    return joined.withColumn("collision", lost).withColumn(
        "shown", F.when(lost, F.lit(K.REDACTED)).otherwise(F.coalesce("token", F.lit(K.REDACTED)))
    ).drop("owner")


def live(bindings: DataFrame, now: Column) -> DataFrame:
    """Bindings still in use: one that expires this moment is gone."""
    return bindings.where(F.col("expires") > now)


def without_sessions(rows: DataFrame, closed: DataFrame) -> DataFrame:
    """Rows of sessions that are still open. Apply it to new rows as well, so late work does not
    bring a closed session back."""
    return rows.join(closed.select("session").distinct(), "session", "left_anti")


def resolve(tokens: DataFrame, bindings: DataFrame, now: Column) -> DataFrame:
    """Value of each (session, conn, token); what does not resolve has the status ``stale_token``."""
    keys = ["session", "conn", "token"]
    b = live(bindings, now).select(*keys, F.struct("value", "policy", "namespace").alias("b"))
    return tokens.join(b, keys, "left").select(
        *[c for c in tokens.columns],
        F.col("b.value").alias("value"), F.col("b.policy").alias("policy"),
        F.when(F.col("b").isNull(), "stale_token").otherwise("ok").alias("status"),
    )


def refreshed(bindings: DataFrame, used: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Bindings with the lifetime of those just used starting again."""
    keys = ["session", "conn", "token"]
    hit = used.select(*keys).distinct().withColumn("used", F.lit(True))
    alive = F.col("expires") > now
    fresh = F.when(F.col("used") & alive, now + F.make_interval(secs=F.lit(ttl))).otherwise(F.col("expires"))
    return bindings.join(hit, keys, "left").withColumn("expires", fresh).drop("used")


def where_token(df: DataFrame, column: str, tokens: DataFrame, bindings: DataFrame, now: Column) -> DataFrame:
    """Rows of ``df`` whose value one of the tokens stands for; values never enter the statement text."""
    values = resolve(tokens, bindings, now).where("status = 'ok'").select(F.col("value").alias(column)).distinct()
    return df.join(values, column, "left_semi")


def by_version(tokens: DataFrame, keys: DataFrame) -> DataFrame:
    """Tokens with the key version they were made under and whether that version is the current one."""
    parsed = K.parse_token(F.col("token"))
    t = tokens.withColumn("p", parsed).withColumn("version", F.col("p.version").cast("int")).drop("p")
    k = keys.select("conn", "session", "version", "current")
    return t.join(k, ["conn", "session", "version"], "left").withColumn(
        "state", F.when(F.col("current"), "current").when(F.col("current").isNotNull(), "retained").otherwise("unknown")
    )
