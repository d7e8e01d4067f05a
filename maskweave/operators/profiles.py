"""Sources a user can query: listing, lookup by id or name, and others that allow writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskweave.operators.triage import effective_reads, effective_writes


def listed(profiles: DataFrame, hosts: DataFrame) -> DataFrame:
    """Profiles with the settings really in force and their host, where there is one, by name."""
    h = hosts.select("host_id", F.col("name").alias("host"), "address")
    return (
        profiles.join(h, "host_id", "left")
        .withColumn("reads", effective_reads(F.col("reads")))
        .withColumn("writes", effective_writes(F.col("writes")))
        .orderBy("name", "id")
    )


def resolved(references: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profile id of each reference: an id, or a name only one profile has. An ambiguous name lists the
    ids, an unknown one gives none. ``matches`` of a hot name are counted, not joined."""
    ids = profiles.select(F.col("id").alias("ref"), F.col("id").alias("by_id"))
    named = profiles.groupBy(F.col("name").alias("ref")).agg(
        F.count("*").alias("matches"), F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("ids")
    )
    out = references.join(ids, "ref", "left").join(named, "ref", "left")
    found = F.coalesce("by_id", F.when(F.col("matches") == 1, F.col("ids")))
    status = F.when(found.isNotNull(), "ok").when(F.col("matches") > 1, "ambiguous").otherwise("unknown")
    return out.select(
        *references.columns, found.alias("id"), status.alias("status"),
        F.when(status == "ambiguous", F.col("ids")).alias("candidates"),
    )


def writers(profiles: DataFrame) -> DataFrame:
    """For each read-only profile, the names of those on the same host and database that allow writes.

    Writers are gathered once per database and then looked up, so profiles are not paired up."""
    where = ["host_id", "database"]
    allowed = profiles.where(F.col("writes").isin("ask", "allow"))
    named = allowed.groupBy(*where).agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("writers"))
    closed = profiles.where(~F.coalesce(F.col("writes").isin("ask", "allow"), F.lit(False)))
    return closed.join(named, where).select("id", "name", *where, "writers")
