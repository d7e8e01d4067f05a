"""Propose policies from sampled values: how large a share of a column's sample holds an identifier."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.functions import detect as D
from maskweave.functions import names as N
from maskweave.functions.types import NUMERIC, TEXT
from maskweave.operators.catalog import KEYS

# The share of samples that makes a token, and why a column has no proposal.
TOKEN_THRESHOLD = 0.90
NOT_EXAMINED = "sampled values could not be examined, so their columns have no proposal"


def sample_rates(samples: DataFrame, detector: Callable[[Column], Column] = D.spans) -> DataFrame:
    """Per column: the kind found in most values, its share, and whether all samples were examined.

    Each kind counts once per value. Ties go to the smaller name.
    """
    # One pass: a row per value that says whether it was examined, and one per kind found in it.
    told = "array<struct<whole: boolean, entity: string, examined: boolean>>"

    def answers(spans: Column) -> Column:
        kinds = F.transform(F.array_distinct(F.transform(spans, lambda s: s["type"])), lambda k: F.struct(F.lit(False), k, F.lit(True)))
        value = F.array(F.struct(F.lit(True), F.lit(None).cast("string"), spans.isNotNull()))
        return F.concat(value.cast(told), F.coalesce(kinds.cast(told), F.array().cast(told)))

    rows = samples.select(*KEYS, F.inline(D.once(detector(F.col("value")), answers)))
    counted = rows.groupBy(*KEYS, "whole", "entity").agg(F.count("*").alias("hits"), F.min("examined").alias("examined"))
    best = F.min(F.when(~F.col("whole"), F.struct((-F.col("hits")).alias("less"), "entity")))
    per_column = counted.groupBy(*KEYS).agg(
        F.max(F.when(F.col("whole"), F.col("hits"))).alias("n"), F.min("examined").alias("examined"), best.alias("best")
    )
    return per_column.select(
        *KEYS, "n", "examined", F.coalesce("best.entity", F.lit("")).alias("entity"),
        (F.coalesce(-F.col("best.less"), F.lit(0)) / F.col("n")).alias("rate"),
    )


def propose(columns: DataFrame, rates: DataFrame) -> DataFrame:
    """Proposed entry, bucket (``safe`` or ``review``) and rate per column.

    A column whose samples were not examined gets no row: it must not read as found clean.
    """
    r = rates.select(*KEYS, "examined", "entity", "rate")
    joined = columns.join(r, KEYS, "left")
    name, fam = F.col("column"), F.col("family")
    personal = N.personal_rule(name)
    rate, entity = F.coalesce("rate", F.lit(0.0)), F.coalesce("entity", F.lit(""))
    is_json = F.col("type").isin("json", "jsonb", "variant")
    enough = (rate >= TOKEN_THRESHOLD) & (entity != "")
    is_key = F.col("is_pk") | F.col("is_fk") | F.col("is_identity") | F.col("has_default")
    sampled = (fam == TEXT) & ~is_json | (fam == NUMERIC)

    def row(bucket: str, policy: str, namespace: Column | None = None, shown: Column | None = None) -> Column:
        ns = F.lit("") if namespace is None else namespace
        return F.struct(
            F.lit(bucket).alias("bucket"), F.lit(policy).alias("policy"), ns.alias("namespace"),
            (F.lit(None).cast("double") if shown is None else shown).alias("sample_rate"),
        )

    some = F.when(rate > 0, rate)
    outcome = (
        F.when(
            personal.isNotNull(),
            F.struct(
                F.lit("review").alias("bucket"), personal["policy"].alias("policy"),
                personal["namespace"].alias("namespace"), F.lit(None).cast("double").alias("sample_rate"),
            ),
        )
        .when((fam == TEXT) & is_json, row("review", "scan"))
        .when(sampled & ~F.coalesce("examined", F.lit(True)), F.lit(None))
        .when((fam == TEXT) & enough, row("safe", "token", entity, some))
        .when(fam == TEXT, row("review", "scan", None, some))
        .when((fam == NUMERIC) & enough & ~is_key, row("safe", "token", entity, rate))
        .when((fam == NUMERIC) & enough, row("safe", "allow", None, rate))
        .otherwise(row("safe", "allow"))
    )
    return joined.withColumn("p", outcome).where(F.col("p").isNotNull()).select(*KEYS, "p.*")


def degradations(rates: DataFrame) -> DataFrame:
    """One row when any column's samples could not be examined, and none otherwise."""
    return (
        rates.agg(F.max(~F.col("examined")).alias("bad")).where("bad")
        .select(
            F.lit("detector").alias("layer"),
            F.lit(NOT_EXAMINED).alias("reason"),
        )
    )
