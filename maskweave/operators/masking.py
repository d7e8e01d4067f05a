"""Masked copies of tables: one projection on top of the user's plan, so pushdown still works."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.functions import detect as D
from maskweave.functions import policy as P
from maskweave.functions import tokens as K
from maskweave.functions.nested import has_text, leaves, map_strings
from maskweave.functions.types import family, text_like
from maskweave.operators.jsonpaths import examined_leaves, mask_paths

# Attribute names whose value is never written to a log.
SENSITIVE_KEYS = (
    "sql", "statement", "query", "params", "param", "literal", "value", "values",
    "row", "rows", "token", "tokens", "request_id", "requestid", "passphrase",
    "password", "dsn", "secret", "body", "intent", "purpose",
)

# What each policy is called in an egress summary, in the order it is listed.
EGRESS_WORDS = ((P.REDACT, "redacted"), (P.TOKEN, "tokenized"), (P.SCAN, "scanned for PII spans"))


# Why a layer that was set up did not run.
NOT_EXAMINED = "free text was not examined, so its cells were redacted whole"
STALE_CATALOG = "the catalog is older than the tables"


@dataclass(frozen=True)
class ColumnPolicy:
    """What to do with one output column, and which layer decided it."""

    policy: str
    namespace: str = ""
    basis: str = "catalog"
    paths: dict[str, tuple[str, str]] = field(default_factory=dict)


UNKNOWN = ColumnPolicy(P.REDACT, basis="unknown")


@dataclass(frozen=True)
class Masking:
    """Settings of one masking run."""

    policies: dict[str, ColumnPolicy]
    key: K.Key | None = None
    detector: Callable[[Column], Column] | None = D.spans
    detection: str = "scan"
    floor: str = P.ALLOW
    fold: frozenset[str] = frozenset()
    hex_len: int = K.TAG_HEX


def resolve(settings: Masking, name: str, dtype: T.DataType, metadata: dict | None = None) -> ColumnPolicy:
    """The policy a column really gets: unknown ones redact, a token parameter raises whatever can
    carry text, and a token without a namespace cannot be made."""
    p = settings.policies.get(name, UNKNOWN)
    if p.policy not in P.POLICIES:
        p = replace(p, policy=P.REDACT, namespace="")
    order = P.POLICIES.index
    floor = P.REDACT if settings.floor in (P.TOKEN, P.REDACT) else settings.floor
    if order(floor) > order(p.policy) and text_like(family(dtype, metadata, elements=True)):
        p = replace(p, policy=floor, namespace="", basis="parameter")
    if p.policy == P.TOKEN and not p.namespace:
        p = replace(p, policy=P.REDACT)
    if p.policy == P.SCAN and p.basis == "catalog":
        p = replace(p, basis="rules")
    return p


def value_text(value: Column, dtype: T.DataType) -> Column:
    """Text that a token is made of. A whole number has one text, whatever its type, so that a key
    stored as a fraction in one table and as an integer in another still joins. A fraction with a
    fixed number of digits loses the zeros at its end, as a floating one has none."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        whole = value == F.floor(value)
        return (
            F.when(whole & (F.abs(value) < 9e18), value.cast("long").cast("string"))
            .when(whole & (F.abs(value) < 1e37), value.cast("decimal(38,0)").cast("string"))
            .otherwise(value.cast("string"))
        )
    if isinstance(dtype, T.DecimalType) and dtype.scale > 0:
        return F.regexp_replace(value.cast("string"), r"\.?0+$", "")
    return value if isinstance(dtype, T.StringType) else value.cast("string")


def mask_column(value: Column, dtype: T.DataType, p: ColumnPolicy, settings: Masking) -> Column:
    """Masked form of one column under a resolved policy. Null stays null."""
    marker = F.when(value.isNotNull(), F.lit(K.REDACTED))
    if p.paths:
        return mask_paths(
            value, p.paths, settings.key, settings.detection, settings.floor, settings.fold, settings.detector, settings.hex_len
        )
    if p.policy == P.TOKEN:
        if settings.key is None:
            return marker
        text = value_text(value, dtype)
        # Only text has forms to normalise; a number's text has no spaces and one spelling.
        normal = K.normalise(text, p.namespace in settings.fold) if isinstance(dtype, T.StringType) else text
        made = K.token(settings.key, p.namespace, normal, settings.hex_len)
        return F.when(value.isNotNull(), F.coalesce(made, F.lit(K.REDACTED)))
    is_text = text_like(family(dtype, elements=True))
    if p.policy in (P.ALLOW, P.SCAN):
        if not D.examines(p.policy, is_text, settings.detection) or not has_text(dtype):
            return value
        return scan_column(value, dtype, settings)
    return marker


def scan_column(value: Column, dtype: T.DataType, settings: Masking) -> Column:
    find = settings.detector
    if find is None or D.detection_reach(settings.detection) == "off":
        unseen = F.lit(None).cast(D.SPANS_TYPE)
        return map_strings(value, dtype, lambda s: D.redact_spans(s, unseen))
    return map_strings(value, dtype, lambda s: D.redact_spans(s, find(s)))


def mask(df: DataFrame, settings: Masking) -> DataFrame:
    """``df`` with every column masked by its policy; a column without one is redacted."""
    out = []
    for f in df.schema.fields:
        p = resolve(settings, f.name, f.dataType, f.metadata)
        out.append(mask_column(F.col(f"`{f.name}`"), f.dataType, p, settings).alias(f.name))
    return df.select(*out)


TRANSFORMS_SCHEMA = "position int, name string, policy string, namespace string, basis string"


def transforms(df: DataFrame, settings: Masking, collisions: DataFrame | None = None) -> DataFrame:
    """What happened to each output column: policy, namespace, basis, spans masked, collisions.

    One pass over the data counts the spans of all scanned columns, of every text inside arrays, maps, rows and JSON
    documents with paths. Columns that share a name become
    one row with the strictest policy and the summed counts. ``collisions`` has (name, collisions).
    """
    rows, counters = [], []
    for i, f in enumerate(df.schema.fields):
        p = resolve(settings, f.name, f.dataType, f.metadata)
        rows.append((i, f.name, p.policy, p.namespace if p.policy == P.TOKEN else "", p.basis))
        value = F.col(f"`{f.name}`")
        if p.paths:
            floor = P.REDACT if settings.floor in (P.TOKEN, P.REDACT) else settings.floor
            counters.append((i, _leaf_counts(examined_leaves(value, p.paths, settings.detection, floor), settings)))
        elif has_text(f.dataType) and D.examines(p.policy, text_like(family(f.dataType, elements=True)), settings.detection):
            plain = isinstance(f.dataType, T.StringType)
            counters.append((i, _span_counts(value, settings) if plain else _leaf_counts(leaves(value, f.dataType), settings)))
    spark = df.sparkSession
    meta = spark.createDataFrame(rows, TRANSFORMS_SCHEMA)
    if counters:
        sums = df.select(*(c.alias(f"c{i}") for i, c in counters)).agg(
            *(F.sum(f"c{i}.spans").alias(f"s{i}") for i, _ in counters),
            *(F.max(f"c{i}.failed").alias(f"f{i}") for i, _ in counters),
        )
        counted = sums.select(
            F.inline(
                F.array(
                    *(
                        F.struct(
                            F.lit(i).alias("position"), F.col(f"s{i}").alias("spans"),
                            F.coalesce(F.col(f"f{i}"), F.lit(False)).alias("failed"),
                        )
                        for i, _ in counters
                    )
                )
            )
        )
        meta = meta.join(counted, "position", "left")
    else:
        meta = meta.withColumn("spans", F.lit(None).cast("long")).withColumn("failed", F.lit(None).cast("boolean"))
    meta = meta.withColumn("basis", F.when(F.col("failed"), "unexamined").otherwise(F.col("basis")))
    report = merge_transforms(meta)
    if collisions is not None:
        report = report.join(collisions.groupBy("name").agg(F.sum("collisions").alias("collisions")), "name", "left")
    else:
        report = report.withColumn("collisions", F.lit(0).cast("long"))
    return report.withColumn("collisions", F.coalesce("collisions", F.lit(0)))


def _span_counts(text: Column, settings: Masking) -> Column:
    """Spans replaced in a text, and whether it had to be masked whole."""
    if settings.detector is None or D.detection_reach(settings.detection) == "off":
        found = F.lit(None).cast(D.SPANS_TYPE)
    else:
        found = settings.detector(text)

    def count(f: Column) -> Column:
        failed = D.spans_unusable(text, f)
        return F.struct(
            F.when(failed, F.lit(0)).otherwise(F.coalesce(F.size(f), F.lit(0))).cast("long").alias("spans"),
            failed.alias("failed"),
        )

    return D.once(found, count)


def _leaf_counts(texts: Column, settings: Masking) -> Column:
    """:func:`_span_counts` of all texts of an array."""
    start = F.struct(F.lit(0).cast("long").alias("spans"), F.lit(False).alias("failed"))

    def add(acc: Column, one: Column) -> Column:
        failed = acc["failed"] | F.coalesce(one["failed"], F.lit(False))
        return F.struct((acc["spans"] + F.coalesce(one["spans"], F.lit(0))).alias("spans"), failed.alias("failed"))

    return F.aggregate(F.transform(texts, lambda s: _span_counts(s, settings)), start, add)


def merge_transforms(meta: DataFrame) -> DataFrame:
    strength = F.struct(P.rank(F.col("policy")), -F.col("position"))
    best = F.max_by(F.struct("policy", "namespace", "basis"), strength)
    return (
        meta.groupBy("name")
        .agg(best.alias("b"), F.coalesce(F.sum("spans"), F.lit(0)).alias("spans"))
        .select("name", "b.policy", "b.namespace", "b.basis", "spans")
    )


def egress_summary(policies: DataFrame, by: list[str]) -> DataFrame:
    """How many columns are masked and how, as lines in a fixed order, per group of ``by``."""
    counts = policies.groupBy(*by).agg(
        *(F.count(F.when(F.col("policy") == p, 1)).alias(p) for p, _ in EGRESS_WORDS)
    )
    lines = F.array_compact(
        F.array(*(F.when(F.col(p) > 0, F.concat(F.col(p).cast("string"), F.lit(f" column(s) {w}"))) for p, w in EGRESS_WORDS))
    )
    return counts.select(*by, F.array_join(lines, "; ").alias("egress"))


def mask_attributes(attributes: Column) -> Column:
    """A log record's attributes with sensitive ones masked by name."""
    return F.transform_values(
        attributes,
        lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_KEYS), F.lit("[redacted]")).otherwise(v),
    )


def mask_attribute_tree(value: Column, dtype: T.DataType) -> Column:
    """:func:`mask_attributes` for a struct of any depth, by field name."""
    if isinstance(dtype, T.StructType):
        fields = []
        for f in dtype.fields:
            inner = value[f.name]
            if f.name.lower() in SENSITIVE_KEYS:
                fields.append(F.when(inner.isNotNull(), F.lit("[redacted]")).alias(f.name))
            else:
                fields.append(mask_attribute_tree(inner, f.dataType).alias(f.name))
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda v: mask_attribute_tree(v, dtype.elementType))
    if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType) and isinstance(dtype.valueType, T.StringType):
        return mask_attributes(value)
    return value


def degradations(report: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """One row per layer that was set up but did not run, so a narrower result never looks clean."""
    out = report.where(F.col("basis") == "unexamined").limit(1).select(
        F.lit("detector").alias("layer"),
        F.lit(NOT_EXAMINED).alias("reason"),
    )
    if fresh is not None:
        stale = fresh.where(~F.col("fresh")).limit(1).select(
            F.lit("catalog").alias("layer"), F.lit(STALE_CATALOG).alias("reason")
        )
        out = out.unionByName(stale)
    return out
