"""The policy catalog: defaults, committed decisions, drift and listings, as joins on the column key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.functions import names as N
from maskweave.functions import policy as P
from maskweave.functions.types import BOOLEAN, DATETIME, NUMERIC, TEXT, UUID
from maskweave.sources.schema import KEY

MAX_CATEGORIES = 100
MAX_CATEGORY_BYTES = 32
KEYS = list(KEY)


def _entry(policy: str, namespace: str = "") -> Column:
    return F.struct(F.lit(policy).alias("policy"), F.lit(namespace).alias("namespace"))


def categorical(distinct: Column, avg_width: Column) -> Column:
    """Few and short values, like a status or a tier. The width counts whole bytes, rounded down."""
    width = F.floor(avg_width)
    few = (distinct > 0) & (distinct <= MAX_CATEGORIES) & (width > 0) & (width <= MAX_CATEGORY_BYTES)
    return F.coalesce(few, F.lit(False))


def default_entry(kind: Column, name: Column, family: Column, distinct: Column, avg_width: Column) -> Column:
    """Policy and namespace of a column nobody has decided on.

    The order matters: a view hides what it was made from, so it comes first; a name that says
    personal data goes before the type; a credential is never recognised inside text, so its name
    goes before the statistics.
    """
    named = F.coalesce(N.contact_rule(name), N.personal_rule(name))
    return (
        F.when(kind.isin("v", "m"), _entry(P.REDACT))
        .when(named.isNotNull(), N.token_if_text(named, family))
        .when(family.isin(NUMERIC, BOOLEAN, DATETIME, UUID), _entry(P.ALLOW))
        .when((family == TEXT) & (N.secret_name(name) | (F.lower(name) == "name")), _entry(P.REDACT))
        .when((family == TEXT) & categorical(distinct, avg_width), _entry(P.SCAN))
        .otherwise(_entry(P.REDACT))
    )


def classify(columns: DataFrame, stats: DataFrame) -> DataFrame:
    """Default entry of every column."""
    joined = columns.join(stats, KEYS, "left")
    entry = default_entry(*(F.col(c) for c in ("kind", "column", "family", "distinct", "avg_width")))
    return joined.withColumn("entry", entry).select(*KEYS, "entry.policy", "entry.namespace")


def overlay(columns: DataFrame, stats: DataFrame, committed: DataFrame) -> DataFrame:
    """Defaults of the columns without a committed entry. Always recomputed, so no old rule survives."""
    return classify(columns.join(committed.select(*KEYS), KEYS, "left_anti"), stats)


def merged(committed: DataFrame, over: DataFrame) -> DataFrame:
    """Committed and automatic entries in one view; where both exist the automatic one wins."""
    c = committed.select(*KEYS, F.struct("policy", "namespace").alias("c"))
    o = over.select(*KEYS, F.struct("policy", "namespace").alias("o"))
    return c.join(o, KEYS, "full").select(
        *KEYS,
        F.coalesce("o.policy", "c.policy").alias("policy"),
        F.coalesce("o.namespace", "c.namespace").alias("namespace"),
        F.when(F.col("o").isNotNull(), "auto").otherwise("committed").alias("source"),
    )


def commit(committed: DataFrame, over: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Committed and overlay tables after a person has decided on ``entries``."""
    decided = entries.select(*KEYS, "policy", "namespace")
    keys = decided.select(*KEYS)
    kept = committed.select(*KEYS, "policy", "namespace").join(keys, KEYS, "left_anti")
    return kept.unionByName(decided), over.join(keys, KEYS, "left_anti")


def raise_entries(committed: DataFrame, over: DataFrame, wanted: DataFrame) -> DataFrame:
    """Overlay with entries made stricter: never over a committed decision, and never weaker."""
    asked = wanted.select(*KEYS, F.struct("policy", "namespace").alias("w")).join(committed.select(*KEYS), KEYS, "left_anti")
    old = over.select(*KEYS, F.struct("policy", "namespace").alias("o"))
    stricter = F.coalesce(P.rank(F.col("w.policy")), F.lit(-1)) > F.coalesce(P.rank(F.col("o.policy")), F.lit(-1))
    chosen = F.when(F.col("w").isNotNull() & stricter, F.col("w")).otherwise(F.col("o"))
    return (
        old.join(asked, KEYS, "full").withColumn("e", chosen).where(F.col("e").isNotNull())
        .select(*KEYS, "e.policy", "e.namespace")
    )


def unclassified(columns: DataFrame, entries: DataFrame) -> DataFrame:
    return columns.join(entries.select(*KEYS), KEYS, "left_anti")


def policy_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("policy").agg(F.count("*").alias("columns"))


def lookup(requested: DataFrame, entries: DataFrame, system: DataFrame | None = None) -> DataFrame:
    """Entry of each requested column; a column nobody knows is redacted with the basis ``unknown``."""
    e = entries.select(*KEYS, F.struct("policy", "namespace", F.lit("catalog").alias("basis")).alias("e"))
    out = requested.join(e, KEYS, "left")
    sources = ["e"]
    if system is not None:
        s = system.select(*KEYS, F.struct("policy", "namespace", F.lit("catalog").alias("basis")).alias("s"))
        out = out.join(s, KEYS, "left")
        sources.append("s")
    miss = F.struct(F.lit(P.REDACT).alias("policy"), F.lit("").alias("namespace"), F.lit("unknown").alias("basis"))
    found = F.coalesce(*(F.col(c) for c in sources), miss)
    return out.withColumn("f", found).drop(*sources).select("*", "f.policy", "f.namespace", "f.basis").drop("f")


def system_entries(columns: DataFrame, protected: DataFrame, scalars: tuple[str, ...] = ()) -> DataFrame:
    """Entries of catalog tables, which describe data: names, counts and states show, and a list of
    text columns that can carry a value from elsewhere does not. ``scalars`` are further types allowed."""
    listed = protected.select("relation", "column").distinct().withColumn("listed", F.lit(True))
    out = columns.join(listed, ["relation", "column"], "left")
    plain_text = (F.col("family") == TEXT) & ~F.col("type").isin("json", "jsonb", "variant")
    policy = (
        F.when(F.col("listed"), F.lit(P.REDACT))
        .when(F.col("family").isin(NUMERIC, BOOLEAN, DATETIME, UUID) | plain_text, F.lit(P.ALLOW))
        .when(F.col("type").isin(*scalars) if scalars else F.lit(False), F.lit(P.ALLOW))
        .otherwise(F.lit(P.REDACT))
    )
    return out.select(*KEYS, policy.alias("policy"), F.lit("").alias("namespace"))


def validate(entries: DataFrame) -> DataFrame:
    """Entries with a ``reason`` why each cannot be used; null when it can."""
    return entries.withColumn("reason", P.invalid_entry_reason(F.col("policy"), F.col("namespace"), F.col("paths")))


def as_known(entries: DataFrame) -> DataFrame:
    return entries.select(
        *KEYS,
        P.known(F.col("policy")).alias("policy"),
        P.known_namespace(F.col("policy"), F.col("namespace")).alias("namespace"),
        P.known_paths(F.col("paths")).alias("paths"),
    )


def fingerprints(columns: DataFrame, wide: bool = False, definitions: DataFrame | None = None) -> DataFrame:
    """SHA-256 of each relation's shape: kind and ordered columns.

    The wide form adds nullability, identity and defaults, and the text that defines a view. A
    relation's columns are the unit here, so one row per relation is a bounded group.
    """
    parts = [F.col("position").cast("string"), F.col("column"), F.col("type")]
    if wide:
        parts += [F.col(c).cast("string") for c in ("nullable", "is_identity", "has_default")]
    shape = F.struct("position", F.concat_ws(":", *parts).alias("text"))
    out = columns.groupBy("schema", "relation").agg(
        F.max("kind").alias("kind"), F.array_sort(F.collect_list(shape)).alias("shapes")
    )
    body = F.array_join(F.transform("shapes", lambda s: s["text"]), "|")
    text = F.concat(F.lit("kind:"), F.col("kind"), F.lit("|"), body)
    if wide:
        if definitions is not None:
            out = out.join(definitions, ["schema", "relation"], "left")
        else:
            out = out.withColumn("definition", F.lit(None).cast("string"))
        text = F.concat(text, F.lit("\n"), F.when(F.col("kind").isin("v", "m"), F.coalesce("definition", F.lit(""))).otherwise(""))
    return out.select("schema", "relation", F.sha2(text, 256).alias("fingerprint"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Status of every relation between two snapshots. Only ``same`` is fresh: a missing fingerprint is
    never taken for an unchanged one."""
    a = old.select("schema", "relation", F.col("fingerprint").alias("old"), F.lit(True).alias("in_old"))
    b = new.select("schema", "relation", F.col("fingerprint").alias("new"), F.lit(True).alias("in_new"))
    status = (
        F.when(F.col("in_old").isNull(), "new")
        .when(F.col("in_new").isNull(), "gone")
        .when(F.col("old") == F.col("new"), "same")
        .otherwise("changed")
    )
    out = a.join(b, ["schema", "relation"], "full").select("schema", "relation", status.alias("status"))
    return out.withColumn("fresh", F.col("status") == "same")


def masked_automatically(result_columns: DataFrame, entries: DataFrame, by: list[str]) -> DataFrame:
    """Per result, whether any of its columns was masked by an automatic entry or by having none."""
    e = entries.select(*KEYS, "policy", "source")
    auto = F.col("policy").isNull() | ((F.col("source") == "auto") & (F.col("policy") != P.ALLOW))
    return result_columns.join(e, KEYS, "left").groupBy(*by).agg(F.max(auto).alias("auto_masked"))


def listing(columns: DataFrame, entries: DataFrame, contains: str = "") -> DataFrame:
    """Catalog rows with undecided columns first, then by key; filtered by a part of the key."""
    undecided = unclassified(columns, entries).select(*KEYS, F.lit(None).cast("string").alias("policy"), F.lit("").alias("namespace"))
    rows = undecided.unionByName(entries.select(*KEYS, "policy", "namespace"))
    rows = rows.withColumn("key", F.concat_ws(".", *KEYS))
    if contains:
        rows = rows.where(F.contains(F.lower("key"), F.lit(contains.lower())))
    return rows.orderBy(F.col("policy").isNotNull(), "key")


def describe(columns: DataFrame, entries: DataFrame, drifted: DataFrame, backlog: int = 20) -> DataFrame:
    """One source at a glance as (section, name, value) rows: counts by policy, schemas, freshness and
    the first columns of the backlog."""
    def section(df: DataFrame, title: str, name: Column, value: Column) -> DataFrame:
        return df.select(F.lit(title).alias("section"), name.cast("string").alias("name"), value.cast("string").alias("value"))

    counts = section(policy_counts(entries), "policy", F.col("policy"), F.col("columns"))
    schemas = section(columns.groupBy("schema").agg(F.count_distinct("relation").alias("n")), "schema", F.col("schema"), F.col("n"))
    fresh = section(
        drifted.agg(F.coalesce(F.min("fresh"), F.lit(False)).alias("fresh")), "fresh", F.lit("all"), F.col("fresh")
    )
    todo = unclassified(columns, entries).select(F.concat_ws(".", *KEYS).alias("key")).orderBy("key").limit(backlog)
    return reduce(DataFrame.unionByName, [counts, schemas, fresh, section(todo, "backlog", F.col("key"), F.lit(""))])


def trusted_policy(policy: Column, path_count: Column) -> Column:
    """Policy a computed value may rely on: an allowed column with declared paths hides parts of itself."""
    return F.when((policy == P.ALLOW) & (path_count > 0), F.lit(P.REDACT)).otherwise(policy)


def parse_key(key: Column) -> Column:
    """Key parts of ``schema.relation.column``; a dot in the column name survives. Null if a part is missing."""
    parts = F.split(key, "\\.", 3)
    good = (F.size(parts) == 3) & ~F.exists(parts, lambda p: p == "")
    return F.when(
        good,
        F.struct(
            F.get(parts, F.lit(0)).alias("schema"), F.get(parts, F.lit(1)).alias("relation"), F.get(parts, F.lit(2)).alias("column")
        ),
    )


def overlay_changed(before: DataFrame, after: DataFrame) -> bool:
    """Whether a recomputed overlay has to be written at all."""
    cols = [*KEYS, "policy", "namespace"]
    a, b = before.select(*cols), after.select(*cols)
    return not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())
