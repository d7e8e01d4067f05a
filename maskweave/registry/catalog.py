"""Sources, the policy catalog, drift, proposals and listings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from maskweave.functions import names as N
from maskweave.functions import policy as P
from maskweave.operators import catalog as C
from maskweave.operators import profiles as R
from maskweave.operators import propose as O
from maskweave.registry.base import (
    COMMITTED, ESTATE, HOSTS, OVERLAY, PROFILES, STATS, TABLES, WANTED, derived, query, table, with_tables,
)
from maskweave.session import cut_lineage, shared_folder
from maskweave.sources import policies as SP
from maskweave.sources import schema as SS
from maskweave.sources import statistics as ST

KEYS = list(SS.KEY)
TEXT_COLUMNS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"], "documents": ["text", "lang", "source"],
    "pages": ["url", "html"], "benchmark": ["text"], "conversations": ["role", "text"],
}
_SHAPES = "\nUNION ALL ".join(
    f"SELECT 'main' AS schema, '{t}' AS relation, '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS DOUBLE) AS \"distinct\", avg(strlen({c})) AS avg_width FROM {t}"
    for t, cols in TEXT_COLUMNS.items() for c in cols
)


def _all(spark, folder):
    return {name: table(spark, folder, name) for name in TABLES}


def _words(words) -> str:
    """The name matcher as four plain comparisons, for the SQL side."""
    return "(" + " OR ".join(
        f"lower(\"column\") = '{w}' OR starts_with(lower(\"column\"), '{w}_') OR ends_with(lower(\"column\"), '_{w}') OR contains(lower(\"column\"), '_{w}_')"
        for w in words
    ) + ")"


def _named(pick: int, rules) -> str:
    return " ".join(f"WHEN {_words(rule[0])} THEN '{rule[pick]}'" for rule in rules)


_BY_NAME = f"CASE {_named(1, N.CONTACT_RULES)} {_named(1, N.PERSONAL_RULES)} END"
_NS_BY_NAME = f"CASE {_named(2, N.CONTACT_RULES)} {_named(2, N.PERSONAL_RULES)} ELSE '' END"
CLASSIFIED = f"""
SELECT schema, relation, "column", CASE
    WHEN kind IN ('v', 'm') THEN 'redact'
    WHEN named IS NOT NULL THEN CASE WHEN named = 'token' AND family <> 'text' THEN 'redact' ELSE named END
    WHEN family IN ('numeric', 'boolean', 'datetime', 'uuid') THEN 'allow'
    WHEN family = 'text' AND (secret OR lower("column") = 'name') THEN 'redact'
    WHEN family = 'text' AND "distinct" BETWEEN 1 AND 100 AND floor(avg_width) BETWEEN 1 AND 32 THEN 'scan'
    ELSE 'redact' END AS policy,
  CASE WHEN kind NOT IN ('v', 'm') AND named = 'token' AND family = 'text' THEN ns ELSE '' END AS namespace
FROM (SELECT e.*, s."distinct", s.avg_width, {_BY_NAME} AS named, {_NS_BY_NAME} AS ns, {_words(N.SECRET_WORDS)} AS secret
      FROM e LEFT JOIN s USING (schema, relation, "column"))
"""


@query("source_columns", with_tables("""
SELECT c.relation, c."column", c.position, c.family, n.n AS rows FROM c JOIN n USING (relation)
""", c="""SELECT table_name AS relation, column_name AS "column", CAST(ordinal_position AS INT) AS position,
  CASE WHEN data_type LIKE '%[]' THEN 'unknown' WHEN data_type = 'VARCHAR' THEN 'text' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'numeric' END AS family
  FROM information_schema.columns WHERE table_name IN (""" + ", ".join(f"'{t}'" for t in TABLES) + ")",
    n=" UNION ALL ".join(f"SELECT '{t}' AS relation, count(*) AS n FROM {t}" for t in TABLES)))
def source_columns(spark, folder):
    tables = _all(spark, folder)
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("relation"), "rows") for n, df in tables.items()]
    n = counts[0]
    for c in counts[1:]:
        n = n.unionByName(c)
    return SS.columns_of(spark, tables).select("relation", "column", "position", "family").join(n, "relation")


@query("source_sample", """
(SELECT 'lang' AS "column", lang AS value FROM documents WHERE lang IS NOT NULL ORDER BY doc_id DESC LIMIT 10000)
UNION ALL (SELECT 'n_chars', CAST(n_chars AS VARCHAR) FROM documents WHERE n_chars IS NOT NULL ORDER BY doc_id DESC LIMIT 10000)
""")
def source_sample(spark, folder):
    out = SS.sample_columns(table(spark, folder, "documents"), ["lang", "n_chars"], 10_000, order=[F.desc("doc_id")])
    return out.select("column", "value")


@query("text_shapes", _SHAPES)
def text_shapes(spark, folder):
    return SS.text_stats(_all(spark, folder), exact=True)


@query("text_shapes_sketched", f"""
SELECT relation, "column", "distinct" BETWEEN 1 AND 100 AND floor(avg_width) BETWEEN 1 AND 32 AS categorical, CASE WHEN "distinct" <= 100 THEN "distinct" END AS few, round(avg_width, 6) AS avg_width
FROM ({_SHAPES})
""")
def text_shapes_sketched(spark, folder):
    """Statistics from sketches, counted exactly near the bound of the categorical test."""
    stats = ST.settled(_all(spark, folder), C.MAX_CATEGORIES)
    few = F.col("distinct") <= C.MAX_CATEGORIES
    return stats.select(
        "relation", "column", C.categorical(F.col("distinct"), F.col("avg_width")).alias("categorical"),
        F.when(few, F.col("distinct")).alias("few"), F.round("avg_width", 6).alias("avg_width"),
    )


# Events by day, orders by the first day of their month.
_DAYS = {"events": ("ts", "day", ["event_type"]), "orders": ("o_orderdate", "month", ["o_orderstatus", "o_orderpriority"])}


@query("text_sketch_days", "\nUNION ALL ".join(
    f"""SELECT '{t}' AS relation, '{c}' AS "column", CAST(CAST(date_trunc('{unit}', {day}) AS DATE) AS VARCHAR) AS day, CAST(count(DISTINCT {c}) AS DOUBLE) AS "distinct", round(avg(strlen({c})), 6) AS avg_width
FROM {t} GROUP BY GROUPING SETS ((CAST(date_trunc('{unit}', {day}) AS DATE)), ())""" for t, (day, unit, cols) in _DAYS.items() for c in cols))
def text_sketch_days(spark, folder):
    """Sketches stored by day, some of the days twice, then merged to days and to whole columns."""
    at = f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}"
    found = []
    for t, (day, unit, cols) in _DAYS.items():
        df = table(spark, folder, t)
        found.append(ST.sketches(df, t, F.date_trunc(unit, F.col(day)), columns=cols))
    everything = found[0].unionByName(found[1])
    ST.stored(everything, at)
    ST.stored(everything.where((F.dayofmonth("day") > 20) | (F.month("day") > 10)), at)
    kept = spark.read.schema(everything.schema).parquet(at)
    days = ST.merged(kept, "day").withColumn("day", F.col("day").cast("string"))
    out = days.unionByName(ST.merged(kept).withColumn("day", F.lit(None).cast("string")))
    return out.select("relation", "column", "day", "distinct", F.round("avg_width", 6).alias("avg_width"))


_LISTED = ("customer", "orders", "events")


@query("session_columns", f"""
WITH c AS (SELECT * FROM (SELECT table_name AS relation, 'r' AS kind, column_name AS "column", CAST(ordinal_position AS INT) AS position, data_type FROM information_schema.columns WHERE table_name IN {_LISTED}
  UNION ALL SELECT 'wealthy', 'v', column_name, CASE column_name WHEN 'c_custkey' THEN 1 ELSE 2 END, data_type FROM information_schema.columns WHERE table_name = 'customer' AND column_name IN ('c_custkey', 'c_name')))
SELECT relation, kind, "column", position, CASE WHEN data_type LIKE '%[]' THEN 'unknown' WHEN data_type = 'VARCHAR' THEN 'text' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'numeric' END AS family,
       CASE relation WHEN 'customer' THEN (SELECT count(*) FROM customer) WHEN 'orders' THEN (SELECT count(*) FROM orders) WHEN 'events' THEN (SELECT count(*) FROM events) ELSE (SELECT count(*) FROM customer WHERE c_acctbal > 0) END AS rows FROM c
""")
def session_columns(spark, folder):
    """Tables over the given files and a view, listed from the session's catalog."""
    name = f"listed_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name}")
    try:
        for t in _LISTED:
            spark.sql(f"CREATE TABLE {name}.{t} USING parquet LOCATION '{folder}/{t}.parquet'")
        spark.sql(f"CREATE VIEW {name}.wealthy AS SELECT c_custkey, c_name FROM {name}.customer WHERE c_acctbal > 0")
        columns = SS.session_columns(spark, name)
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")  # the files stay, the tables only point at them
    wealthy = table(spark, folder, "customer").where("c_acctbal > 0")
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("relation"), "rows") for n, df in [("wealthy", wealthy)] + [(t, table(spark, folder, t)) for t in _LISTED]]
    n = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])
    return columns.select("relation", "kind", "column", "position", "family").join(n, "relation")


@query("schema_view", with_tables("""
SELECT schema, relation, "column", coalesce(policy, 'redact') AS policy, coalesce(namespace, '') AS namespace, p_size < 40 AS readable
FROM e LEFT JOIN c USING (schema, relation, "column") WHERE lower(schema) = 's1' AND starts_with(lower(relation), 'promo')
""", e=ESTATE, c=COMMITTED))
def schema_view(spark, folder):
    e = derived(spark, folder, ESTATE)
    view = SS.schema_view(e, derived(spark, folder, COMMITTED), "S1", "Promo*", e.where("p_size < 40"))
    return view.select(*KEYS, "policy", "namespace", "readable")


@query("readable_columns", with_tables("""
SELECT schema, relation, "column" FROM e WHERE p_size BETWEEN 10 AND 30
""", e=ESTATE))
def readable_columns(spark, folder):
    e = derived(spark, folder, ESTATE)
    role = F.when(F.col("p_size").between(10, 30), "analyst").otherwise("owner")
    return SS.readable_columns(e, e.select(role.alias("role"), *KEYS), "analyst").select(*KEYS)


_ENTRIES = f"""
SELECT schema, relation, "column", CASE WHEN p_size > 45 THEN 'approve' WHEN p_size > 30 THEN 'token' WHEN p_size > 20 THEN 'scan' ELSE 'allow' END AS policy,
       CASE WHEN p_size > 30 AND p_size < 42 THEN 'email' WHEN p_size < 4 THEN 'spare' ELSE '' END AS namespace,
       CASE WHEN p_size BETWEEN 10 AND 15 THEN 'tokenise' WHEN p_size BETWEEN 16 AND 20 THEN 'token' WHEN p_size BETWEEN 21 AND 25 THEN 'allow' END AS path_policy
FROM ({ESTATE}) e
"""


def _entries(spark, folder):
    e = derived(spark, folder, _ENTRIES)
    entry = F.struct(F.col("path_policy").alias("policy"), F.lit("").alias("namespace"))
    none = F.create_map().cast("map<string, struct<policy: string, namespace: string>>")
    return e.withColumn("paths", F.when(F.col("path_policy").isNull(), none).otherwise(F.create_map(F.lit("$.a"), entry)))


_KNOWN = """
SELECT schema, relation, "column", CASE WHEN policy IN ('allow', 'scan', 'token', 'redact') THEN policy ELSE 'redact' END AS policy,
       CASE WHEN policy IN ('allow', 'scan', 'token', 'redact') THEN namespace ELSE '' END AS namespace,
       CASE WHEN path_policy = 'tokenise' THEN 'redact' ELSE path_policy END AS path_policy FROM t
"""


@query("policy_file", with_tables(_KNOWN, t=_ENTRIES))
def policy_file(spark, folder):
    """Entries nested into file form, as JSON text, and read back."""
    from pyspark.sql import types as T

    files = SP.nest(_entries(spark, folder)).select(F.to_json(F.struct("*")).alias("file"))
    parsed = files.select(F.from_json("file", T._parse_datatype_string(SP.FILE_SCHEMA)).alias("f")).select("f.*")
    return SP.flatten(parsed).select(*KEYS, "policy", "namespace", F.col("paths")["$.a"]["policy"].alias("path_policy"))


@query("policy_known", with_tables(_KNOWN, t=_ENTRIES))
def policy_known(spark, folder):
    return C.as_known(_entries(spark, folder)).select(*KEYS, "policy", "namespace", F.col("paths")["$.a"]["policy"].alias("path_policy"))


@query("policy_validate", with_tables("""
SELECT schema, relation, "column", CASE WHEN policy = 'approve' THEN 'unknown policy approve' WHEN policy = 'token' AND namespace = '' THEN 'token requires a namespace'
  WHEN policy <> 'token' AND namespace <> '' THEN 'namespace applies to token only' WHEN path_policy = 'tokenise' THEN '$.a: unknown policy tokenise'
  WHEN path_policy = 'token' THEN '$.a: token requires a namespace' END AS reason FROM t
""", t=_ENTRIES))
def policy_validate(spark, folder):
    return C.validate(_entries(spark, folder)).select(*KEYS, "reason")


@query("source_profiles", with_tables("""
SELECT id, name, database, coalesce(host, '') AS host, CASE WHEN reads = '' THEN 'uncertain' WHEN reads IN ('always', 'uncertain', 'never') THEN reads ELSE 'always' END AS reads,
       CASE WHEN writes IN ('ask', 'allow') THEN writes ELSE 'off' END AS writes
FROM p LEFT JOIN (SELECT host_id, name AS host FROM h) USING (host_id)
""", p=PROFILES, h=HOSTS))
def source_profiles(spark, folder):
    out = R.listed(derived(spark, folder, PROFILES), derived(spark, folder, HOSTS))
    return out.select("id", "name", "database", F.coalesce("host", F.lit("")).alias("host"), "reads", "writes")


@query("classify_defaults", with_tables(CLASSIFIED,
    e="""SELECT 'main' AS schema, table_name AS relation, 'r' AS kind, column_name AS "column",
  CASE WHEN data_type LIKE '%[]' THEN 'unknown' WHEN data_type = 'VARCHAR' THEN 'text' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'numeric' END AS family
  FROM information_schema.columns WHERE table_name IN (""" + ", ".join(f"'{t}'" for t in TABLES) + ")", s=_SHAPES))
def classify_defaults(spark, folder):
    tables = _all(spark, folder)
    return C.classify(SS.columns_of(spark, tables), ST.settled(tables, C.MAX_CATEGORIES))


@query("classify_estate", with_tables(CLASSIFIED, e=ESTATE, s=STATS))
def classify_estate(spark, folder):
    return C.classify(derived(spark, folder, ESTATE), derived(spark, folder, STATS))


@query("name_rules", with_tables(f"""
SELECT schema, relation, "column", CASE {_named(1, N.CONTACT_RULES)} ELSE '' END AS contact, CASE {_named(1, N.PERSONAL_RULES)} ELSE '' END AS personal,
       {_words(N.SECRET_WORDS)} AS secret FROM e
""", e=ESTATE))
def name_rules(spark, folder):
    c = F.col("column")
    return derived(spark, folder, ESTATE).select(
        *KEYS, F.coalesce(N.contact_rule(c)["policy"], F.lit("")).alias("contact"),
        F.coalesce(N.personal_rule(c)["policy"], F.lit("")).alias("personal"), N.secret_name(c).alias("secret"),
    )


@query("name_matcher", with_tables(f"""
SELECT "column", {_words(N.EMAIL_WORDS)} AS email, {_words(N.PERSON_WORDS)} AS person FROM e
""", e=ESTATE))
def name_matcher(spark, folder):
    c = F.col("column")
    return derived(spark, folder, ESTATE).select("column", N.name_has(c, N.EMAIL_WORDS).alias("email"), N.name_has(c, N.PERSON_WORDS).alias("person"))


@query("token_needs_text", with_tables(f"""
SELECT schema, relation, "column", family, CASE WHEN family = 'text' THEN named ELSE 'redact' END AS policy FROM (SELECT *, {_BY_NAME} AS named FROM e) WHERE named = 'token'
""", e=ESTATE))
def token_needs_text(spark, folder):
    entry = F.coalesce(N.contact_rule(F.col("column")), N.personal_rule(F.col("column")))
    out = derived(spark, folder, ESTATE).withColumn("e", entry).where("e.policy = 'token'")
    return out.select(*KEYS, "family", N.token_if_text(F.col("e"), F.col("family"))["policy"].alias("policy"))


@query("categorical_columns", with_tables("""
SELECT schema, relation, "column", "distinct" > 0 AND "distinct" <= 100 AND floor(avg_width) > 0 AND floor(avg_width) <= 32 AS categorical FROM s
""", s=STATS))
def categorical_columns(spark, folder):
    return derived(spark, folder, STATS).select(*KEYS, C.categorical(F.col("distinct"), F.col("avg_width")).alias("categorical"))


@query("overlay_recomputed", with_tables(CLASSIFIED + ' WHERE (schema, relation, "column") NOT IN (SELECT (schema, relation, "column") FROM c)', e=ESTATE, s=STATS, c=COMMITTED))
def overlay_recomputed(spark, folder):
    return C.overlay(derived(spark, folder, ESTATE), derived(spark, folder, STATS), derived(spark, folder, COMMITTED))


_MERGED = """
SELECT coalesce(o.schema, c.schema) AS schema, coalesce(o.relation, c.relation) AS relation, coalesce(o."column", c."column") AS "column",
       coalesce(o.policy, c.policy) AS policy, coalesce(o.namespace, c.namespace) AS namespace, CASE WHEN o.policy IS NULL THEN 'committed' ELSE 'auto' END AS source
FROM c FULL JOIN o ON o.schema = c.schema AND o.relation = c.relation AND o."column" = c."column"
"""
_MERGED_TABLE = with_tables(_MERGED, c=COMMITTED, o=OVERLAY)


def _merged(spark, folder):
    return C.merged(derived(spark, folder, COMMITTED), derived(spark, folder, OVERLAY))


@query("overlay_merge", _MERGED_TABLE)
def overlay_merge(spark, folder):
    return _merged(spark, folder)


@query("catalog_commit", with_tables("""
SELECT 'committed' AS t, * FROM (SELECT * FROM c WHERE (schema, relation, "column") NOT IN (SELECT (schema, relation, "column") FROM w) UNION ALL SELECT * FROM w)
UNION ALL SELECT 'overlay', * FROM o WHERE (schema, relation, "column") NOT IN (SELECT (schema, relation, "column") FROM w)
""", c=COMMITTED, o=OVERLAY, w=WANTED))
def catalog_commit(spark, folder):
    committed, over = C.commit(*(derived(spark, folder, s) for s in (COMMITTED, OVERLAY, WANTED)))
    both = committed.withColumn("t", F.lit("committed")).unionByName(over.withColumn("t", F.lit("overlay")))
    return both.select("t", *KEYS, "policy", "namespace")


@query("overlay_raise", with_tables("""
SELECT coalesce(o.schema, w.schema) AS schema, coalesce(o.relation, w.relation) AS relation, coalesce(o."column", w."column") AS "column",
       CASE WHEN raised THEN w.policy ELSE o.policy END AS policy, CASE WHEN raised THEN w.namespace ELSE o.namespace END AS namespace
FROM (SELECT o.*, k AS ok FROM o JOIN r ON r.p = o.policy) o FULL JOIN (SELECT w.*, k AS wk FROM w JOIN r ON r.p = w.policy WHERE (schema, relation, "column") NOT IN (SELECT (schema, relation, "column") FROM c)) w
  ON o.schema = w.schema AND o.relation = w.relation AND o."column" = w."column", LATERAL (SELECT coalesce(wk, -1) > coalesce(ok, -1) AS raised)
""", c=COMMITTED, o=OVERLAY, w=WANTED, r="SELECT * FROM (VALUES ('allow', 0), ('scan', 1), ('token', 2), ('redact', 3)) v(p, k)"))
def overlay_raise(spark, folder):
    return C.raise_entries(*(derived(spark, folder, s) for s in (COMMITTED, OVERLAY, WANTED)))


@query("unclassified_backlog", with_tables("""
SELECT schema, relation, "column" FROM e WHERE (schema, relation, "column") NOT IN (SELECT (schema, relation, "column") FROM m)
""", e=ESTATE, m=_MERGED_TABLE))
def unclassified_backlog(spark, folder):
    return C.unclassified(derived(spark, folder, ESTATE), _merged(spark, folder)).select(*KEYS)


@query("policy_summary", f'SELECT policy, count(*) AS "columns" FROM ({_MERGED_TABLE}) m GROUP BY policy')
def policy_summary(spark, folder):
    return C.policy_counts(_merged(spark, folder))


@query("catalog_lookup", with_tables("""
SELECT schema, relation, "column", CASE WHEN m.policy IS NOT NULL THEN m.policy WHEN kind = 'm' THEN 'allow' ELSE 'redact' END AS policy,
       coalesce(m.namespace, '') AS namespace, CASE WHEN m.policy IS NOT NULL OR kind = 'm' THEN 'catalog' ELSE 'unknown' END AS basis
FROM e LEFT JOIN m USING (schema, relation, "column")
""", e=ESTATE, m=_MERGED_TABLE))
def catalog_lookup(spark, folder):
    e = derived(spark, folder, ESTATE)
    system = e.where("kind = 'm'").select(*KEYS, F.lit("allow").alias("policy"), F.lit("").alias("namespace"))
    return C.lookup(e, _merged(spark, folder), system).select(*KEYS, "policy", "namespace", "basis")


_SHAPE_SQL = """
SELECT schema, relation, sha256('kind:' || max(kind) || '|' || string_agg({parts}, '|' ORDER BY position, {parts}){tail}) AS fingerprint FROM e GROUP BY schema, relation
"""
_NARROW = "concat_ws(':', position, \"column\", type)"
_WIDE = _NARROW[:-1] + ", nullable, is_identity, has_default)"


@query("schema_fingerprint", with_tables(_SHAPE_SQL.format(parts=_NARROW, tail=""), e=ESTATE))
def schema_fingerprint(spark, folder):
    return C.fingerprints(derived(spark, folder, ESTATE))


@query("schema_fingerprint_wide", with_tables(_SHAPE_SQL.format(
    parts=_WIDE, tail=" || chr(10) || CASE WHEN max(kind) IN ('v', 'm') THEN concat('SELECT * FROM ', schema, '.', relation) ELSE '' END"), e=ESTATE))
def schema_fingerprint_wide(spark, folder):
    e = derived(spark, folder, ESTATE)
    views_of = e.select("schema", "relation").distinct().withColumn("definition", F.concat(F.lit("SELECT * FROM "), "schema", F.lit("."), "relation"))
    return C.fingerprints(e, wide=True, definitions=views_of)


# The estate a day later: some columns widened, some relations dropped, some new.
_LATER = f"""
SELECT schema, CASE WHEN p_size = 33 THEN concat(relation, '_new') ELSE relation END AS relation, kind, "column", position,
       CASE WHEN p_size > 44 AND type = 'bigint' THEN 'decimal' ELSE type END AS type FROM ({ESTATE}) e WHERE p_size <> 12
"""


@query("schema_drift", with_tables(f"""
SELECT coalesce(a.schema, b.schema) AS schema, coalesce(a.relation, b.relation) AS relation,
       CASE WHEN a.fingerprint IS NULL THEN 'new' WHEN b.fingerprint IS NULL THEN 'gone' WHEN a.fingerprint = b.fingerprint THEN 'same' ELSE 'changed' END AS status,
       coalesce(a.fingerprint = b.fingerprint, FALSE) AS fresh
FROM ({_SHAPE_SQL.format(parts=_NARROW, tail='')}) a FULL JOIN ({_SHAPE_SQL.format(parts=_NARROW, tail='').replace('FROM e', 'FROM l')}) b ON a.schema = b.schema AND a.relation = b.relation
""", e=ESTATE, l=_LATER))
def schema_drift(spark, folder):
    later = derived(spark, folder, _LATER)
    return C.drift(C.fingerprints(derived(spark, folder, ESTATE)), C.fingerprints(later))


@query("masked_automatically", with_tables("""
SELECT schema, bool_or(m.policy IS NULL OR (m.source = 'auto' AND m.policy <> 'allow')) AS auto_masked FROM e LEFT JOIN m USING (schema, relation, "column") GROUP BY schema
""", e=ESTATE, m=_MERGED_TABLE))
def masked_automatically(spark, folder):
    return C.masked_automatically(derived(spark, folder, ESTATE), _merged(spark, folder), ["schema"])


@query("system_defaults", with_tables("""
SELECT schema, relation, "column", CASE WHEN p_size > 40 THEN 'redact' WHEN family IN ('numeric', 'boolean', 'datetime', 'uuid') THEN 'allow'
  WHEN family = 'text' AND type <> 'json' THEN 'allow' WHEN type = 'binary' AND schema <> 's9' THEN 'allow' ELSE 'redact' END AS policy FROM e
""", e=ESTATE))
def system_defaults(spark, folder):
    e = derived(spark, folder, ESTATE)
    return C.system_entries(e, e.where("p_size > 40"), ("binary",)).select(*KEYS, "policy")


# Samples for proposals: documents' own columns, an address per order, a number per line item.
_SAMPLES = r"""
SELECT 'd' AS relation, 'lang' AS "column", lang AS value FROM documents UNION ALL SELECT 'd', 'text', text FROM documents
UNION ALL SELECT 'c', 'contact', CASE WHEN c_nationkey < 24 THEN concat('c', c_custkey, '@example.com') ELSE c_name END FROM customer
UNION ALL SELECT 'c', 'code', concat(c_nationkey + 10, '.', c_nationkey, '.1.', c_nationkey) FROM customer
UNION ALL SELECT 'c', 'account', concat('555-100-', c_custkey + 1000) FROM customer
UNION ALL SELECT 'c', 'nation', CAST(c_nationkey AS VARCHAR) FROM customer
"""


def _samples(spark, folder):
    d, c = table(spark, folder, "documents"), table(spark, folder, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")

    def rows(df, relation, column, value):
        return df.select(F.lit("main").alias("schema"), F.lit(relation).alias("relation"), F.lit(column).alias("column"), value.cast("string").alias("value"))

    parts = [
        rows(d, "d", "lang", F.col("lang")), rows(d, "d", "text", F.col("text")),
        rows(c, "c", "contact", F.when(nation < 24, F.concat(F.lit("c"), key, F.lit("@example.com"))).otherwise(F.col("c_name"))),
        rows(c, "c", "code", F.concat(nation + 10, F.lit("."), nation, F.lit(".1."), nation)),
        rows(c, "c", "account", F.concat(F.lit("555-100-"), key + 1000)), rows(c, "c", "nation", nation),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _rates_sql() -> str:
    from maskweave.registry.detection import found_sql

    numbered = "SELECT *, row_number() OVER () AS rid FROM samples"
    return f"""
    rows AS MATERIALIZED ({numbered}),
    hits AS (SELECT relation, "column", type AS entity, count(DISTINCT id) AS hits FROM ({found_sql('rows', 'rid', 'value')}) f JOIN rows ON rid = f.id GROUP BY ALL),
    best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY relation, "column" ORDER BY hits DESC, entity) = 1),
    rates AS (SELECT relation, "column", count(*) AS n, coalesce(max(entity), '') AS entity, coalesce(max(hits), 0) / count(*) AS rate
              FROM rows LEFT JOIN best USING (relation, "column") GROUP BY relation, "column")
    """


@query("sample_rates", f"WITH samples AS ({_SAMPLES}), {_rates_sql()} SELECT relation, \"column\", n, entity, round(rate, 9) AS rate FROM rates")
def sample_rates(spark, folder):
    return O.sample_rates(_samples(spark, folder)).select("relation", "column", "n", "entity", F.round("rate", 9).alias("rate"))


_PROPOSED_COLUMNS = (
    ("d", "lang", "text"), ("d", "text", "text"), ("c", "contact", "text"), ("c", "code", "text"), ("c", "account", "numeric"),
    ("c", "nation", "numeric"), ("c", "customer_name", "text"), ("c", "created", "datetime"), ("c", "payload", "json"),
)


@query("propose_from_samples", f"""
WITH samples AS ({_SAMPLES}), {_rates_sql()},
cols AS (SELECT * FROM (VALUES {', '.join(str(c) for c in _PROPOSED_COLUMNS)}) v(relation, "column", family))
SELECT relation, "column", CASE WHEN "column" IN ('customer_name', 'payload') OR (family = 'text' AND coalesce(rate, 0) < 0.9) THEN 'review' ELSE 'safe' END AS bucket,
  CASE WHEN "column" = 'customer_name' OR (rate >= 0.9 AND family = 'text') THEN 'token' WHEN family IN ('text', 'json') THEN 'scan'
       WHEN rate >= 0.9 AND "column" <> 'nation' THEN 'token' ELSE 'allow' END AS policy,
  CASE WHEN "column" = 'customer_name' THEN 'person_name' WHEN rate >= 0.9 THEN entity ELSE '' END AS namespace,
  CASE WHEN family = 'text' AND rate > 0 THEN round(rate, 9) WHEN rate >= 0.9 THEN round(rate, 9) END AS sample_rate
FROM cols LEFT JOIN rates USING (relation, "column")
""")
def propose_from_samples(spark, folder):
    columns = spark.createDataFrame(
        [
            ("main", r, "r", c, i, "json" if f == "json" else "string", "text" if f == "json" else f, True, False, False, False, False)
            for i, (r, c, f) in enumerate(_PROPOSED_COLUMNS)
        ],
        SS.COLUMNS_SCHEMA,
    )
    out = O.propose(columns, O.sample_rates(_samples(spark, folder)))
    return out.select("relation", "column", "bucket", "policy", "namespace", F.round("sample_rate", 9).alias("sample_rate"))


@query("unexamined_samples", f"""
WITH samples AS ({_SAMPLES}), r AS (SELECT relation, "column", count(*) AS n, bool_and(coalesce(NOT contains(value, '.1.'), FALSE)) AS examined FROM samples GROUP BY ALL)
SELECT *, examined AS proposed, (SELECT CASE WHEN bool_or(NOT examined) THEN 'sampled values could not be examined, so their columns have no proposal' END FROM r) AS reason FROM r
""")
def unexamined_samples(spark, folder):
    """A detector that gives no answer for some values: their columns have no proposal, the others have."""
    from maskweave.functions import detect as D

    samples = _samples(spark, folder)
    # A row per column, used three times: the samples are examined once.
    rates = cut_lineage(O.sample_rates(samples, lambda v: F.when(~F.contains(v, F.lit(".1.")), D.spans(v))))
    named = [("main", r, "r", c, i, "string", "text", True, False, False, False, False) for i, (r, c, _) in enumerate(_PROPOSED_COLUMNS[:6])]
    proposed = O.propose(spark.createDataFrame(named, SS.COLUMNS_SCHEMA), rates).select(*KEYS, F.lit(True).alias("proposed"))
    out = rates.join(proposed, KEYS, "left").withColumn("reason", O.degradations(rates).select("reason").scalar())
    return out.select("relation", "column", "n", "examined", F.coalesce("proposed", F.lit(False)).alias("proposed"), "reason")


@query("describe_source", with_tables(f"""
SELECT 'policy' AS section, policy AS name, CAST(count(*) AS VARCHAR) AS value FROM m GROUP BY policy
UNION ALL SELECT 'schema', schema, CAST(count(DISTINCT relation) AS VARCHAR) FROM e GROUP BY schema
UNION ALL SELECT 'fresh', 'all', 'false'
UNION ALL (SELECT 'backlog', concat_ws('.', schema, relation, "column") AS k, '' FROM e WHERE (schema, relation, "column") NOT IN (SELECT (schema, relation, "column") FROM m) ORDER BY k LIMIT 20)
""", e=ESTATE, m=_MERGED_TABLE))
def describe_source(spark, folder):
    e = derived(spark, folder, ESTATE)
    later = derived(spark, folder, _LATER)
    drifted = C.drift(C.fingerprints(e), C.fingerprints(later))
    return C.describe(e, _merged(spark, folder), drifted)


@query("catalog_listing", with_tables("""
SELECT key, policy FROM (SELECT concat_ws('.', schema, relation, "column") AS key, m.policy FROM e LEFT JOIN m USING (schema, relation, "column")) WHERE contains(lower(key), 'mail')
""", e=ESTATE, m=_MERGED_TABLE))
def catalog_listing(spark, folder):
    return C.listing(derived(spark, folder, ESTATE), _merged(spark, folder), "MAIL").select("key", "policy")


@query("trusted_policy", with_tables("""
SELECT schema, relation, "column", CASE WHEN policy = 'allow' AND path_policy IS NOT NULL THEN 'redact' ELSE policy END AS policy FROM t
""", t=_ENTRIES))
def trusted_policy(spark, folder):
    return _entries(spark, folder).select(*KEYS, C.trusted_policy(F.col("policy"), F.size("paths")).alias("policy"))


@query("catalog_keys", with_tables("""
SELECT key, CASE WHEN ok THEN schema END AS schema, CASE WHEN ok THEN relation END AS relation, CASE WHEN ok THEN col END AS "column" FROM (
  SELECT concat(schema, '.', relation, '.', CASE WHEN p_size > 40 THEN '' WHEN p_size > 20 THEN 'a.' ELSE '' END, CASE WHEN p_size > 40 THEN '' ELSE "column" END) AS key,
         schema, relation, CASE WHEN p_size > 20 THEN 'a.' ELSE '' END || "column" AS col, p_size <= 40 AS ok FROM e)
""", e=ESTATE))
def catalog_keys(spark, folder):
    e = derived(spark, folder, ESTATE)
    size = F.col("p_size")
    name = F.when(size > 40, "").when(size > 20, F.concat(F.lit("a."), "column")).otherwise(F.col("column"))
    out = e.select(F.concat("schema", F.lit("."), "relation", F.lit("."), name).alias("key"))
    return out.withColumn("k", C.parse_key(F.col("key"))).select("key", "k.schema", "k.relation", "k.column")


@query("strictest_policy", with_tables("""
SELECT schema, relation, CASE k WHEN 3 THEN 'redact' WHEN 2 THEN 'token' WHEN 1 THEN 'scan' ELSE 'allow' END AS strictest, CASE WHEN k >= 2 THEN 'redact' WHEN k = 1 THEN 'scan' ELSE 'allow' END AS inherited FROM (
  SELECT schema, relation, max(CASE policy WHEN 'redact' THEN 3 WHEN 'token' THEN 2 WHEN 'scan' THEN 1 ELSE 0 END) AS k FROM t GROUP BY schema, relation)
""", t=_ENTRIES))
def strictest_policy(spark, folder):
    out = _entries(spark, folder).groupBy("schema", "relation").agg(P.strictest_of_group(F.col("policy")).alias("strictest"))
    return out.withColumn("inherited", P.inherited(F.col("strictest")))
