"""Masked copies, JSON paths, result bounds and change-sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.functions import policy as P
from maskweave.functions import text as X
from maskweave.functions.nested import map_strings
from maskweave.functions.types import text_like_column
from maskweave.operators import bounds as B
from maskweave.operators import changes as C
from maskweave.operators import jsonpaths as J
from maskweave.operators import masking as M
from maskweave.operators import results as RS
from maskweave.registry.base import ESTATE, FACTS, derived, key, query, rows, sql_token, table, with_tables
from maskweave.session import spread
from maskweave.sources.schema import json_safe

ALLOW, SCAN, REDACT = (M.ColumnPolicy(p) for p in ("allow", "scan", "redact"))
_R = "'⟨redacted⟩'"


def _customers(spark, folder, **settings):
    policies = {
        "c_custkey": ALLOW, "c_name": M.ColumnPolicy("token", "person"), "c_nationkey": M.ColumnPolicy("tokenise"),
        "c_acctbal": REDACT, "c_mktsegment": SCAN,
    }
    return M.Masking(policies, key=key(spark), **settings)


_MASKED = f"""
SELECT c_custkey, {sql_token('person', 'c_name')} AS c_name, {_R} AS c_nationkey, {_R} AS c_acctbal, c_mktsegment FROM customer
"""


@query("mask_table", _MASKED)
def mask_table(spark, folder):
    return M.mask(table(spark, folder, "customer"), _customers(spark, folder))


@query("mask_allow", "SELECT * FROM lineitem")
def mask_allow(spark, folder):
    li = table(spark, folder, "lineitem")
    return M.mask(li, M.Masking({c: ALLOW for c in li.columns}))


@query("mask_redact_all_types", f"""
SELECT event_id, CASE WHEN ts IS NOT NULL THEN {_R} END AS ts, CASE WHEN user_id IS NOT NULL THEN {_R} END AS user_id,
       CASE WHEN event_type <> 'view' THEN {_R} END AS event_type, CASE WHEN value IS NOT NULL THEN {_R} END AS value, CASE WHEN props IS NOT NULL THEN {_R} END AS props FROM events
""")
def mask_redact_all_types(spark, folder):
    ev = table(spark, folder, "events").withColumn("event_type", F.nullif(F.col("event_type"), F.lit("view")))
    return M.mask(ev, M.Masking({c: REDACT for c in ev.columns if c != "event_id"} | {"event_id": ALLOW}))


@query("mask_unknown_policy", f"SELECT s_suppkey, {_R} AS s_name, {_R} AS s_nationkey, {_R} AS s_acctbal FROM supplier")
def mask_unknown_policy(spark, folder):
    """A policy nobody knows, a token without a namespace, and no policy at all: redacted."""
    policies = {"s_suppkey": ALLOW, "s_name": M.ColumnPolicy("token"), "s_nationkey": M.ColumnPolicy("hide")}
    return M.mask(table(spark, folder, "supplier"), M.Masking(policies, key=key(spark)))


@query("mask_without_key", f"SELECT c_custkey, {_R} AS c_name FROM customer")
def mask_without_key(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", "c_name")
    return M.mask(df, M.Masking({"c_custkey": ALLOW, "c_name": M.ColumnPolicy("token", "person")}))


@query("mask_detection_off", f"SELECT doc_id, {_R} AS text, lang FROM documents")
def mask_detection_off(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return M.mask(df, M.Masking({"doc_id": ALLOW, "text": SCAN, "lang": ALLOW}, detection="off"))


@query("param_floor", with_tables("""
SELECT schema, relation, "column", CASE WHEN family NOT IN ('text', 'unknown') THEN policy WHEN policy = 'allow' THEN 'redact' WHEN policy = 'scan' THEN 'redact' ELSE 'redact' END AS policy
FROM (SELECT *, CASE WHEN p_size > 30 THEN 'token' WHEN p_size > 15 THEN 'scan' ELSE 'allow' END AS policy FROM e)
""", e=ESTATE))
def param_floor(spark, folder):
    size = F.col("p_size")
    policy = F.when(size > 30, "token").when(size > 15, "scan").otherwise("allow")
    raised = P.floor_policy(policy, P.inherited(F.lit("token")), text_like_column(F.col("family")))
    return derived(spark, folder, ESTATE).select("schema", "relation", "column", raised.alias("policy"))


@query("mask_with_floor", f"SELECT c_custkey, {_R} AS c_name, c_acctbal, {_R} AS c_mktsegment FROM customer")
def mask_with_floor(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return M.mask(df, M.Masking({c: ALLOW for c in df.columns}, floor="token"))


@query("mask_nested", """
SELECT o_orderkey, '<' || o_orderstatus || '>' AS a0, '<' || o_orderpriority || '>' AS a1, '<' || o_orderstatus || '>' AS map_key, '<' || o_orderpriority || '>' AS map_value,
       '<' || o_orderpriority || '>' AS inner_text, o_custkey AS inner_number FROM orders
""")
def mask_nested(spark, folder):
    o = table(spark, folder, "orders")
    nested = o.select(
        "o_orderkey",
        F.struct(
            F.array("o_orderstatus", "o_orderpriority").alias("a"), F.create_map("o_orderstatus", "o_orderpriority").alias("m"),
            F.struct(F.col("o_orderpriority").alias("t"), F.col("o_custkey").alias("n")).alias("s"),
        ).alias("v"),
    )
    wrap = lambda s: F.concat(F.lit("<"), s, F.lit(">"))
    out = nested.withColumn("v", map_strings(F.col("v"), nested.schema["v"].dataType, wrap))
    return out.select(
        "o_orderkey", F.col("v.a")[0].alias("a0"), F.col("v.a")[1].alias("a1"), F.map_keys("v.m")[0].alias("map_key"),
        F.map_values("v.m")[0].alias("map_value"), F.col("v.s.t").alias("inner_text"), F.col("v.s.n").alias("inner_number"),
    )


@query("mask_array_column", "SELECT vec_id, len(embedding) AS size, label FROM embeddings")
def mask_array_column(spark, folder):
    """An array of numbers holds no text: scanning leaves it as it is."""
    e = table(spark, folder, "embeddings")
    out = M.mask(e, M.Masking({"vec_id": ALLOW, "embedding": SCAN, "label": ALLOW}))
    return out.select("vec_id", F.size("embedding").cast("long").alias("size"), "label")


def _report(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", F.col("source").alias("s"))
    settings = M.Masking(
        {"doc_id": ALLOW, "text": SCAN, "lang": M.ColumnPolicy("token", "lang"), "s": M.ColumnPolicy("redact", basis="inherited")},
        key=key(spark),
    )
    return docs, settings


def _report_sql() -> str:
    from maskweave.registry.detection import found_sql

    return f"""
    SELECT * FROM (VALUES ('doc_id', 'allow', '', 'catalog'), ('lang', 'token', 'lang', 'catalog'), ('s', 'redact', '', 'inherited'), ('text', 'scan', '', 'rules')) v(name, policy, namespace, basis),
      LATERAL (SELECT CASE WHEN name = 'text' THEN (SELECT count(*) FROM ({found_sql('documents', 'doc_id')})) ELSE 0 END AS spans), LATERAL (SELECT CAST(0 AS BIGINT) AS collisions)
    """


@query("transforms_report", _report_sql())
def transforms_report(spark, folder):
    return M.transforms(*_report(spark, folder))


def _nested_report_sql() -> str:
    from maskweave.registry.detection import found_sql

    return f"""
    WITH n AS (SELECT count(*) AS n FROM ({found_sql('documents', 'doc_id')}))
    SELECT name, 'scan' AS policy, basis, CAST(n * times AS BIGINT) AS spans FROM n,
      (VALUES ('a', 'rules', 2), ('m', 'rules', 1), ('s', 'rules', 1), ('j', 'rules', 1), ('t', 'rules', 1)) v(name, basis, times)
    """


@query("transforms_nested", _nested_report_sql())
def transforms_nested(spark, folder):
    """Spans inside arrays, maps, rows and JSON documents count as those of plain texts do."""
    t = F.col("text")
    docs = rows(spark, folder, "documents", "text").select(
        F.array(t, t).alias("a"), F.create_map(F.lit("k"), t).alias("m"), F.struct(t.alias("x"), F.length(t).alias("y")).alias("s"),
        F.to_json(F.struct(t.alias("p"), t.alias("q"))).alias("j"), t.alias("t"),
    )
    json = M.ColumnPolicy("scan", paths={"$.p": ("scan", ""), "$.q": ("redact", "")})
    report = M.transforms(docs, M.Masking({c: SCAN for c in "amst"} | {"j": json}))
    return report.select("name", "policy", "basis", "spans")


_TOK, _NEXT = sql_token("person", "c_name"), sql_token("person", "next")


@query("apply_result", f"""
WITH r AS (SELECT o_orderkey, c_name, 'Customer#' || lpad(CAST(c_custkey + 1 AS VARCHAR), 9, '0') AS next, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (SELECT DISTINCT c_name AS known FROM r),
t AS (SELECT r.*, {_TOK} AS tok, CASE WHEN known IS NULL THEN next ELSE {_NEXT} END AS shown FROM r LEFT JOIN b ON known = next)
SELECT o_orderkey, tok AS c_name, 'for ' || tok || ' by ' || shown AS note, tok AS tag0, o_orderpriority AS tag1, shown AS map_key, tok || '!' AS map_value,
  shown AS inner_text, o_orderkey AS inner_number, '{{"n":' || o_orderkey || '.50,"who":["' || tok || '",null],"' || shown || '":true}}' AS doc FROM t
""")
def apply_result(spark, folder):
    """A name that is a token in one column is caught in every text of all others, of other rows too."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    orders = spread(orders) if orders.rdd.getNumPartitions() == 1 else orders  # rows of more splits stay out of one more shuffle
    both = orders.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    name, number = F.col("c_name"), F.col("o_orderkey").cast("string")
    neighbour = F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") + 1).cast("string"), 9, "0"))
    result = both.select(
        "o_orderkey", "c_name", F.concat(F.lit("for "), F.upper(name), F.lit(" by "), neighbour).alias("note"),
        F.array(name, F.col("o_orderpriority")).alias("tags"), F.create_map(neighbour, F.concat(name, F.lit("!"))).alias("m"),
        F.struct(F.lower(neighbour).alias("t"), F.col("o_orderkey").alias("n")).alias("s"),
        F.concat(F.lit('{"n": '), number, F.lit('.50, "who": ["'), name, F.lit('", null], "'), neighbour, F.lit('": true}')).alias("doc"),
    )
    policies = {c: ALLOW for c in result.columns} | {"c_name": M.ColumnPolicy("token", "person")}
    # A neighbour without orders is no value of the result, so its name, in its own spelling, stays.
    out = RS.apply_result(result, M.Masking(policies, key=key(spark)), json=frozenset({"doc"}))
    inner = F.col("s.t")
    return out.select(
        "o_orderkey", "c_name", "note", F.col("tags")[0].alias("tag0"), F.col("tags")[1].alias("tag1"), F.map_keys("m")[0].alias("map_key"),
        F.map_values("m")[0].alias("map_value"),
        F.when(inner.startswith("customer#"), F.initcap(inner)).otherwise(inner).alias("inner_text"), F.col("s.n").alias("inner_number"), "doc",
    )


@query("transforms_merged", """
SELECT l_returnflag AS name, CASE WHEN max(k) = 3 THEN 'redact' WHEN max(k) = 2 THEN 'token' WHEN max(k) = 1 THEN 'scan' ELSE 'allow' END AS policy, CAST(sum(l_linenumber) AS BIGINT) AS spans
FROM (SELECT *, CASE WHEN l_quantity > 40 THEN 3 WHEN l_quantity > 20 THEN 1 ELSE 0 END AS k FROM lineitem) GROUP BY l_returnflag
""")
def transforms_merged(spark, folder):
    q = F.col("l_quantity")
    report = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("name"), F.when(q > 40, "redact").when(q > 20, "scan").otherwise("allow").alias("policy"),
        F.lit("").alias("namespace"), F.lit("catalog").alias("basis"), F.col("l_linenumber").cast("long").alias("spans"), F.col("l_orderkey").alias("position"),
    )
    return M.merge_transforms(report).select("name", "policy", "spans")


@query("transform_basis", with_tables("""
SELECT connection, count(CASE WHEN unresolved THEN 1 END) AS unknown, count(CASE WHEN NOT unresolved AND masked THEN 1 END) AS rules, count(CASE WHEN NOT unresolved AND NOT masked THEN 1 END) AS catalog FROM f GROUP BY connection
""", f=FACTS))
def transform_basis(spark, folder):
    basis = F.when(F.col("unresolved"), "unknown").when(F.col("masked"), "rules").otherwise("catalog")
    f = derived(spark, folder, FACTS).select("connection", basis.alias("basis"))
    return f.groupBy("connection").agg(*(F.count(F.when(F.col("basis") == b, 1)).alias(b) for b in ("unknown", "rules", "catalog")))


@query("egress_summary", with_tables("""
SELECT schema, concat_ws('; ', CASE WHEN r > 0 THEN r || ' column(s) redacted' END, CASE WHEN t > 0 THEN t || ' column(s) tokenized' END, CASE WHEN s > 0 THEN s || ' column(s) scanned for PII spans' END) AS egress
FROM (SELECT schema, count(CASE WHEN p_size > 40 THEN 1 END) AS r, count(CASE WHEN p_size BETWEEN 31 AND 40 THEN 1 END) AS t, count(CASE WHEN p_size BETWEEN 21 AND 30 THEN 1 END) AS s FROM e GROUP BY schema)
""", e=ESTATE))
def egress_summary(spark, folder):
    size = F.col("p_size")
    policy = F.when(size > 40, "redact").when(size > 30, "token").when(size > 20, "scan").otherwise("allow")
    return M.egress_summary(derived(spark, folder, ESTATE).withColumn("policy", policy), ["schema"])


@query("log_attributes", """
SELECT event_id, CAST(user_id AS VARCHAR) AS plain, '[redacted]' AS upper_key, '[redacted]' AS nested, event_type AS nested_plain FROM events
""")
def log_attributes(spark, folder):
    ev = table(spark, folder, "events")
    flat = M.mask_attributes(F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("VALUE"), F.col("props")))
    tree = F.struct(F.struct(F.col("props").alias("body"), F.col("event_type").alias("kind")).alias("request"))
    schema = ev.select(tree.alias("t")).schema["t"].dataType
    out = ev.select("event_id", flat.alias("m"), tree.alias("t")).withColumn("t", M.mask_attribute_tree(F.col("t"), schema))
    return out.select(
        "event_id", F.col("m")["user"].alias("plain"), F.col("m")["VALUE"].alias("upper_key"),
        F.col("t.request.body").alias("nested"), F.col("t.request.kind").alias("nested_plain"),
    )


@query("degradations", """
SELECT 'detector' AS layer, 'free text was not examined, so its cells were redacted whole' AS reason UNION ALL SELECT 'catalog', 'the catalog is older than the tables'
""")
def degradations(spark, folder):
    docs, settings = _report(spark, folder)
    from dataclasses import replace

    from maskweave.operators import catalog as K
    from maskweave.registry.catalog import _LATER

    report = M.transforms(docs, replace(settings, detection="off"))
    drifted = K.drift(K.fingerprints(derived(spark, folder, ESTATE)), K.fingerprints(derived(spark, folder, _LATER)))
    return M.degradations(report, drifted)


@query("json_paths_props", f"""
SELECT event_id, '{{"k":' || coalesce(props ->> '$.k', 'null') || ',"⟨redacted⟩":"⟨redacted⟩","user":"' || {sql_token('user', 'user_id::VARCHAR')} || '","tags":["⟨redacted⟩",{{"t":"' || event_type || '","⟨redacted⟩":"⟨redacted⟩"}}]}}' AS doc FROM events
""")
def json_paths_props(spark, folder):
    ev = rows(spark, folder, "events", "event_id", "props", "value", "user_id", "event_type")
    doc = F.format_string(
        '{"k": %s, "value": %s, "user": %s, "tags": ["%s", {"t": "%s", "x": null}]}',
        F.get_json_object("props", "$.k"), F.col("value").cast("string"), F.col("user_id"), F.col("event_type"), F.col("event_type"),
    )
    paths = {"$.k": ("allow", ""), "$.user": ("token", "user"), "$.tags[*].t": ("scan", ""), "$.tags[*].none": ("allow", "")}
    return ev.select("event_id", J.mask_paths(doc, paths, key(spark)).alias("doc"))


@query("json_undeclared_keys", """
SELECT o_orderkey, '{"⟨redacted⟩":"⟨redacted⟩","kept":' || o_custkey || ',"⟨redacted:2⟩":{"⟨redacted⟩":"⟨redacted⟩"},"⟨redacted:3⟩":["⟨redacted⟩","⟨redacted⟩"]}' AS doc FROM orders
""")
def json_undeclared_keys(spark, folder):
    o = table(spark, folder, "orders")
    doc = F.concat(
        F.lit('{"'), "o_orderpriority", F.lit('": 1, "kept": '), "o_custkey", F.lit(', "b": {"'), "o_orderstatus", F.lit('": true}, "c": [1.50, null]}')
    )
    return o.select("o_orderkey", J.mask_paths(doc, {"$.kept": ("allow", "")}, None).alias("doc"))


@query("json_leaf_policies", f"""
SELECT c_custkey, '{{"n":' || CASE WHEN c_acctbal < 0 THEN 'null' ELSE '1.50' END || ',"t":"' || {sql_token('person', 'c_name')} || '","u":"⟨redacted⟩","s":"⟨redacted⟩","m":"⟨redacted:email_address⟩ ok"}}' AS doc FROM customer
""")
def json_leaf_policies(spark, folder):
    c = table(spark, folder, "customer")
    n = F.when(F.col("c_acctbal") < 0, "null").otherwise("1.50")
    doc = F.concat(F.lit('{"n": '), n, F.lit(', "t": "'), "c_name", F.lit('", "u": "x", "s": 5, "m": "c'), "c_custkey", F.lit('@example.com ok"}'))
    paths = {"$.n": ("allow", ""), "$.t": ("token", "person"), "$.u": ("hide", ""), "$.s": ("token", ""), "$.m": ("scan", "")}
    return c.select("c_custkey", J.mask_paths(doc, paths, key(spark)).alias("doc"))


@query("json_floor", """
SELECT event_id, '{"k":"⟨redacted⟩"}' AS doc FROM events
""")
def json_floor(spark, folder):
    return table(spark, folder, "events").select("event_id", J.mask_paths(F.col("props"), {"$.k": ("allow", "")}, None, floor="redact").alias("doc"))


@query("json_not_a_container", f"""
SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN props ELSE {_R} END AS doc FROM events
""")
def json_not_a_container(spark, folder):
    kind, props = F.col("event_type"), F.col("props")
    doc = F.when(kind.isin("view", "click"), props).when(kind == "purchase", "12").when(kind == "signup", F.concat(props, F.lit("}"))).otherwise('"text"')
    return table(spark, folder, "events").select("event_id", J.mask_unless_container(doc).alias("doc"))


@query("json_known_members", """
SELECT event_id, '{"k":"' || (props ->> '$.k') || '","hidden":"⟨redacted⟩"}' AS doc FROM events
""")
def json_known_members(spark, folder):
    members = {"k": lambda v: v, "hidden": lambda v: F.lit("⟨redacted⟩")}
    return table(spark, folder, "events").select("event_id", J.mask_known_members(F.col("props"), members).alias("doc"))


@query("json_whole_column", """
SELECT doc_id, '{"a":{"b":"' || CASE WHEN lang = 'en' THEN '⟨redacted:email_address⟩' ELSE lang END || '"},"c":' || n_chars || '}' AS doc FROM documents
""")
def json_whole_column(spark, folder):
    """A JSON column with no paths: its own policy on every text inside, by the known schema."""
    from maskweave.functions import detect as D

    mail = F.when(F.col("lang") == "en", F.concat(F.lit("d"), "doc_id", F.lit("@example.com"))).otherwise(F.col("lang"))
    doc = F.to_json(F.struct(F.struct(mail.alias("b")).alias("a"), F.col("n_chars").alias("c")))
    schema = T._parse_datatype_string("a struct<b: string>, c bigint")
    out = table(spark, folder, "documents").select("doc_id", F.from_json(doc, schema).alias("v"))
    masked = map_strings(F.col("v"), schema, lambda s: D.redact_spans(s, D.spans(s)))
    return out.select("doc_id", F.to_json(masked).alias("doc"))


@query("row_ceiling", """
SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN least(CASE WHEN c_nationkey > 10 THEN c_nationkey ELSE 1000 END, c_custkey % 7) ELSE CASE WHEN c_nationkey > 10 THEN c_nationkey ELSE 1000 END END AS rows FROM customer
""")
def row_ceiling(spark, folder):
    allowed = F.when(F.col("c_nationkey") > 10, F.col("c_nationkey")).otherwise(0)
    return table(spark, folder, "customer").select("c_custkey", B.ceiling_column(F.col("c_custkey") % 7, allowed).cast("long").alias("rows"))


@query("truncated_rows", """
SELECT o_orderkey, CASE WHEN (SELECT count(*) FROM orders) > 700 THEN 'rows' ELSE '' END AS truncated_by FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 700
""")
def truncated_rows(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return B.bounded(o, [F.desc("o_totalprice"), F.col("o_orderkey")], B.ceiling(700)).select("o_orderkey", "truncated_by")


@query("byte_prefix", """
SELECT c_custkey, 'size' AS truncated_by FROM (
  SELECT c_custkey, sum(strlen('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') + 1) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS total
  FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 1000)) WHERE total <= 4000
""")
def byte_prefix(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_name")
    return B.bounded(c, [F.col("c_custkey")], B.ceiling(), 4000).select("c_custkey", "truncated_by")


@query("raw_byte_prefix", """
SELECT doc_id, 'size' AS truncated_by FROM (SELECT doc_id, sum(strlen(text) + strlen(CAST(doc_id AS VARCHAR))) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total
  FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 500)) WHERE total <= 65536
""")
def raw_byte_prefix(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "text")
    return B.bounded(d, [F.col("doc_id")], 500, 65536, masked=False).select("doc_id", "truncated_by")


@query("cut_reason", with_tables("""
SELECT id, CASE WHEN masked THEN 'size' WHEN unresolved OR uncertain THEN 'rows' ELSE '' END AS reason FROM f
""", f=FACTS))
def cut_reason(spark, folder):
    return derived(spark, folder, FACTS).select("id", B.cut_reason(F.col("unresolved") | F.col("uncertain"), F.col("masked")).alias("reason"))


@query("kept_results", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def kept_results(spark, folder):
    return B.latest(table(spark, folder, "events"), [F.desc("ts"), F.desc("event_id")]).select("event_id")


@query("json_safe_numbers", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount = 0 THEN 'NaN' WHEN l_tax = 0 THEN 'Infinity' WHEN l_tax > 0.07 THEN '-Infinity' ELSE CAST(l_discount AS VARCHAR) END AS v,
       CASE WHEN l_discount = 0 THEN 'NaN' WHEN l_tax = 0 THEN 'Infinity' WHEN l_tax > 0.07 THEN '-Infinity' ELSE CAST(l_discount AS VARCHAR) END AS first FROM lineitem
""")
def json_safe_numbers(spark, folder):
    d, t = F.col("l_discount"), F.col("l_tax")
    v = F.when(d == 0, F.lit(float("nan"))).when(t == 0, F.lit(float("inf"))).when(t > 0.07, F.lit(float("-inf"))).otherwise(d)
    numbers = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", v.alias("v"), F.array(v).alias("a"))
    return json_safe(numbers).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "v", F.col("a")[0].alias("first"))


def _priced(spark, folder):
    o = table(spark, folder, "orders")
    return o, F.col("o_orderstatus") == "P", {"o_totalprice": F.round(F.col("o_totalprice") * 2, 2), "o_orderpriority": F.lit("1-URGENT")}


@query("update_preview", """
SELECT o_orderkey, o_totalprice AS old_price, round(o_totalprice * 2, 2) AS new_price, o_orderpriority AS old_priority, '1-URGENT' AS new_priority FROM orders WHERE o_orderstatus = 'P'
""")
def update_preview(spark, folder):
    return C.update_preview(*_priced(spark, folder)).select(
        F.col("old.o_orderkey").alias("o_orderkey"), F.col("old.o_totalprice").alias("old_price"), F.col("new.o_totalprice").alias("new_price"),
        F.col("old.o_orderpriority").alias("old_priority"), F.col("new.o_orderpriority").alias("new_priority"),
    )


@query("delete_preview", "SELECT o_orderkey AS old_key, CAST(NULL AS BIGINT) AS new_key FROM orders WHERE o_totalprice < 50000 UNION ALL SELECT NULL, p_partkey FROM part WHERE p_size > 40")
def delete_preview(spark, folder):
    gone = C.delete_preview(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice") < 50000)
    added = C.insert_preview(table(spark, folder, "part").where("p_size > 40").select("p_partkey"))
    a = gone.select(F.col("old.o_orderkey").alias("old_key"), F.col("new.o_orderkey").alias("new_key"))
    return a.unionByName(added.select(F.col("old.p_partkey").alias("old_key"), F.col("new.p_partkey").alias("new_key")))


@query("preview_shown", """
SELECT o_orderkey, greatest((SELECT count(*) FROM orders WHERE o_orderstatus = 'P') - 50, 0) AS omitted FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 50
""")
def preview_shown(spark, folder):
    changes = C.update_preview(*_priced(spark, folder))
    return C.shown(changes, [F.col("old.o_orderkey")]).select(F.col("old.o_orderkey").alias("o_orderkey"), "omitted")


@query("changed_columns", """
SELECT 'o_totalprice' AS "column", count(CASE WHEN round(o_totalprice * 2, 2) IS DISTINCT FROM o_totalprice THEN 1 END) AS changed FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'o_orderpriority', count(CASE WHEN o_orderpriority <> '1-URGENT' THEN 1 END) FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT name, CAST(0 AS BIGINT) FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_orderdate')) v(name)
""")
def changed_columns(spark, folder):
    return C.changed_columns(C.update_preview(*_priced(spark, folder)))


@query("update_commit", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus = 'P' THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority
FROM orders WHERE NOT coalesce(o_custkey < 100, FALSE)
UNION ALL SELECT -p_partkey - 1, p_retailprice, p_type FROM part
""")
def update_commit(spark, folder):
    """An UPDATE, then a DELETE, then an INSERT."""
    o = C.updated(*_priced(spark, folder))
    o = C.deleted(o, F.col("o_custkey") < 100).select("o_orderkey", "o_totalprice", "o_orderpriority")
    added = table(spark, folder, "part").select(
        (-F.col("p_partkey") - 1).alias("o_orderkey"), F.col("p_retailprice").alias("o_totalprice"), F.col("p_type").alias("o_orderpriority")
    )
    return C.inserted(o, added)


@query("merge_commit", """
SELECT coalesce(t.p_partkey, s.p_partkey) AS p_partkey, CASE WHEN s.p_partkey IS NOT NULL THEN s.p_name ELSE t.p_name END AS p_name, CASE WHEN s.p_partkey IS NOT NULL THEN s.p_size ELSE t.p_size END AS p_size
FROM part t FULL JOIN (SELECT p_partkey + 50 AS p_partkey, upper(p_name) AS p_name, p_size + 1 AS p_size FROM part WHERE p_size > 20) s ON s.p_partkey = t.p_partkey
WHERE s.p_partkey IS NULL OR t.p_partkey IS NULL OR s.p_size <= 45
""")
def merge_commit(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_size")
    source = part.where("p_size > 20").select((F.col("p_partkey") + 50).alias("p_partkey"), F.upper("p_name").alias("p_name"), (F.col("p_size") + 1).alias("p_size"))
    return C.upserted(part, source, ["p_partkey"], delete=F.col("p_size") > 45)


@query("execution_report", """
SELECT 'UPDATE' AS operation, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS previewed_rows, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P' AND o_custkey >= 10) AS executed_rows
""")
def execution_report(spark, folder):
    """Between the preview and the commit, some of the rows have gone."""
    o, where, new = _priced(spark, folder)
    return C.execution_report(C.update_preview(o, where, new), o.where(where & (F.col("o_custkey") >= 10)), "UPDATE")


@query("changes_as_text", r"""
SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0'), '0') END || 'Z' AS ts,
       CASE WHEN event_type = 'view' THEN 'NULL' ELSE event_type END AS event_type, '\x' || lower(hex(encode(props))) AS props FROM events
""")
def changes_as_text(spark, folder):
    ev = table(spark, folder, "events").select(
        "event_id", "ts", F.nullif(F.col("event_type"), F.lit("view")).alias("event_type"), F.col("props").cast("binary").alias("props")
    )
    return C.side_as_text(C.insert_preview(ev), "new")


@query("returning_masked", f"""
SELECT c_custkey, {sql_token('person', 'upper(c_name)')} AS c_name, {_R} AS c_nationkey, {_R} AS c_acctbal, c_mktsegment FROM customer WHERE c_acctbal < 0
""")
def returning_masked(spark, folder):
    changes = C.update_preview(table(spark, folder, "customer"), F.col("c_acctbal") < 0, {"c_name": F.upper("c_name")})
    return M.mask(C.returned(changes), _customers(spark, folder))


@query("unique_names", """
SELECT l_orderkey AS l_orderkey, o_orderkey AS column_2, o_orderkey + 1 AS l_orderkey_2, l_linenumber AS l_orderkey_3 FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def unique_names(spark, folder):
    joined = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = joined.select("l_orderkey", F.col("o_orderkey").alias("x"), (F.col("o_orderkey") + 1).alias("l_orderkey"), F.col("l_linenumber").alias("l_orderkey"))
    return out.toDF(*X.unique_names(["l_orderkey", "", "l_orderkey", "l_orderkey"]))
