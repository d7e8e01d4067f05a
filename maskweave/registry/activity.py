"""Statements and the activity log as data."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskweave.functions import render as R
from maskweave.functions import statements as S
from maskweave.functions import text as X
from maskweave.operators import activity as A
from maskweave.operators import profiles as P
from maskweave.operators import triage as T
from maskweave.registry.base import ESTATE, FACTS, LOG, PROFILES, derived, keys, query, relations_of, rows, table, with_tables
from maskweave.sources import activity as SA

# Statements as they come out normalised, by the status of the order they are about.
_NORMAL_TEXTS = {
    "O": "SELECT id FROM orders WHERE o_orderkey = ? AND p = ?",
    "F": 'WITH t AS (SELECT "?", "o_orderkey" FROM orders WHERE total > ?) UPDATE t SET note = ?, n = $1',
    "P": "delete from orders where k in (?, ?, ?, ?, ?, ?)",
}
_KINDS = {"O": "SELECT", "F": "UPDATE", "P": "DELETE"}


def _statements(spark, folder):
    """Statement texts, one per order: each status writes its statement in another way."""
    k, c, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    read = text("SELECT id /* note ", k, " /* nested 'x */ */ FROM orders -- by ", c, "\n WHERE o_orderkey = ", k, " AND p = E'it\\'s ", c, "'")
    change = text('WITH t AS (SELECT "Name", "o_orderkey" FROM orders WHERE total > ', F.col("o_totalprice"), ") UPDATE t SET note = $q$ hidden ", c, " $q$, n = $1")
    drop = text("delete   from orders\n\twhere k in (0x1F, .5, 1_000, ", k, ", 'O''Brien', U&'", c, "')")
    statement = F.when(status == "O", read).when(status == "F", change).otherwise(drop)
    return rows(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").select("o_orderkey", "o_custkey", "o_orderstatus", statement.alias("statement"))


def _by_status(values: dict[str, str]) -> str:
    return "CASE o_orderstatus " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_NORMAL = _by_status(_NORMAL_TEXTS)


@query("normalise_statements", f"SELECT o_orderkey, {_NORMAL} AS text, {_by_status(_KINDS)} AS kind FROM orders")
def normalise_statements(spark, folder):
    n = S.normalise(F.col("statement"), F.array(F.lit("o_orderkey")))
    return _statements(spark, folder).select("o_orderkey", n.alias("n")).select("o_orderkey", "n.*")


@query("statement_shapes", f"""SELECT replace({_NORMAL}, '"o_orderkey"', '"?"') AS text, count(*) AS n FROM orders GROUP BY ALL""")
def statement_shapes(spark, folder):
    out = _statements(spark, folder).select(S.normalise(F.col("statement"))["text"].alias("text"))
    return out.groupBy("text").agg(F.count("*").alias("n"))


@query("strip_comments", r"""
SELECT o_orderkey, 'SELECT id FROM orders WHERE o_orderkey = ' || o_orderkey || ' AND p = E''it\''s ' || o_custkey || '''' AS text FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, 'delete from orders where k in (0x1F, .5, 1_000, ' || o_orderkey || ', ''O''''Brien'', U&''' || o_custkey || ''')' FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
UNION ALL SELECT o_orderkey, 'WITH t AS (SELECT "Name", "o_orderkey" FROM orders WHERE total > ' || o_totalprice || ') UPDATE t SET note = $q$ hidden ' || o_custkey || ' $q$, n = $1' FROM orders WHERE o_orderstatus = 'F'
""")
def strip_comments(spark, folder):
    return _statements(spark, folder).select("o_orderkey", S.strip_comments(F.col("statement")).alias("text"))


@query("statement_type", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'SELECT' WHEN 'F' THEN 'MERGE' ELSE 'DDL' END AS kind FROM orders")
def statement_type(spark, folder):
    o = table(spark, folder, "orders")
    text = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("(values (1), ("), "o_orderkey", F.lit("))"))).when(
        F.col("o_orderstatus") == "F", F.concat(F.lit("Merge into t using s on t.k = "), "o_orderkey")
    ).otherwise(F.concat(F.lit("  create table t"), "o_orderkey"))
    return o.select("o_orderkey", S.first_word_type(text).alias("kind"))


_OUTCOME = """CASE WHEN statement_type = 'DDL' THEN 'refuse' WHEN writes THEN CASE WHEN w = 'ask' THEN 'ask' WHEN w = 'allow' THEN 'run' ELSE 'refuse' END
  WHEN r = 'never' THEN 'run' WHEN r IN ('uncertain', '') AND NOT uncertain THEN 'run' ELSE 'ask' END"""
_REASONS = """concat_ws(',', CASE WHEN statement_type = 'DDL' THEN 'ddl' END, CASE WHEN statement_type <> 'DDL' AND writes THEN 'write' END,
  CASE WHEN statement_type <> 'DDL' AND writes AND w NOT IN ('ask', 'allow') THEN 'writes_off' END,
  CASE WHEN statement_type <> 'DDL' AND NOT writes AND r IN ('uncertain', '') AND uncertain THEN 'volatile_call' END,
  CASE WHEN statement_type <> 'DDL' AND NOT writes AND r NOT IN ('uncertain', '', 'never') THEN 'reads_ask' END)"""
_JOINED = "FROM (SELECT f.*, coalesce(p.reads, '') AS r, coalesce(p.writes, '') AS w FROM f LEFT JOIN p ON p.id = f.connection) f"


@query("triage_statements", with_tables(f"SELECT f.id, {_OUTCOME} AS outcome, {_REASONS} AS reasons {_JOINED}", f=FACTS, p=PROFILES))
def triage_statements(spark, folder):
    profiles = derived(spark, folder, PROFILES).withColumnRenamed("writes", "writes_setting")
    return T.triage(derived(spark, folder, FACTS), profiles).select("id", "outcome", F.array_join("reasons", ",").alias("reasons"))


@query("statement_reasons", with_tables("""
SELECT reason, count(*) AS n FROM (SELECT unnest([CASE WHEN stale THEN 'stale_catalog' END, CASE WHEN statement_type = 'DDL' THEN 'ddl' END, CASE WHEN statement_type <> 'DDL' AND writes THEN 'write' END,
  CASE WHEN statement_type <> 'DDL' AND NOT writes THEN 'reads_ask' END, CASE WHEN masked THEN 'masked_output' END, CASE WHEN unresolved THEN 'unresolved_column' END]) AS reason FROM f) WHERE reason IS NOT NULL GROUP BY reason
""", f=FACTS))
def statement_reasons(spark, folder):
    c = {n: F.col(n) for n in ("statement_type", "writes", "uncertain", "masked", "unresolved", "stale")}
    reasons = T.reasons(c["statement_type"], c["writes"], c["uncertain"], F.lit("always"), F.lit("ask"), c["masked"], c["unresolved"], c["stale"])
    return derived(spark, folder, FACTS).select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("risk_class", with_tables("""
SELECT id, CASE statement_type WHEN 'SELECT' THEN 'read' WHEN 'INSERT' THEN 'write' WHEN 'UPDATE' THEN 'write' ELSE 'destructive' END AS risk, statement_type = 'DDL' AS unreadable FROM f
""", f=FACTS))
def risk_class(spark, folder):
    kind = F.col("statement_type")
    return derived(spark, folder, FACTS).select("id", S.risk(kind).alias("risk"), S.unreadable(kind).alias("unreadable"))


@query("effective_settings", with_tables("""
SELECT id, CASE WHEN reads = '' THEN 'uncertain' WHEN reads = 'sometimes' THEN 'always' ELSE reads END AS reads, CASE WHEN writes = 'approve' THEN 'off' ELSE writes END AS writes FROM p
""", p=PROFILES))
def effective_settings(spark, folder):
    return derived(spark, folder, PROFILES).select("id", T.effective_reads(F.col("reads")).alias("reads"), T.effective_writes(F.col("writes")).alias("writes"))


_STATES = """
SELECT event_id, CASE CAST(user_id % 12 AS INT) WHEN 0 THEN '57014' WHEN 1 THEN '25006' WHEN 2 THEN '42501' WHEN 3 THEN '42601' WHEN 4 THEN '42P01' WHEN 5 THEN '28000' WHEN 6 THEN '3D000'
  WHEN 7 THEN '3F000' WHEN 8 THEN '53100' WHEN 9 THEN 'XX000' WHEN 10 THEN '25001' ELSE '9' END AS state, CASE WHEN value > 5 THEN 'exec_parse_message' ELSE 'scanner_yyerror' END AS routine FROM events
"""
_CODE = """CASE WHEN state = '42601' AND routine = 'exec_parse_message' THEN 'multi_statement' WHEN state = '57014' THEN 'timeout' WHEN state = '25006' THEN 'approval_required'
  WHEN state = '42501' OR state LIKE '28%' THEN 'permission_denied' WHEN state LIKE '42%' OR state LIKE '3D%' OR state LIKE '3F%' THEN 'syntax' ELSE 'internal' END"""


@query("sqlstate_codes", with_tables(f"SELECT event_id, state, {_CODE} AS code FROM t", t=_STATES))
def sqlstate_codes(spark, folder):
    return derived(spark, folder, _STATES).select("event_id", "state", S.code_for_state(F.col("state"), F.col("routine")).alias("code"))


# A caller's own texts for the codes, one missing.
_CODE_TEXTS = """
SELECT code, concat('statement ended as ', code) AS summary, concat('see rule ', CAST(rule AS INT)) AS action
FROM (SELECT DISTINCT n_regionkey AS rule, CASE n_regionkey WHEN 0 THEN 'syntax' WHEN 1 THEN 'timeout' WHEN 2 THEN 'permission_denied' WHEN 3 THEN 'internal' ELSE 'approval_required' END AS code FROM nation) c
"""


@query("code_texts", with_tables(f"""
SELECT c.code, summary, action, count(*) AS n FROM (SELECT {_CODE} AS code FROM t) c LEFT JOIN v ON v.code = c.code GROUP BY ALL
""", t=_STATES, v=_CODE_TEXTS))
def code_texts(spark, folder):
    code = S.code_for_state(F.col("state"), F.col("routine"))
    counts = derived(spark, folder, _STATES).groupBy(code.alias("code")).agg(F.count("*").alias("n"))
    return S.with_code_texts(counts, derived(spark, folder, _CODE_TEXTS)).select("code", "summary", "action", "n")


@query("resolve_profiles", with_tables("""
SELECT ref, CASE WHEN p1.id IS NOT NULL THEN p1.id WHEN n = 1 THEN ids END AS id, CASE WHEN p1.id IS NOT NULL OR n = 1 THEN 'ok' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS status,
       CASE WHEN p1.id IS NULL AND n > 1 THEN ids END AS candidates
FROM (SELECT DISTINCT ref FROM (SELECT concat('p', o_custkey) AS ref FROM orders UNION ALL SELECT name FROM p UNION ALL SELECT concat('gone', o_custkey) FROM orders)) r
LEFT JOIN p p1 ON p1.id = ref LEFT JOIN (SELECT name, count(*) AS n, string_agg(id, ', ' ORDER BY id) AS ids FROM p GROUP BY name) g ON g.name = ref
""", p=PROFILES))
def resolve_profiles(spark, folder):
    p = derived(spark, folder, PROFILES)
    o = table(spark, folder, "orders")
    refs = o.select(F.concat(F.lit("p"), "o_custkey").alias("ref")).union(p.select("name")).union(o.select(F.concat(F.lit("gone"), "o_custkey")))
    return P.resolved(refs.distinct(), p)


@query("profiles_with_writers", with_tables("""
SELECT c.id, writers FROM p c JOIN (SELECT host_id, database, string_agg(DISTINCT name, ', ' ORDER BY name) AS writers FROM p WHERE writes IN ('ask', 'allow') GROUP BY ALL) USING (host_id, database) WHERE c.writes NOT IN ('ask', 'allow')
""", p=PROFILES))
def profiles_with_writers(spark, folder):
    return P.writers(derived(spark, folder, PROFILES)).select("id", "writers")


@query("statement_facts", f"""
SELECT o_orderkey, replace({_NORMAL}, '"o_orderkey"', '"?"') AS normalised, {_by_status(_KINDS)} AS statement_type, o_orderstatus <> 'O' AS writes, {_by_status({'O': 'read', 'F': 'write', 'P': 'destructive'})} AS risk, FALSE AS unreadable FROM orders
""")
def statement_facts(spark, folder):
    f = T.facts_of(_statements(spark, folder))
    return f.select("o_orderkey", "normalised", "statement_type", "writes", "risk", "unreadable")


@query("known_names", with_tables("""
SELECT l_orderkey AS id, string_agg(DISTINCT name, ',' ORDER BY name) AS known FROM (
  SELECT l_orderkey, unnest([r.relation, e."column"]) AS name FROM lineitem JOIN e r ON r.position = l_partkey JOIN e ON e.schema = r.schema AND e.relation = r.relation) GROUP BY l_orderkey
""", e=ESTATE))
def known_names(spark, folder):
    e = derived(spark, folder, ESTATE)
    used = table(spark, folder, "lineitem").join(e, F.col("l_partkey") == F.col("position"))
    names = T.known_names(used.select(F.col("l_orderkey").alias("id"), "schema", "relation"), e)
    return names.select("id", F.array_join("known", ",").alias("known"))


def _log(spark, folder):
    log = derived(spark, folder, LOG).withColumn("at", F.col("at").cast("timestamp"))
    return log.withColumn("relations", relations_of("relation_count")).drop("relation_count")


_T = "strftime(\"at\", '%Y-%m-%d %H:%M:%S')"
_LATEST = "SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"


@query("activity_filter", with_tables(f"SELECT seq, {_T} AS \"at\" FROM l WHERE connection = 'c3' AND decision = 'approved' AND \"at\" >= TIMESTAMP '2024-01-15 12:00:00'", l=LOG))
def activity_filter(spark, folder):
    out = A.filtered(_log(spark, folder), connection="c3", decision="approved", since="2024-01-15 12:00:00")
    return out.select("seq", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("activity_latest", with_tables(f"SELECT id, seq, decision, row_count FROM ({_LATEST})", l=LOG))
def activity_latest(spark, folder):
    return A.latest(_log(spark, folder)).select("id", "seq", "decision", "row_count")


@query("activity_page", with_tables(f"""
SELECT id, seq, total, 500 AS page_size FROM (SELECT *, count(*) OVER () AS total FROM ({_LATEST.replace('FROM l', "FROM (SELECT * FROM l WHERE decision = 'refused')")})) ORDER BY "at" DESC, seq DESC LIMIT 500 OFFSET 20
""", l=LOG))
def activity_page(spark, folder):
    return A.page(_log(spark, folder), offset=20, limit=900, decision="refused").select("id", "seq", "total", "page_size")


@query("activity_record", with_tables(f"SELECT id, seq, statement FROM ({_LATEST}) WHERE id = 'r42'", l=LOG))
def activity_record(spark, folder):
    return A.record(_log(spark, folder), "r42").select("id", "seq", "statement")


@query("activity_retention", with_tables("SELECT CAST(day AS VARCHAR) AS day, count(*) AS records FROM l WHERE day + 1 > DATE '2024-01-30' - 14 GROUP BY day", l=LOG))
def activity_retention(spark, folder):
    kept = A.kept(_log(spark, folder), F.to_date(F.lit("2024-01-30")), 14)
    return kept.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("records"))


@query("activity_outcome", with_tables("""
SELECT seq, CASE WHEN error_code NOT IN ('', 'approval_required', 'approval_refused') THEN 'failed · ' || error_code WHEN decision = 'expired' THEN 'expired'
  WHEN decision <> '' AND approver <> '' THEN decision || CASE approver WHEN 'dialog' THEN ' in the terminal' WHEN 'ui' THEN ' in the dashboard' ELSE ' by ' || approver END
  WHEN decision <> '' THEN decision WHEN error_code = 'approval_required' THEN 'asked' ELSE 'ran' END AS outcome FROM l
""", l=LOG))
def activity_outcome(spark, folder):
    return _log(spark, folder).select("seq", R.outcome_text(F.col("decision"), F.col("approver"), F.col("error_code")).alias("outcome"))


@query("activity_titles", with_tables("""
SELECT seq, CASE WHEN relation_count = 0 THEN statement ELSE CASE statement_type WHEN 'SELECT' THEN 'Read' WHEN 'INSERT' THEN 'Insert into' WHEN 'UPDATE' THEN 'Update' WHEN 'DELETE' THEN 'Delete from' ELSE 'Merge into' END
  || CASE relation_count WHEN 1 THEN ' main.orders' WHEN 2 THEN ' main.orders, main.customer' ELSE ' main.orders, main.customer +1' END END AS title FROM l
""", l=LOG))
def activity_titles(spark, folder):
    return _log(spark, folder).select("seq", R.record_title(F.col("statement"), F.col("statement_type"), F.col("relations")).alias("title"))


@query("activity_days", with_tables("SELECT CAST(CAST(\"at\" AS DATE) AS VARCHAR) AS day, count(*) AS records FROM l GROUP BY ALL", l=LOG))
def activity_days(spark, folder):
    return A.per_day(_log(spark, folder)).select(F.col("day").cast("string").alias("day"), "records")


@query("activity_pages", with_tables("""
SELECT session_id, size, greatest(1, CAST(ceil(n / size) AS BIGINT)) AS pages, CASE WHEN n = 0 THEN '0 of 0' ELSE (size + 1) || '–' || least(n, 2 * size) || ' of ' || n END AS range
FROM (SELECT session_id, count(*) AS n FROM l GROUP BY session_id), (VALUES (25), (50), (100)) v(size)
""", l=LOG))
def activity_pages(spark, folder):
    counts = _log(spark, folder).groupBy("session_id").agg(F.count("*").alias("n"))
    sized = counts.withColumn("size", F.explode(F.array(F.lit(25), F.lit(50), F.lit(100))))
    size, n = F.col("size"), F.col("n")
    return sized.select("session_id", "size", X.page_count(n, size).alias("pages"), X.range_text(F.lit(2), size, n).alias("range"))


@query("activity_ages", with_tables("""
SELECT seq, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN CAST(floor(s / 60 + 0.5) AS BIGINT) || 'm' WHEN s < 86400 THEN CAST(floor(s / 3600 + 0.5) AS BIGINT) || 'h' ELSE CAST(floor(s / 86400 + 0.5) AS BIGINT) || 'd' END AS age
FROM (SELECT seq, CAST(greatest(0, floor((epoch_ms(TIMESTAMP '2024-01-15 00:00:00') - epoch_ms("at")) / 1000 + 0.5)) AS BIGINT) AS s FROM l)
""", l=LOG))
def activity_ages(spark, folder):
    return _log(spark, folder).select("seq", X.age(F.col("at"), F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("age"))


@query("activity_sentences", with_tables(f"""
SELECT code, coalesce(text, code) AS sentence, count(*) AS n FROM (SELECT CASE WHEN error_code = '' THEN statement_type WHEN error_code = 'timeout' THEN 'plan_timeout' ELSE 'write' END AS code FROM l)
LEFT JOIN (VALUES {', '.join(str(r) for r in R.REASONS)}) v(code, text) USING (code) GROUP BY ALL
""", l=LOG))
def activity_sentences(spark, folder):
    err = F.col("error_code")
    code = F.when(err == "", F.col("statement_type")).when(err == "timeout", "plan_timeout").otherwise("write")
    return _log(spark, folder).groupBy(code.alias("code")).agg(F.count("*").alias("n")).select("code", R.reason_text(F.col("code")).alias("sentence"), "n")


@query("activity_append", with_tables("""
SELECT seq, coalesce(CASE WHEN value > 30 THEN NULL ELSE id END, 'filled') AS id, CAST(CAST("at" AS DATE) AS VARCHAR) AS day FROM l
""", l=LOG))
def activity_append(spark, folder):
    log = _log(spark, folder).drop("day").withColumn("id", F.when(F.col("value") <= 30, F.col("id")))
    out = SA.with_day(log)
    filled = F.when(F.length("id") == 36, "filled").otherwise(F.col("id"))
    return out.select("seq", filled.alias("id"), F.col("day").cast("string").alias("day"))


def _lines(spark, folder):
    """Log lines as JSON, the lines of failed statements cut off in the middle."""
    rec = _log(spark, folder)
    line = F.to_json(F.struct("id", "seq", "session_id", "connection", "row_count"))
    cut = F.when(F.col("statement_type") == "DELETE", F.substring(line, 1, 25)).otherwise(line)
    return rec.select(cut.alias("value"))


@query("activity_read", with_tables("SELECT id, seq, row_count, (SELECT count(*) FROM l WHERE statement_type = 'DELETE') AS unreadable FROM l WHERE statement_type <> 'DELETE'", l=LOG))
def activity_read(spark, folder):
    parsed = SA.parse_lines(_lines(spark, folder))
    n = SA.unreadable_count(parsed).scalar()
    return SA.readable(parsed).select("id", "seq", "row_count").withColumn("unreadable", n)


@query("activity_encrypted", with_tables(f"SELECT id, seq, {_T} AS \"at\", statement, FALSE AS damaged FROM l", l=LOG))
def activity_encrypted(spark, folder):
    """Records encrypted one by one, and read back with the same key."""
    aes = keys(spark).select(F.lit("log").alias("name"), F.substring("ipad", 1, 32).alias("key"))
    key = SA.record_key(aes, "log")
    rec = _log(spark, folder).select("id", "at", "seq", "statement")
    out = SA.decrypted(SA.encrypted(rec, key), key)
    return out.select("id", "seq", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "statement", F.col(SA.BAD).isNotNull().alias("damaged"))
