"""Tokens, bindings and known-value replacement."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskweave.functions import policy as P
from maskweave.functions import tokens as K
from maskweave.operators import bindings as B
from maskweave.operators import emission as E
from maskweave.registry.base import (
    CONN, ESTATE, SESSION, derived, key, keys, query, rows, sql_tag, sql_token, table, with_tables,
)

NOW = "2024-01-20 00:00:00"

# Values with the spaces and cases people type: customers under two namespaces, in order of their key.
INPUTS = """
SELECT CASE WHEN c_nationkey < 12 THEN 'session-a' ELSE 'session-b' END AS session, 'warehouse' AS conn,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'email' ELSE 'person' END AS namespace,
       concat('  ', c_mktsegment, '.', c_nationkey, '@Example.com ') AS value, c_custkey AS seq
FROM customer
"""


@query("token_join_segments", """
SELECT c_mktsegment, count(*) AS orders, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
""")
def token_join_segments(spark, folder):
    k = key(spark)
    made = lambda c: K.token(k, "customer", F.col(c).cast("string"))
    customers = table(spark, folder, "customer").select(made("c_custkey").alias("token"), "c_mktsegment")
    orders = table(spark, folder, "orders").select(made("o_custkey").alias("token"), "o_totalprice")
    return orders.join(customers, "token").groupBy("c_mktsegment").agg(
        F.count("*").alias("orders"), F.count_distinct("token").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("token_values", f"SELECT c_custkey, {sql_token('person', 'c_name')} AS token FROM customer")
def token_values(spark, folder):
    k = key(spark)
    return table(spark, folder, "customer").select("c_custkey", K.token(k, "person", K.normalise(F.col("c_name"))).alias("token"))


@query("token_free_text", f"SELECT doc_id, {sql_token('text', 'trim(nfc_normalize(text), chr(32) || chr(9) || chr(10) || chr(13))')} AS token FROM documents")
def token_free_text(spark, folder):
    k = key(spark)
    return rows(spark, folder, "documents", "doc_id", "text").select("doc_id", K.token(k, "text", K.normalise(F.col("text"))).alias("token"))


@query("token_session_differs", f"""
SELECT c_custkey, {sql_token('person', 'c_name')} AS token_a, {sql_token('person', 'c_name', session='session-b')} AS token_b, TRUE AS differs
FROM customer
""")
def token_session_differs(spark, folder):
    a, b = key(spark, "session-a"), key(spark, "session-b")
    name = K.normalise(F.col("c_name"))
    out = table(spark, folder, "customer").select("c_custkey", K.token(a, "person", name).alias("token_a"), K.token(b, "person", name).alias("token_b"))
    return out.withColumn("differs", F.col("token_a") != F.col("token_b"))


@query("token_render", f"SELECT o_orderkey, '⟨order' || (o_orderkey % 9 + 1) || ':' || {sql_tag('o_orderkey::VARCHAR', 12)} || '⟩' AS token FROM orders")
def token_render(spark, folder):
    k = key(spark)
    tag = K.hmac_tag(k, F.col("o_orderkey").cast("string"), 12)
    return table(spark, folder, "orders").select("o_orderkey", K.format_token(F.lit("order"), F.col("o_orderkey") % 9 + 1, tag).alias("token"))


_TEXTS = """
SELECT event_id, CASE event_type WHEN 'view' THEN concat('⟨user', user_id, ':', event_id, 'af⟩') WHEN 'click' THEN concat('⟨', event_type, ':af⟩')
       WHEN 'purchase' THEN concat('⟨user1:xyz', user_id, '⟩') WHEN 'signup' THEN concat('⟨a', user_id, ':', event_id, '⟩ ') ELSE concat('⟨9', user_id, ':ab⟩') END AS text
FROM events
"""


@query("token_parse", with_tables("""
SELECT event_id, text, CASE WHEN ok THEN regexp_extract(text, p, 1) END AS namespace,
       CASE WHEN ok THEN CAST(regexp_extract(text, p, 2) AS BIGINT) END AS version, CASE WHEN ok THEN regexp_extract(text, p, 3) END AS tag
FROM (SELECT *, '^⟨([^:]*[^0-9:])([0-9]+):([0-9a-fA-F]+)⟩$' AS p, regexp_matches(text, '^⟨([^:]*[^0-9:])([0-9]+):([0-9a-fA-F]+)⟩$') AS ok FROM t)
""", t=_TEXTS))
def token_parse(spark, folder):
    return derived(spark, folder, _TEXTS).withColumn("p", K.parse_token(F.col("text"))).select("event_id", "text", "p.*")


@query("token_namespaces", with_tables("""
SELECT key, namespace, namespace <> '' AND NOT regexp_matches(namespace, '[0-9]$') AND NOT regexp_matches(namespace, '[:⟨⟩]') AS valid
FROM (SELECT position AS key, CASE WHEN p_size > 40 THEN '' WHEN p_size > 30 THEN concat(relation, ':x') WHEN p_size > 20 THEN relation ELSE concat(relation, 'x') END AS namespace FROM e)
""", e=ESTATE))
def token_namespaces(spark, folder):
    e = derived(spark, folder, ESTATE)
    size = F.col("p_size")
    ns = F.when(size > 40, "").when(size > 30, F.concat("relation", F.lit(":x"))).when(size > 20, F.col("relation")).otherwise(F.concat("relation", F.lit("x")))
    out = e.select(F.col("position").alias("key"), ns.alias("namespace"))
    return out.withColumn("valid", P.valid_namespace(F.col("namespace")))


@query("token_normalise", with_tables("""
SELECT seq, trim(value) AS plain, lower(trim(value)) AS folded FROM i
""", i=INPUTS))
def token_normalise(spark, folder):
    v = F.col("value")
    return derived(spark, folder, INPUTS).select("seq", K.normalise(v).alias("plain"), K.normalise(v, fold=True).alias("folded"))


@query("token_number_texts", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {sql_token('qty', 'CAST(l_quantity AS BIGINT)::VARCHAR')} AS quantity, {sql_token('id', 'l_partkey::VARCHAR')} AS part
FROM lineitem
""")
def token_number_texts(spark, folder):
    from maskweave.operators.masking import value_text

    k = key(spark)
    li = rows(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    tok = lambda ns, c: K.token(k, ns, value_text(F.col(c), li.schema[c].dataType))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tok("qty", "l_quantity").alias("quantity"), tok("id", "l_partkey").alias("part"))


@query("token_count_distinct", """
SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority
""")
def token_count_distinct(spark, folder):
    k = key(spark)
    o = table(spark, folder, "orders").select("o_orderpriority", K.token(k, "customer", F.col("o_custkey").cast("string")).alias("token"))
    return o.groupBy("o_orderpriority").agg(F.count_distinct("token").alias("customers"))


_SHORT = f"""
SELECT c_custkey AS seq, c_name AS value, {sql_token('person', 'c_name', K.TEST_TAG_HEX)} AS token FROM customer
"""


def _short_candidates(spark, folder):
    inputs = table(spark, folder, "customer").select(
        F.lit(SESSION).alias("session"), F.lit(CONN).alias("conn"), F.lit("person").alias("namespace"),
        F.col("c_name").alias("value"), F.col("c_custkey").alias("seq"),
    )
    with K.short_tags():
        return B.mint(inputs, keys(spark), F.lit(NOW).cast("timestamp"), hex_len=K.TEST_TAG_HEX)


@query("token_bind_first", with_tables("""
SELECT token, arg_min(value, seq) AS value, min(seq) AS seq, count(DISTINCT value) - 1 AS losers FROM t GROUP BY token
""", t=_SHORT))
def token_bind_first(spark, folder):
    return B.bind(_short_candidates(spark, folder)).select("token", "value", "seq", "losers")


@query("token_collision_4hex", with_tables("""
SELECT value, CASE WHEN value = first THEN token ELSE '⟨redacted⟩' END AS shown, value <> first AS collision
FROM (SELECT *, first_value(value) OVER (PARTITION BY token ORDER BY seq) AS first FROM t)
""", t=_SHORT))
def token_collision_4hex(spark, folder):
    c = _short_candidates(spark, folder)
    return B.tokens_or_redacted(c, B.bind(c)).select("value", "shown", "collision")


_MINTED = f"""
SELECT session, namespace, seq, trim(value) AS value, CASE namespace WHEN 'email' THEN lower(trim(value)) ELSE trim(value) END AS normalised,
       CASE WHEN session = 'session-a' AND namespace = 'email' THEN {sql_token('email', 'lower(trim(value))')}
            WHEN session = 'session-a' THEN {sql_token('person', 'trim(value)')}
            WHEN namespace = 'email' THEN {sql_token('email', 'lower(trim(value))', session='session-b')}
            ELSE {sql_token('person', 'trim(value)', session='session-b')} END AS token
FROM ({INPUTS}) i
"""


def _two_sessions(spark):
    return keys(spark, "session-a").unionByName(keys(spark, "session-b"))


def _minted(spark, folder):
    return B.mint(derived(spark, folder, INPUTS), _two_sessions(spark), F.lit(NOW).cast("timestamp"), frozenset({"email"}))


@query("token_mint", _MINTED)
def token_mint(spark, folder):
    return _minted(spark, folder).select("session", "namespace", "seq", "value", "normalised", "token")


# Bindings that expire one after another around the moment of the question.
_LIVE = with_tables("""
SELECT session, token, value, seq, CASE WHEN seq % 7 > 3 THEN 'live' ELSE 'gone' END AS state
FROM (SELECT session, token, arg_min(value, seq) AS value, min(seq) AS seq FROM m GROUP BY session, token)
""", m=_MINTED)


def _aged(spark, folder):
    now = F.lit(NOW).cast("timestamp")
    b = B.bind(_minted(spark, folder))
    return b.withColumn("expires", now + F.make_interval(hours=(F.col("seq") % 7 - 3).cast("int")))


@query("token_resolve", f"""
SELECT session, token, CASE WHEN state = 'live' THEN value END AS value, CASE WHEN state = 'live' THEN 'ok' ELSE 'stale_token' END AS status FROM ({_LIVE}) l
""")
def token_resolve(spark, folder):
    b = _aged(spark, folder)
    return B.resolve(b.select("session", "conn", "token"), b, F.lit(NOW).cast("timestamp")).select("session", "token", "value", "status")


@query("token_expiry", f"SELECT session, token, value FROM ({_LIVE}) l WHERE state = 'live'")
def token_expiry(spark, folder):
    return B.live(_aged(spark, folder), F.lit(NOW).cast("timestamp")).select("session", "token", "value")


@query("token_refresh", f"""
SELECT session, token, CASE WHEN state = 'live' AND session = 'session-a' THEN '2024-01-20 01:00:00'
       ELSE strftime(TIMESTAMP '{NOW}' + to_hours(seq % 7 - 3), '%Y-%m-%d %H:%M:%S') END AS expires FROM ({_LIVE}) l
""")
def token_refresh(spark, folder):
    b = _aged(spark, folder)
    used = b.where(F.col("session") == "session-a").select("session", "conn", "token")
    out = B.refreshed(b, used, F.lit(NOW).cast("timestamp"))
    return out.select("session", "token", F.date_format("expires", "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query("token_drop_session", f"SELECT session, token FROM ({_LIVE}) l WHERE session <> 'session-b'")
def token_drop_session(spark, folder):
    b = _aged(spark, folder)
    closed = b.where(F.col("session") == "session-b").select("session")
    return B.without_sessions(b, closed).select("session", "token")


@query("token_key_versions", f"""
SELECT c_custkey, CASE WHEN c_acctbal < 3000 THEN {sql_token('person', 'c_name')} WHEN c_acctbal < 6000 THEN {sql_token('person', 'c_name', version=2)}
       ELSE replace({sql_token('person', 'c_name')}, '⟨person1', '⟨person7') END AS token,
       CASE WHEN c_acctbal < 3000 THEN 'retained' WHEN c_acctbal < 6000 THEN 'current' ELSE 'unknown' END AS state
FROM customer
""")
def token_key_versions(spark, folder):
    both = keys(spark, versions=(1, 2))
    old = K.key_of(both.where("version = 1"))
    new = K.current_key(both, CONN, SESSION)
    name, bal = K.normalise(F.col("c_name")), F.col("c_acctbal")
    t1 = K.token(old, "person", name)
    tok = F.when(bal < 3000, t1).when(bal < 6000, K.token(new, "person", name)).otherwise(F.replace(t1, F.lit("⟨person1"), F.lit("⟨person7")))
    made = table(spark, folder, "customer").select("c_custkey", F.lit(CONN).alias("conn"), F.lit(SESSION).alias("session"), tok.alias("token"))
    return B.by_version(made, both).select("c_custkey", "token", "state")


@query("token_as_filter", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey < 12)
""")
def token_as_filter(spark, folder):
    c = table(spark, folder, "customer")
    inputs = c.select(
        F.when(F.col("c_nationkey") < 12, "session-a").otherwise("session-b").alias("session"), F.lit(CONN).alias("conn"),
        F.lit("customer").alias("namespace"), F.col("c_custkey").cast("string").alias("value"), F.col("c_custkey").alias("seq"), "c_mktsegment",
    )
    now = F.lit(NOW).cast("timestamp")
    minted = B.mint(inputs, _two_sessions(spark), now, compose=False)
    wanted = B.mint(inputs.where("c_mktsegment = 'MACHINERY'"), _two_sessions(spark), now, compose=False)
    tokens = wanted.where("session = 'session-a'").select("session", "conn", "token")
    orders = table(spark, folder, "orders").withColumn("key", F.col("o_custkey").cast("string"))
    return B.where_token(orders, "key", tokens, B.bind(minted), now).select("o_orderkey", "o_custkey")


# Known values: the email addresses written in documents, longest form as found.
_FOUND = r"""
SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}')) AS value FROM documents
"""


def _known_emails(spark, folder):
    from maskweave.functions import detect as D

    found = rows(spark, folder, "documents", "text").select(F.explode(D.matched(F.col("text"), D.EMAIL)).alias("value")).distinct()
    k = key(spark)
    return found.select(
        "value", F.lower("value").alias("normalised"),
        K.token(k, "email", K.normalise(F.lower("value"), compose=False)).alias("token"), F.xxhash64("value").alias("seq"),
    )


@query("known_value_replace", rf"""
WITH hit AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z0-9._%+-]{{1,64}}@(?:[A-Za-z0-9-]{{1,63}}\.){{1,8}}[A-Za-z]{{2,24}}') AS m FROM documents)
SELECT doc_id, md5(CASE WHEN len(m) = 0 THEN text ELSE list_reduce(list_prepend(text, list_distinct(m)), lambda t, v: replace(t, v, {sql_token('email', 'lower(v)')})) END) AS digest,
       len(m) AS hits FROM hit
""")
def known_value_replace(spark, folder):
    entries = E.patterns(_known_emails(spark, folder))
    out = E.replace_known(rows(spark, folder, "documents", "doc_id", "text"), ["text"], entries, counts=True)
    return out.select("doc_id", F.md5("text").alias("digest"), F.col("text_hits").cast("long").alias("hits"))


@query("known_value_replace_by_join", rf"""
WITH hit AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z0-9._%+-]{{1,64}}@(?:[A-Za-z0-9-]{{1,63}}\.){{1,8}}[A-Za-z]{{2,24}}') AS m FROM documents)
SELECT doc_id, md5(CASE WHEN len(m) = 0 THEN text ELSE list_reduce(list_prepend(text, list_distinct(m)), lambda t, v: replace(t, v, {sql_token('email', 'lower(v)')})) END) AS digest,
       len(m) AS hits FROM hit
""")
def known_value_replace_by_join(spark, folder):
    entries = E.patterns(_known_emails(spark, folder))
    out = E.replace_known(rows(spark, folder, "documents", "doc_id", "text"), ["text"], entries, counts=True, small=False)
    return out.select("doc_id", F.md5("text").alias("digest"), F.col("text_hits").cast("long").alias("hits"))


@query("known_value_places")
def known_value_places(spark, folder):
    return E.occurrences(table(spark, folder, "documents"), "doc_id", "text", E.patterns(_known_emails(spark, folder)), overlapping=True)


# Words of part names as values: nested and overlapping on purpose, searched in part names.
_PART_WORDS = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS value FROM part"


def _part_words(spark, folder):
    parts = table(spark, folder, "part")
    words = parts.select(F.explode(F.split("p_name", " ")).alias("value")).union(parts.select("p_name"))
    pairs = words.distinct().withColumn("normalised", F.col("value"))
    return pairs.withColumn("token", F.concat(F.lit("⟨word1:"), F.substring(F.sha2("value", 256), 1, 16), F.lit("⟩"))).withColumn("seq", F.length("value"))


_WORD_HITS = """
WITH v AS (SELECT DISTINCT value FROM (SELECT unnest(string_split(p_name, ' ')) AS value FROM part UNION ALL SELECT p_name FROM part) WHERE length(value) > 3),
     n AS (SELECT DISTINCT p_name FROM part),
     h AS (SELECT p_name, i.i - 1 AS start, i.i - 1 + length(value) AS "end" FROM n, v, range(1, 200) i(i) WHERE substr(p_name, CAST(i.i AS BIGINT), length(value)) = value AND length(p_name) >= i.i)
"""


@query("overlap_resolution", _WORD_HITS + """
SELECT p_partkey, min(start) AS start, max("end") AS "end", count(*) AS hits
FROM part JOIN (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY start, "end" DESC) = 1) USING (p_name) GROUP BY p_partkey
""")
def overlap_resolution(spark, folder):
    entries = E.patterns(_part_words(spark, folder))
    hits = E.occurrences(table(spark, folder, "part"), "p_partkey", "p_name", entries)
    return hits.groupBy("p_partkey").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("hits"))


@query("overlap_covered", _WORD_HITS + """
SELECT p_partkey, start, "end", coalesce(start < max("end") OVER (PARTITION BY p_partkey ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS covered
FROM part JOIN h USING (p_name)
""")
def overlap_covered(spark, folder):
    """Names repeat from part to part: each is searched, and its places compared, once."""
    entries = E.patterns(_part_words(spark, folder))
    parts = table(spark, folder, "part").select("p_partkey", F.sha2("p_name", 256).alias("id"), F.col("p_name").alias("text"))
    hits = E.overlaps_by_window(E.window_hits(parts, entries, repeated=True))
    return parts.join(hits, "id").select("p_partkey", "start", "end", "covered")


@query("case_folding", r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}')) AS text_hits FROM documents""")
def case_folding(spark, folder):
    upper = rows(spark, folder, "documents", "doc_id", "text").withColumn("text", F.upper("text"))
    return E.replace_known(upper, ["text"], E.patterns(_known_emails(spark, folder)), counts=True).select("doc_id", F.col("text_hits").cast("long").alias("text_hits"))


_SHORT_CELLS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 25 THEN concat(' ', lower(l_returnflag), ' ') ELSE concat(l_returnflag, l_linestatus) END AS cell FROM lineitem
"""


@query("short_value_match", with_tables("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE lower(trim(cell)) WHEN 'r' THEN '⟨flag1:aa⟩' WHEN 'no' THEN '⟨flag1:bb⟩' ELSE cell END AS cell FROM c
""", c=_SHORT_CELLS))
def short_value_match(spark, folder):
    cells = derived(spark, folder, _SHORT_CELLS)
    flags = table(spark, folder, "lineitem").select(F.explode(F.array("l_returnflag", F.concat("l_linestatus", F.lit("o")))).alias("value")).distinct()
    bound = flags.where("value in ('R', 'Oo', 'Fo')").select(
        F.when(F.col("value") == "R", "R").when(F.col("value") == "Oo", "No").otherwise("nO").alias("value"),
        F.when(F.col("value") == "R", "⟨flag1:aa⟩").otherwise("⟨flag1:bb⟩").alias("token"),
        F.when(F.col("value") == "Fo", 2).otherwise(1).alias("seq"),
    ).withColumn("normalised", F.col("value"))
    return E.replace_known(cells, ["cell"], E.patterns(bound))


_BRACKETS = """
SELECT event_id, CASE event_type WHEN 'view' THEN '⟨event1:aa⟩ and view' WHEN 'click' THEN '⟨look-alike click⟩' WHEN 'purchase' THEN '⟨redacted:purchase⟩ purchase'
       WHEN 'signup' THEN '⟨redacted:signup_x⟩ signup ⟨redacted⟩' ELSE 'error' END AS text FROM events
"""


def _event_words(spark, folder):
    kinds = table(spark, folder, "events").groupBy("event_type").agg(F.min("event_id").alias("seq")).where("event_type <> 'error'")
    word = F.col("event_type")
    tag = F.when(word == "view", "aa").when(word == "click", "bb").when(word == "purchase", "cc").otherwise("dd")
    return E.patterns(
        kinds.select(word.alias("value"), word.alias("normalised"), F.concat(F.lit("⟨event1:"), tag, F.lit("⟩")).alias("token"), "seq")
    )


@query("own_tokens_kept", with_tables("""
SELECT event_id, CASE text WHEN '⟨event1:aa⟩ and view' THEN '⟨event1:aa⟩ and ⟨event1:aa⟩' WHEN '⟨look-alike click⟩' THEN '⟨look-alike ⟨event1:bb⟩⟩'
       WHEN '⟨redacted:purchase⟩ purchase' THEN '⟨redacted:⟨event1:cc⟩⟩ ⟨event1:cc⟩' WHEN '⟨redacted:signup_x⟩ signup ⟨redacted⟩' THEN '⟨redacted:signup_x⟩ ⟨event1:dd⟩ ⟨redacted⟩' ELSE text END AS text
FROM t
""", t=_BRACKETS))
def own_tokens_kept(spark, folder):
    return E.replace_known(derived(spark, folder, _BRACKETS), ["text"], _event_words(spark, folder))


@query("own_tokens_kept_by_join", with_tables("""
SELECT event_id, CASE text WHEN '⟨event1:aa⟩ and view' THEN '⟨event1:aa⟩ and ⟨event1:aa⟩' WHEN '⟨look-alike click⟩' THEN '⟨look-alike ⟨event1:bb⟩⟩'
       WHEN '⟨redacted:purchase⟩ purchase' THEN '⟨redacted:⟨event1:cc⟩⟩ ⟨event1:cc⟩' WHEN '⟨redacted:signup_x⟩ signup ⟨redacted⟩' THEN '⟨redacted:signup_x⟩ ⟨event1:dd⟩ ⟨redacted⟩' ELSE text END AS text
FROM t
""", t=_BRACKETS))
def own_tokens_kept_by_join(spark, folder):
    return E.replace_known(derived(spark, folder, _BRACKETS), ["text"], _event_words(spark, folder), small=False)


@query("search_entries", with_tables("""
SELECT pattern, short, arg_min(token, seq * 10 + k) AS token FROM (
  SELECT lower(value) AS pattern, octet_length(encode(value)) < 4 AS short, token, seq, 0 AS k FROM m
  UNION ALL SELECT lower(normalised), octet_length(encode(normalised)) < 4, token, seq, 1 FROM m)
GROUP BY pattern, short
""", m=_MINTED))
def search_entries(spark, folder):
    return E.patterns(_minted(spark, folder)).select("pattern", "short", "token")


@query("replacement_counts", with_tables("""
SELECT CAST(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM events
""", t=_BRACKETS))
def replacement_counts(spark, folder):
    out = E.replace_known(derived(spark, folder, _BRACKETS), ["text"], _event_words(spark, folder), counts=True)
    return out.agg(F.sum("text_hits").alias("hits"))
