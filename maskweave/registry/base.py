"""Registration, table access and tables derived from the given ones, in SQL both engines read alike."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.functions import tokens as K
from maskweave.operators.masking import ColumnPolicy
from maskweave.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = tuple(
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rows(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a given table, over all cores: for work that is heavy per row."""
    return spread(table(spark, folder, name).select(*columns))


def views(spark: SparkSession, folder: str, sql: str = "") -> SparkSession:
    """The given tables as temporary views, for statements written in SQL: those a text names, or all."""
    words = set(re.findall(r"\w+", sql))
    for name in TABLES:
        if not sql or name in words:
            table(spark, folder, name).createOrReplaceTempView(name)
    return spark


# Keys for examples only. A real job reads its key table from a protected folder.
EXAMPLE_KEYS = {1: b"first example key", 2: b"second example key"}
CONN, SESSION = "warehouse", "session-a"


def keys(spark: SparkSession, session: str = SESSION, versions: tuple[int, ...] = (1,)) -> DataFrame:
    return K.key_table(spark, K.key_rows(CONN, session, {v: EXAMPLE_KEYS[v] for v in versions}))


def key(spark: SparkSession, session: str = SESSION) -> K.Key:
    return K.current_key(keys(spark, session), CONN, session)


def sql_tag(message: str, hex_len: int = K.TAG_HEX, session: str = SESSION, version: int = 1) -> str:
    """HMAC-SHA256 of a text in SQL, from the definition of HMAC."""
    ipad, opad = (p.hex() for p in K.key_pads(K.session_key(EXAMPLE_KEYS[version], session)))
    inner = f"unhex(sha256(unhex('{ipad}') || encode({message})))"
    return f"substr(sha256(unhex('{opad}') || {inner}), 1, {hex_len})"


def sql_token(namespace: str, value: str, hex_len: int = K.TAG_HEX, session: str = SESSION, version: int = 1) -> str:
    return f"('⟨{namespace}{version}:' || {sql_tag(f"'{namespace}' || {value}", hex_len, session, version)} || '⟩')"


WORDS = (
    "email", "mobile", "ssn", "birth_date", "salary", "full_name", "street", "iban", "api_key", "name",
    "status", "notes", "emailer", "work_email_old", "tier", "first_name", "token", "amount", "created", "payload",
    "e_mail", "hash", "unpaid", "customer_name", "city",
)

# Columns of a large estate of tables, one per part: names, types and statistics vary with the part.
ESTATE = f"""
SELECT concat('s', p_size % 4) AS schema,
       concat(lower(p_type), '_', CASE WHEN word = 'name' THEN p_partkey ELSE p_size END, '_', CAST(floor(p_partkey / 4000) AS BIGINT)) AS relation,
       CASE WHEN p_retailprice % 10 < 1 THEN 'v' WHEN p_retailprice % 10 < 2 THEN 'm' ELSE 'r' END AS kind,
       CASE WHEN word = 'name' THEN 'name' ELSE concat(word, '_', p_partkey) END AS column,
       CAST(p_partkey AS INT) AS position,
       CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'bigint' WHEN p_type = 'PROMO' AND p_size > 40 THEN 'json'
            WHEN p_type = 'MEDIUM' AND p_size > 30 THEN 'boolean' WHEN p_type = 'MEDIUM' AND p_size > 20 THEN 'timestamp'
            WHEN p_type = 'MEDIUM' AND p_size > 10 THEN 'uuid' WHEN p_type = 'MEDIUM' THEN 'binary' ELSE 'string' END AS type,
       CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'numeric'
            WHEN p_type = 'MEDIUM' AND p_size > 30 THEN 'boolean' WHEN p_type = 'MEDIUM' AND p_size > 20 THEN 'datetime'
            WHEN p_type = 'MEDIUM' AND p_size > 10 THEN 'uuid' WHEN p_type = 'MEDIUM' THEN 'unknown' ELSE 'text' END AS family,
       p_size > 25 AS nullable, p_name LIKE 'red%' AS is_pk, p_name LIKE 'blue%' AS is_fk,
       p_name LIKE '%ring' AS has_default, p_name LIKE '%bolt' AS is_identity,
       p_size, p_retailprice, p_brand
FROM (SELECT *, CASE p_size % {len(WORDS)} {' '.join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS))} END AS word FROM part) w
"""
STATS = f"""
SELECT schema, relation, "column", CAST(p_size * 4 AS DOUBLE) AS "distinct", p_retailprice / 40 AS avg_width
FROM ({ESTATE}) e WHERE p_brand <> 'Brand#7'
"""
# What people have decided, and what an older rule had filled in.
COMMITTED = f"""
SELECT schema, relation, "column", CASE WHEN p_size > 35 THEN 'allow' WHEN p_size > 28 THEN 'token' ELSE 'redact' END AS policy,
       CASE WHEN p_size <= 35 AND p_size > 28 THEN 'email' ELSE '' END AS namespace
FROM ({ESTATE}) e WHERE p_size > 20
"""
OVERLAY = f"""
SELECT schema, relation, "column", CASE WHEN p_size > 15 THEN 'scan' WHEN p_size > 8 THEN 'redact' ELSE 'allow' END AS policy,
       '' AS namespace
FROM ({ESTATE}) e WHERE p_size <= 24 AND p_size > 2
"""
WANTED = f"""
SELECT schema, relation, "column", CASE WHEN p_brand < 'Brand#2' THEN 'token' WHEN p_brand < 'Brand#3' THEN 'redact' ELSE 'scan' END AS policy,
       CASE WHEN p_brand < 'Brand#2' THEN 'person' ELSE '' END AS namespace
FROM ({ESTATE}) e WHERE p_size < 30
"""

# An activity log: two records per id, the second one the outcome of the first.
LOG = """
SELECT concat('r', CAST(floor(event_id / 2) AS BIGINT)) AS id, ts AS at, event_id AS seq,
       concat('s', user_id) AS session_id, concat('c', user_id % 5) AS connection,
       concat('SELECT * FROM orders WHERE o_orderkey = ', event_id) AS statement,
       CASE event_type WHEN 'view' THEN 'SELECT' WHEN 'click' THEN 'UPDATE' WHEN 'purchase' THEN 'INSERT'
            WHEN 'signup' THEN 'MERGE' ELSE 'DELETE' END AS statement_type,
       CASE WHEN value > 20 THEN 3 WHEN value > 10 THEN 2 WHEN value > 3 THEN 1 ELSE 0 END AS relation_count,
       user_id AS row_count,
       CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'signup' THEN 'refused' WHEN 'click' THEN 'expired' ELSE '' END AS decision,
       CASE WHEN user_id < 40 THEN 'dialog' WHEN user_id < 80 THEN 'ui' WHEN user_id < 120 THEN concat('u', user_id) ELSE '' END AS approver,
       CASE WHEN event_type = 'error' AND value > 10 THEN 'timeout' WHEN value > 15 THEN 'approval_required'
            WHEN value > 12 THEN 'approval_refused' ELSE '' END AS error_code,
       CAST(ts AS DATE) AS day, value
FROM events
"""

# Profiles of a source each, one per customer, on hosts that are nations.
PROFILES = """
SELECT concat('p', c_custkey) AS id, concat(c_mktsegment, '-', c_nationkey, '-', CAST(floor(c_acctbal / 10) AS BIGINT)) AS name,
       concat('h', c_nationkey) AS host_id, concat(c_mktsegment, '_', CAST(floor(c_custkey / 4000) AS BIGINT)) AS database,
       CASE WHEN c_acctbal < 0 THEN '' WHEN c_acctbal < 3000 THEN 'always' WHEN c_acctbal < 5000 THEN 'never'
            WHEN c_acctbal < 8000 THEN 'uncertain' ELSE 'sometimes' END AS reads,
       CASE WHEN c_acctbal < 2000 THEN 'off' WHEN c_acctbal < 4000 THEN 'ask' WHEN c_acctbal < 6000 THEN 'allow' ELSE 'approve' END AS writes,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'off' WHEN 'MACHINERY' THEN 'all' WHEN 'HOUSEHOLD' THEN 'everything' ELSE 'scan' END AS detection
FROM customer
"""
HOSTS = "SELECT concat('h', n_nationkey) AS host_id, lower(n_name) AS name, concat('10.0.0.', n_nationkey) AS address FROM nation WHERE n_regionkey < 4"

# Facts of planned statements, one per line item.
FACTS = """
SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS id, concat('p', l_suppkey) AS connection,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 40 THEN 'DDL' WHEN l_returnflag = 'R' THEN 'DELETE'
            WHEN l_quantity > 40 THEN 'MERGE' WHEN l_quantity > 30 THEN 'UPDATE' WHEN l_quantity > 25 THEN 'INSERT' ELSE 'SELECT' END AS statement_type,
       NOT (l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 40) AND (l_returnflag = 'R' OR l_quantity > 25) AS writes,
       l_discount > 0.05 AS uncertain, l_tax > 0.04 AS masked, l_tax > 0.06 AS unresolved, l_discount < 0.02 AS stale
FROM lineitem
"""


def derived(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """A derived table in Spark, which quotes names its own way."""
    return views(spark, folder, sql).sql(sql.replace('"', "`"))


def with_tables(body: str, **tables: str) -> str:
    """SQL with derived tables in front."""
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in tables.items()) + "\n" + body


def relations_of(count: str) -> Column:
    """Relations of a log record by their number, as the records' array type."""
    return F.expr(
        "slice(array(named_struct('schema', 'main', 'relation', 'orders'), named_struct('schema', 'main', 'relation', 'customer'), "
        f"named_struct('schema', 'ref', 'relation', 'nation')), 1, {count})"
    )


CUSTOMER_CATALOG = {
    ("customer", "c_custkey"): ColumnPolicy("allow"),
    ("customer", "c_name"): ColumnPolicy("token", "person"),
    ("customer", "c_nationkey"): ColumnPolicy("allow"),
    ("customer", "c_acctbal"): ColumnPolicy("redact"),
    ("customer", "c_mktsegment"): ColumnPolicy("scan"),
    **{("orders", c): ColumnPolicy("allow") for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")},
    ("orders", "o_orderpriority"): ColumnPolicy("redact"),
    **{("nation", c): ColumnPolicy("allow") for c in ("n_nationkey", "n_name", "n_regionkey")},
    **{("part", c): ColumnPolicy("allow") for c in ("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")},
    ("part", "p_name"): ColumnPolicy("redact"),
}
