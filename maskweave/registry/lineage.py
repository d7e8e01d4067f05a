"""Policies carried through relational operators: the query runs on raw values, its output is masked."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from maskweave.operators.masking import ColumnPolicy, Masking
from maskweave.plans import lineage as G
from maskweave.plans.writes import facts_rows
from maskweave.registry.base import (
    CUSTOMER_CATALOG, ESTATE, TABLES, derived, key, query, sql_token, table, views, with_tables,
)
from maskweave.session import shared_folder
from maskweave.sources import queries as Q

_R = "'⟨redacted⟩'"
_NAME = sql_token("person", "c_name")
_TABLES = frozenset(TABLES)


def masked_sql(name: str, sql: str, oracle: str, grain: str = "statement", before=None):
    """Register one statement: its result, masked by what flows into each column."""

    @query(name, oracle)
    def run(spark, folder):
        views(spark, folder, sql + " customer")
        if before:
            before(spark)
        return G.masked(spark.sql(sql), CUSTOMER_CATALOG, Masking({}, key=key(spark)), _TABLES, grain)

    return run


masked_sql("rel_scan", "SELECT * FROM customer",
           f"SELECT c_custkey, {_NAME} AS c_name, c_nationkey, {_R} AS c_acctbal, c_mktsegment FROM customer")
masked_sql("rel_projection", "SELECT c_custkey, upper(c_name) AS u, c_nationkey + 1 AS n FROM customer",
           f"SELECT c_custkey, {_R} AS u, {_R} AS n FROM customer")
masked_sql("rel_filter", "SELECT c_custkey, c_nationkey + 1 AS n FROM customer WHERE c_name LIKE '%7%' AND c_acctbal > 0",
           "SELECT c_custkey, c_nationkey + 1 AS n FROM customer WHERE c_name LIKE '%7%' AND c_acctbal > 0")
masked_sql("rel_equi_join", "SELECT c_name, o_orderkey, o_totalprice * 2 AS twice FROM customer JOIN orders ON c_custkey = o_custkey",
           f"SELECT {_NAME} AS c_name, o_orderkey, {_R} AS twice FROM customer JOIN orders ON c_custkey = o_custkey")
masked_sql("rel_theta_join", "SELECT n_name, p_partkey FROM nation JOIN part ON p_size > n_nationkey + 25 AND p_size < n_nationkey + 28",
           "SELECT n_name, p_partkey FROM nation JOIN part ON p_size > n_nationkey + 25 AND p_size < n_nationkey + 28")
masked_sql("rel_lateral_join", "SELECT n_name, x.names FROM nation, LATERAL (SELECT max(c_name) AS names FROM customer WHERE c_nationkey = n_nationkey) x",
           f"SELECT n_name, CASE WHEN names IS NOT NULL THEN {_R} END AS names FROM nation LEFT JOIN (SELECT c_nationkey, max(c_name) AS names FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
masked_sql("rel_aggregate", "SELECT c_nationkey, count(*) AS n, max(c_name) AS m FROM customer GROUP BY c_nationkey",
           f"SELECT c_nationkey, {_R} AS n, {_R} AS m FROM customer GROUP BY c_nationkey")
masked_sql("rel_aggregate_by_column", "SELECT c_nationkey, count(*) AS n, max(c_name) AS m FROM customer GROUP BY c_nationkey",
           f"SELECT c_nationkey, count(*) AS n, {_R} AS m FROM customer GROUP BY c_nationkey", grain="column")
masked_sql("rel_count_star", "SELECT count(*) AS n FROM customer WHERE c_name LIKE '%1%'", "SELECT count(*) AS n FROM customer WHERE c_name LIKE '%1%'")
masked_sql("rel_aggregate_filter", "SELECT c_nationkey, count(*) FILTER (WHERE c_name LIKE '%1') AS n FROM customer GROUP BY c_nationkey",
           f"SELECT c_nationkey, {_R} AS n FROM customer GROUP BY c_nationkey")
masked_sql("rel_distinct", "SELECT DISTINCT c_name, c_nationkey FROM customer",
           f"SELECT DISTINCT {_NAME} AS c_name, c_nationkey FROM customer")
masked_sql("rel_window", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS place FROM customer",
           f"SELECT c_custkey, {_R} AS place FROM customer")
masked_sql("rel_sort", "SELECT p_partkey, p_size + 1 AS s FROM part ORDER BY p_name, p_partkey",
           f"SELECT p_partkey, {_R} AS s FROM part")
masked_sql("rel_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5",
           "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
masked_sql("rel_union", "SELECT c_custkey AS k, c_name AS v FROM customer UNION ALL SELECT p_partkey, p_brand FROM part",
           f"SELECT {_R} AS k, {_R} AS v FROM customer UNION ALL SELECT {_R}, {_R} FROM part")
masked_sql("rel_union_allowed", "SELECT c_custkey AS k FROM customer UNION ALL SELECT p_partkey FROM part",
           "SELECT c_custkey AS k FROM customer UNION ALL SELECT p_partkey FROM part")
masked_sql("rel_intersect_except", "(SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) EXCEPT ALL SELECT p_partkey FROM part WHERE p_size > 25",
           "(SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) EXCEPT ALL SELECT p_partkey FROM part WHERE p_size > 25")
masked_sql("rel_cte", "WITH x AS (SELECT c_custkey, c_name, c_nationkey FROM customer) SELECT a.c_name, b.c_nationkey FROM x a JOIN x b USING (c_custkey)",
           f"SELECT {_NAME} AS c_name, c_nationkey FROM customer")
masked_sql("rel_recursive", """WITH RECURSIVE r(level, k) AS (SELECT 1, c_nationkey FROM customer UNION ALL SELECT level + 1, k FROM r WHERE level < 3)
SELECT level, k FROM r""",
           "SELECT l AS level, c_nationkey AS k FROM customer, range(1, 4) t(l)",
           # Spark ends a recursion at a million rows; this one ends by itself, after three levels.
           before=lambda spark: spark.conf.set("spark.sql.cteRecursionRowLimit", "-1"))
masked_sql("rel_subquery", "SELECT renamed, other FROM (SELECT c_name AS renamed, c_mktsegment AS other FROM customer) s",
           f"SELECT {_NAME} AS renamed, c_mktsegment AS other FROM customer")
masked_sql("rel_scalar_subquery", "SELECT o_orderkey, (SELECT max(c_name) FROM customer) AS top FROM orders",
           f"SELECT o_orderkey, {_R} AS top FROM orders")
masked_sql("rel_unnest", "SELECT p_partkey, explode(split(p_name, ' ')) AS word FROM part",
           f"SELECT p_partkey, {_R} AS word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) FROM part)")
masked_sql("rel_values_lateral", "SELECT n_nationkey, v.x FROM nation, LATERAL (SELECT explode(array(n_name, cast(n_regionkey AS string))) AS x) v",
           "SELECT n_nationkey, unnest([n_name, CAST(n_regionkey AS VARCHAR)]) AS x FROM nation")
masked_sql("rel_whole_row", "SELECT n_nationkey, to_json(struct(*)) AS row FROM nation",
           "SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS row FROM nation")
masked_sql("rel_repartition", "SELECT /*+ REPARTITION(4, c_nationkey) */ c_nationkey, c_name FROM customer",
           f"SELECT c_nationkey, {_NAME} AS c_name FROM customer")
masked_sql("rel_user_function", "SELECT n_nationkey, seen(n_nationkey) AS f FROM nation",
           f"SELECT n_nationkey, {_R} AS f FROM nation",
           before=lambda spark: spark.udf.register("seen", lambda x: str(x), "string"))
masked_sql("rel_view", "SELECT c_custkey, c_nationkey FROM customer_keys",
           f"SELECT {_R} AS c_custkey, {_R} AS c_nationkey FROM customer",
           before=lambda spark: spark.sql("CREATE OR REPLACE TEMP VIEW customer_keys AS SELECT c_custkey, c_nationkey FROM customer"))
masked_sql("rel_unknown_column", "SELECT s_suppkey, s_name FROM supplier", f"SELECT {_R} AS s_suppkey, {_R} AS s_name FROM supplier")


@query("run_bounded", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) > 1000 AS truncated FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000")
def run_bounded(spark, folder):
    return Q.run(views(spark, folder), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", max_rows=5000)


@query("run_bound_parameters", "SELECT c_custkey, c_name, count(*) OVER () > 1000 AS truncated FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000 ORDER BY c_custkey LIMIT 1000")
def run_bound_parameters(spark, folder):
    sql = "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = :segment AND c_acctbal > :low ORDER BY c_custkey"
    return Q.run(views(spark, folder), sql, {"segment": "BUILDING", "low": 9000})


_JOINED = "SELECT c.c_name AS n, upper(c_mktsegment) AS u, o_totalprice, o_totalprice + c_acctbal AS s FROM customer c JOIN orders o ON c_custkey = o_custkey WHERE o_orderstatus = 'F'"


@query("describe_statement", f"""
SELECT name, family, relation, "column", count(v) AS filled FROM (
  SELECT 'n' AS name, 'text' AS family, 'customer' AS relation, 'c_name' AS "column", n AS v FROM ({_JOINED})
  UNION ALL SELECT 'u', 'text', '', '', u FROM ({_JOINED}) UNION ALL SELECT 'o_totalprice', 'numeric', 'orders', 'o_totalprice', CAST(o_totalprice AS VARCHAR) FROM ({_JOINED})
  UNION ALL SELECT 's', 'numeric', '', '', CAST(s AS VARCHAR) FROM ({_JOINED})) GROUP BY ALL
""")
def describe_statement(spark, folder):
    """Output columns with their identity, from the analysed plan, and how many values each holds."""
    from maskweave.functions.types import family

    df = views(spark, folder, _JOINED).sql(_JOINED)
    found = G.lineage(df, _TABLES)
    rows = [
        (name, family(field.dataType), *((found.label(f.identity[0]), f.identity[1]) if f.identity else ("", "")))
        for (name, f), field in zip(found.outputs, df.schema.fields)
    ]
    meta = spark.createDataFrame(rows, "name string, family string, relation string, column string")
    counts = df.agg(*(F.count(c).alias(c) for c in df.columns))
    filled = counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("filled")) for c in df.columns))))
    return meta.join(filled, "name")


@query("statement_flows", """
SELECT * FROM (VALUES ('n', 'customer', 'c_name', TRUE), ('u', 'customer', 'c_mktsegment', FALSE), ('o_totalprice', 'orders', 'o_totalprice', TRUE),
  ('s', 'orders', 'o_totalprice', FALSE), ('s', 'customer', 'c_acctbal', FALSE)) v(output, relation, "column", direct), LATERAL (SELECT CASE relation WHEN 'orders' THEN (SELECT count(*) FROM orders) ELSE (SELECT count(*) FROM customer) END AS rows)
""")
def statement_flows(spark, folder):
    """Which columns reach each output, with the size of the relation they come from."""
    df = views(spark, folder, _JOINED).sql(_JOINED)
    flows = G.flow_rows(spark, G.lineage(df, _TABLES))
    sizes = [table(spark, folder, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("relation"), "rows") for t in ("orders", "customer")]
    return flows.join(sizes[0].unionByName(sizes[1]), "relation").select("output", "relation", "column", "direct", "rows")


@query("filter_columns", """
SELECT * FROM (VALUES ('customer', 'c_acctbal', 'sensitive', 'redact'), ('supplier', 's_name', 'unclassified', '')) v(relation, "column", flag, policy), LATERAL (SELECT CASE relation WHEN 'supplier' THEN (SELECT count(*) FROM supplier) ELSE (SELECT count(*) FROM customer) END AS rows)
""")
def filter_columns(spark, folder):
    """Columns a statement filters by that are masked or unknown, with the rows the filter reads."""
    sql = "SELECT count(*) AS n FROM customer, supplier WHERE c_acctbal > 0 AND s_name LIKE '%1' AND c_nationkey = s_nationkey AND c_nationkey < 5"
    catalog = CUSTOMER_CATALOG | {("supplier", "s_nationkey"): ColumnPolicy("allow")}
    found = G.lineage(views(spark, folder, sql).sql(sql), _TABLES)
    flagged = spark.createDataFrame(G.flagged_filters(found, catalog), "relation string, column string, flag string, policy string")
    sizes = [table(spark, folder, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("relation"), "rows") for t in ("supplier", "customer")]
    return flagged.join(sizes[0].unionByName(sizes[1]), "relation").select("relation", "column", "flag", "policy", "rows")


@query("statement_relations", """
SELECT 'customer' AS relation, count(*) AS rows FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders
""")
def statement_relations(spark, folder):
    sql = """WITH x AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)) SELECT o_orderkey FROM orders JOIN x ON c_custkey = o_custkey"""
    found = G.lineage(views(spark, folder, sql).sql(sql), _TABLES)
    parts = [table(spark, folder, r).agg(F.count("*").alias("rows")).select(F.lit(r).alias("relation"), "rows") for r in found.relations]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("opaque_statement", f"SELECT c_custkey, {_R} AS hidden, TRUE AS opaque, TRUE AS uncertain FROM customer")
def opaque_statement(spark, folder):
    """A function whose inside cannot be seen, with an effect nobody can rule out."""
    noisy = F.udf(lambda v: str(v), "string").asNondeterministic()
    df = views(spark, folder).sql("SELECT * FROM customer").select("c_custkey", noisy("c_nationkey").alias("hidden"))
    found = G.lineage(df, _TABLES)
    out = G.masked(df, CUSTOMER_CATALOG, Masking({}, key=key(spark)), _TABLES)
    return out.withColumn("opaque", F.lit(found.opaque)).withColumn("uncertain", F.lit(found.uncertain))


@query("dry_run", """
SELECT name, policy, basis, 'run' AS outcome, 'SELECT' AS statement_type, (SELECT count(*) FROM customer) AS rows FROM (VALUES ('c_name', 'token', 'catalog'), ('column_2', 'redact', 'inherited')) v(name, policy, basis)
""")
def dry_run(spark, folder):
    views(spark, folder)
    report = G.dry_run(
        spark, "SELECT c_name, max(c_acctbal) AS column_2 FROM customer GROUP BY c_name", CUSTOMER_CATALOG, _TABLES,
        lambda kind, writes: "ask" if writes else "run",
    )
    out = spark.createDataFrame(report["columns"], "name string, policy string, basis string")
    n = table(spark, folder, report["relations"][0]).agg(F.count("*")).scalar()
    return out.select("*", F.lit(report["outcome"]).alias("outcome"), F.lit(report["statement_type"]).alias("statement_type"), n.alias("rows"))


# Lineage kept as a table: each line item is a flow of a part's column into an order's output.
@query("inherit_strictest", with_tables("""
SELECT l_orderkey, CASE max(CASE WHEN e.p_size > 45 THEN 0 WHEN e.p_size > 40 THEN 3 WHEN e.p_size > 30 THEN 2 WHEN e.p_size > 15 THEN 1 ELSE 0 END) WHEN 3 THEN 'redact' WHEN 2 THEN 'redact' WHEN 1 THEN 'scan' ELSE 'allow' END AS policy
FROM lineitem JOIN e ON e.position = l_partkey GROUP BY l_orderkey
""", e=ESTATE))
def inherit_strictest(spark, folder):
    e = derived(spark, folder, ESTATE)
    size = F.col("p_size")
    policy = F.when(size > 45, "allow").when(size > 40, "redact").when(size > 30, "token").when(size > 15, "scan").otherwise("allow")
    flows = table(spark, folder, "lineitem").join(e, F.col("l_partkey") == F.col("position")).select("l_orderkey", "relation", "column")
    policies = e.select("relation", "column", policy.alias("policy"))
    return G.inherit(flows, policies, ["l_orderkey"])


@query("mask_same_names", f"""
SELECT c_custkey AS id, {_R} AS hidden, s_name AS shown, {_R} AS mixed, upper(s_name) AS computed, {sql_token('person', "'p' || c_custkey")} AS token
FROM customer JOIN supplier ON c_custkey = s_suppkey
""")
def mask_same_names(spark, folder):
    """Two relations called people, in two folders: each goes by its own policies."""
    place = f"{shared_folder(spark)}/same-names-{uuid.uuid4().hex}"
    tables = {"hr": ("customer", "c_custkey", "c_name"), "pub": ("supplier", "s_suppkey", "s_name")}
    for at, (name, number, label) in tables.items():
        rows = table(spark, folder, name).select(F.col(number).alias("id"), F.col(label).alias("name"), F.concat(F.lit("p"), number).alias("code"))
        rows.write.parquet(f"{place}/{at}/people.parquet")
    hr, pub = (spark.read.parquet(f"{place}/{at}/people.parquet") for at in tables)
    both = hr.join(pub, hr["id"] == pub["id"]).select(
        hr["id"], hr["name"].alias("hidden"), pub["name"].alias("shown"), F.concat(hr["name"], pub["name"]).alias("mixed"),
        F.upper(pub["name"]).alias("computed"), hr["code"].alias("token"),
    )
    allow, redact = ColumnPolicy("allow"), ColumnPolicy("redact")
    catalog = {
        ("hr/people", "id"): allow, ("hr/people", "name"): redact, ("hr/people", "code"): ColumnPolicy("token", "person"),
        ("pub/people", "id"): allow, ("pub/people", "name"): allow, ("pub/people", "code"): redact,
    }
    return G.masked(both, catalog, Masking({}, key=key(spark)), grain="column")


# What each kind of event in the log has run.
_LOGGED = {
    "view": "SELECT c_name, sum(o_totalprice) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY c_name",
    "click": "INSERT INTO copies SELECT c_custkey, c_name, c_acctbal FROM customer",
    "purchase": "MERGE INTO orders t USING customer s ON t.o_custkey = s.c_custkey AND s.c_acctbal > 0 WHEN MATCHED THEN DELETE",
    "signup": "WITH n AS (SELECT n_name FROM nation) FROM n INSERT INTO one SELECT n_name INSERT INTO two SELECT upper(n_name)",
    "error": "CREATE TABLE kept USING parquet AS SELECT p_name, p_size FROM part WHERE p_name LIKE 'red%'",
}


@query("statement_write_facts", """
SELECT event_id, f.* EXCLUDE (kind) FROM events JOIN (VALUES
  ('view', 'SELECT', '', 'customer,orders', 'c_name:token,total:redact', 'customer.c_acctbal', '1 column(s) redacted; 1 column(s) tokenized', 'read'),
  ('click', 'INSERT', 'spark_catalog.default.copies', 'customer', 'c_custkey:allow,c_name:token,c_acctbal:redact', '', '1 column(s) redacted; 1 column(s) tokenized', 'write'),
  ('purchase', 'MERGE', 'spark_catalog.default.orders', 'orders,customer', '', 'customer.c_acctbal', '', 'destructive'),
  ('signup', 'INSERT', 'spark_catalog.default.one,spark_catalog.default.two', 'nation', 'n_name:allow,upper(n_name):allow', '', '', 'write'),
  ('error', 'INSERT', 'spark_catalog.default.kept', 'part', 'p_name:redact,p_size:allow', 'part.p_name', '1 column(s) redacted', 'write')
) f(kind, statement_type, targets, relations, outputs, filters, egress, risk) ON event_type = kind
""")
def statement_write_facts(spark, folder):
    """Each logged event with the facts of its statement; a statement is analysed once, and never run."""
    for sql in _LOGGED.values():
        views(spark, folder, sql)
    f = facts_rows(spark, _LOGGED, CUSTOMER_CATALOG, _TABLES)
    flat = f.select(
        F.col("id").alias("event_type"), "statement_type", F.array_join("targets", ",").alias("targets"), F.array_join("relations", ",").alias("relations"),
        F.array_join(F.transform("outputs", lambda o: F.concat(o["name"], F.lit(":"), o["policy"])), ",").alias("outputs"),
        F.array_join(F.transform("filters", lambda x: F.concat(x["relation"], F.lit("."), x["column"])), ",").alias("filters"), "egress", "risk",
    )
    return table(spark, folder, "events").select("event_id", "event_type").join(F.broadcast(flat), "event_type").drop("event_type")
