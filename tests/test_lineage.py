import pytest

from maskweave.operators.masking import ColumnPolicy
from maskweave.plans import lineage as G

TABLES = frozenset({"people", "sales"})
CATALOG = {
    ("people", "id"): ColumnPolicy("allow"), ("people", "email"): ColumnPolicy("token", "email"), ("people", "doc"): ColumnPolicy("allow", paths={"$.a": ("allow", "")}),
    ("sales", "pid"): ColumnPolicy("allow"), ("sales", "total"): ColumnPolicy("allow"), ("sales", "note"): ColumnPolicy("scan"),
}


@pytest.fixture(scope="module")
def views(spark):
    spark.createDataFrame([(1, "a@b.co", "{}")], "id int, email string, doc string").createOrReplaceTempView("people")
    spark.createDataFrame([(1, 2.5, "n")], "pid int, total double, note string").createOrReplaceTempView("sales")
    return spark


# Statement, policy of each output under the statement grain, and under the column grain.
CASES = [
    ("SELECT email AS e, id FROM people", ["token", "allow"], ["token", "allow"]),
    ("SELECT upper(email), id + 1 FROM people", ["redact", "redact"], ["redact", "allow"]),
    ("SELECT count(*) FROM people WHERE email = 'x'", ["allow"], ["allow"]),
    ("SELECT pid, sum(total) FROM sales GROUP BY pid ORDER BY max(note)", ["allow", "scan"], ["allow", "allow"]),
    ("SELECT length(doc) FROM people", ["redact"], ["redact"]),
    ("SELECT total FROM sales UNION ALL SELECT id FROM people", ["allow"], ["allow"]),
    ("SELECT CASE WHEN email > 'm' THEN 1 ELSE 0 END FROM people", ["redact"], ["redact"]),
    ("SELECT id FROM people JOIN sales ON id = pid", ["allow"], ["allow"]),
    ("SELECT 1 AS one", ["allow"], ["allow"]),
    ("SELECT rand() > 2 AS r, note FROM sales", ["scan", "scan"], ["allow", "scan"]),
]


@pytest.mark.parametrize("sql, statement, column", CASES)
def test_output_policies(views, sql, statement, column):
    found = G.lineage(views.sql(sql), TABLES)
    assert [p.policy for p in G.output_policies(found, CATALOG)] == statement
    assert [p.policy for p in G.output_policies(found, CATALOG, grain="column")] == column


def test_view_has_its_own_identity(views):
    views.sql("CREATE OR REPLACE TEMP VIEW ids AS SELECT id FROM people")
    found = G.lineage(views.sql("SELECT id, id * 2 AS twice FROM ids"), TABLES)
    assert [p.policy for p in G.output_policies(found, CATALOG)] == ["redact", "allow"]


def test_unseen_code_is_opaque(views):
    df = views.sql("SELECT * FROM sales").mapInPandas(lambda batches: batches, "pid int")
    assert [p.policy for p in G.output_policies(G.lineage(df, TABLES), CATALOG)] == ["redact"]


def test_parameter_policy_without_relations(views):
    found = G.lineage(views.sql("SELECT concat('hi ', :v) AS x", args={"v": "secret"}), TABLES)
    out = G.output_policies(found, CATALOG, parameter_policy="token")
    assert [(p.policy, p.basis) for p in out] == [("redact", "parameter")]


def test_other_relations_are_named_and_policed(spark, tmp_path):
    path = str(tmp_path / "people.parquet")
    spark.createDataFrame([(1, "a@b.example")], "id int, email string").write.parquet(path)
    catalog = {("people", "id"): ColumnPolicy("allow"), ("people", "email"): ColumnPolicy("token", "email")}
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    spark.conf.set("spark.sql.sources.useV1SourceList", "")
    try:
        found = G.lineage(spark.read.parquet(path).select("id", "email"))
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", before)
    assert found.relations == ["people"] and [p.policy for p in G.output_policies(found, catalog)] == ["allow", "token"]
    files = spark.readStream.schema("id int, email string").parquet(path).select("id", "email")
    found = G.lineage(files)
    assert found.relations == ["people"] and [p.policy for p in G.output_policies(found, catalog)] == ["allow", "token"]
    rate = G.lineage(spark.readStream.format("rate").load().select("value"))
    assert [p.policy for p in G.output_policies(rate, catalog)] == ["redact"]
