import pytest
from pyspark.sql import functions as F

from maskweave.functions import tokens
from maskweave.operators import bounds, jsonpaths
from maskweave.operators import propose as O
from maskweave.session import cut_lineage, fits_broadcast
from maskweave.sources import activity, policies, queries, schema, statistics

PATHS = "paths map<string, struct<policy: string, namespace: string>>"


def test_policy_file_round_trip_and_refusal(spark, tmp_path):
    rows = [("s", "t", "a.b", "token", "email", {}), ("s", "t", "c", "allow", "", {"$.x": ("redact", "")}), ("s", "u", "d", "scan", "", {})]
    entries = spark.createDataFrame(rows, f"schema string, relation string, column string, policy string, namespace string, {PATHS}")
    policies.save(entries, str(tmp_path / "good"))
    got = policies.load(spark, str(tmp_path / "good"))
    assert sorted((r.schema, r.relation, r.column, r.policy, r.namespace) for r in got.collect()) == sorted(r[:5] for r in rows)
    (tmp_path / "odd.json").write_text('{"version": 1, "schemas": {"s": {"t": {"c": {"policy": "new-policy", "namespace": ""}}}}}')
    assert policies.load(spark, str(tmp_path / "odd.json")).first().policy == "redact"
    for bad in ('{"version": 9, "schemas": {"s": {"t": {"c": {"policy": "allow"}}}}}', '{"version": 1, "schemas": {"s": {"t": {"c": {"policy": "token"}}}}}'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(Exception, match="unsupported version|token requires a namespace"):
            policies.load(spark, str(tmp_path / "bad.json")).collect()


def test_activity_log_files(spark, tmp_path):
    rec = spark.sql("SELECT CAST(NULL AS STRING) AS id, TIMESTAMP '2026-01-01 23:30:00' AS at, 1L AS seq UNION ALL SELECT 'b', TIMESTAMP '2026-01-02 00:10:00', 2L")
    activity.append(rec, str(tmp_path / "log"))
    activity.append(rec, str(tmp_path / "log"))
    back = activity.read(spark, str(tmp_path / "log"))
    assert {(str(r.day), r["count"]) for r in back.groupBy("day").count().collect()} == {("2026-01-01", 2), ("2026-01-02", 2)}
    assert back.where("id is null").count() == 0
    (tmp_path / "lines.json").write_text('{"id": "a", "seq": 1}\n{"id": "b", \n{"id": "c", "seq": 3}\n')
    lines = activity.read_lines(spark, str(tmp_path / "lines.json")).cache()
    assert activity.unreadable_count(lines).first()[0] == 1
    assert [r.id for r in activity.readable(lines).orderBy("id").collect()] == ["a", "c"]


def test_encrypted_records_do_not_show_and_damage_is_kept(spark):
    key = F.lit(bytes(range(32)))
    rec = spark.createDataFrame([("a", 1), ("b", 2)], "id string, seq long")
    lines = activity.encrypted(rec, key).union(spark.createDataFrame([("not base64!",)], "value string"))
    out = activity.decrypted(lines, key, "id string, seq long").collect()
    assert sorted((r.id, r.seq) for r in out if r[activity.BAD] is None) == [("a", 1), ("b", 2)]
    assert [r[activity.BAD] for r in out if r[activity.BAD] is not None] == ["not base64!"]


def test_statistics_sketch_is_one_pass(spark):
    df = spark.range(1000).select((F.col("id") % 7).cast("string").alias("a"), F.lit("xx").alias("b"), "id")
    got = {r["column"]: (r["distinct"], r.avg_width) for r in schema.text_stats({"t": df}).collect()}
    assert got == {"a": (7.0, 1.0), "b": (1.0, 2.0)}


def test_byte_cap_of_an_oversized_first_row(spark):
    df = spark.createDataFrame([(1, "x" * 100), (2, "y")], "k int, t string")
    assert bounds.bounded(df, [F.col("k")], 10, 50).count() == 0
    assert [r.truncated_by for r in bounds.bounded(df, [F.col("k")], 1).collect()] == ["rows"]


def test_broadcast_bound_is_measured(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("t"))
    assert fits_broadcast(df, "t")
    assert not fits_broadcast(df, "t", rows=99)
    assert not fits_broadcast(df, "t", size=10)


def test_checkpoint_keeps_rows(spark):
    assert cut_lineage(spark.range(5)).count() == 5


def test_json_edges(spark):
    docs = ['{"a":1}', "[1]", " {} ", '{"a":1}}', '{"a":1} {', '{"a":1}] [', '{"a":1},{"b":2}', "1", '"x"', "nul", '{"a":1,"a":2}', None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string")
    got = [r[1] for r in df.select("i", jsonpaths.mask_unless_container(F.col("d"))).orderBy("i").collect()]
    assert got == docs[:3] + ["⟨redacted⟩"] * 8 + [None]
    walked = [r[1] for r in df.select("i", jsonpaths.mask_paths(F.col("d"), {"$.a": ("allow", ""), "$[*]": ("allow", "")}, None)).orderBy("i").collect()]
    assert walked == ['{"a":1}', "[1]", "{}"] + ["⟨redacted⟩"] * 8 + [None]
    deep = "[" * 70 + "]" * 70
    one = spark.createDataFrame([(deep,)], "d string").select(jsonpaths.mask_paths(F.col("d"), {}, None)).first()[0]
    assert one == "⟨redacted⟩"


def test_sketches_merge_by_day_and_a_day_is_replaced(spark, tmp_path):
    rows = [(f"2026-01-0{1 + i % 3}", f"v{i % 10}", None if i % 2 else "é") for i in range(300)]
    df = spark.createDataFrame(rows, "d string, `a b` string, e string").withColumn("d", F.to_date("d"))
    found = statistics.sketches(df, "t", F.col("d"))
    path = str(tmp_path / "s")
    statistics.stored(found, path)
    statistics.stored(found.where("day = date'2026-01-02'"), path)
    kept = spark.read.schema(found.schema).parquet(path)
    assert kept.count() == 6
    got = {r["column"]: (r["distinct"], r.avg_width) for r in statistics.merged(kept).collect()}
    assert got == {"a b": (10.0, 2.0), "e": (1.0, 2.0)}
    assert {r["column"]: r.n for r in statistics.merged(kept, "day").groupBy("column").agg(F.count("*").alias("n")).collect()} == {"a b": 3, "e": 3}


def test_settled_counts_are_exact_on_both_sides_of_the_bound(spark):
    df = spark.range(60_000).select(*((F.col("id") % n).cast("string").alias(f"c{n}") for n in (1, 49, 50, 99, 100, 101, 199)), F.col("id").cast("string").alias("many"), F.lit(None).cast("string").alias("none"))
    got = {r["column"]: r["distinct"] for r in statistics.settled({"t": df, "n": spark.range(3)}).collect()}
    assert {c: got[c] for c in got if c not in ("many",)} == {"c1": 1, "c49": 49, "c50": 50, "c99": 99, "c100": 100, "c101": 101, "c199": 199, "none": 0}
    assert abs(got["many"] - 60_000) < 6_000


def test_session_catalog_lists_tables_and_views(spark, tmp_path):
    spark.sql(f"CREATE DATABASE listed LOCATION '{tmp_path}/db'")
    try:
        spark.range(3).selectExpr("id", "cast(id as string) as `odd name`").write.option("path", str(tmp_path / "t")).saveAsTable("listed.t")
        spark.sql("CREATE VIEW listed.v AS SELECT `odd name` FROM listed.t")
        spark.range(1).createOrReplaceTempView("passing")
        got = [(r.schema, r.relation, r.kind, r["column"], r.position, r.family) for r in schema.session_columns(spark, "listed").orderBy("relation", "position").collect()]
    finally:
        spark.sql("DROP DATABASE listed CASCADE")
    assert got == [("listed", "t", "r", "id", 1, "numeric"), ("listed", "t", "r", "odd name", 2, "text"), ("listed", "v", "v", "odd name", 1, "text")]


def test_over_large_requests_are_refused_or_told(spark):
    df = spark.range(1200).select(F.col("id").cast("string").alias("t"))
    with pytest.raises(ValueError):
        schema.sample_columns(df, ["t"], schema.MAX_SAMPLE + 1)
    df.createOrReplaceTempView("long_table")
    cut = queries.run(spark, "SELECT t FROM long_table ORDER BY cast(t AS int)", max_rows=10).collect()
    assert [(r.t, r.truncated) for r in cut] == [(str(i), True) for i in range(10)]
    assert not queries.run(spark, "SELECT t FROM long_table", allowed=1200).where("truncated").count()
    with pytest.raises(ValueError):
        queries.run(spark, "SELECT t AS truncated FROM long_table")
    with pytest.raises(ValueError):
        tokens.tag_length(4)
    with tokens.short_tags():
        assert tokens.tag_length(4) == 4
    with pytest.raises(ValueError):
        tokens.tag_length(4)


def test_samples_are_examined_in_one_pass(spark, tmp_path, capsys):
    rows = [("m", "r", "a", "x@y.example"), ("m", "r", "a", "10.0.0.1 x@y.example"), ("m", "r", "a", None), ("m", "r", "b", "10.0.0.1 x@y.example"), ("m", "r", "c", "plain")]
    spark.createDataFrame(rows, "schema string, relation string, column string, value string").write.parquet(str(tmp_path / "s"))
    rates = O.sample_rates(spark.read.parquet(str(tmp_path / "s")))
    capsys.readouterr()
    rates.explain()
    assert capsys.readouterr().out.count("FileScan") == 1
    got = {r["column"]: (r["n"], r["examined"], r["entity"], round(r["rate"], 3)) for r in rates.collect()}
    assert got == {"a": (3, False, "email_address", 0.667), "b": (1, True, "email_address", 1.0), "c": (1, True, "", 0.0)}
