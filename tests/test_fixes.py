"""Paths that once failed open, lost rows or ran what they were asked to judge."""

import os

import pytest
from pyspark.sql import functions as F

from maskweave.functions import detect as D
from maskweave.functions import nested
from maskweave.functions.tokens import REDACTED
from maskweave.operators import bindings as B
from maskweave.operators import changes as C
from maskweave.operators import leaks as L
from maskweave.operators.masking import ColumnPolicy, Masking, mask
from maskweave.plans import lineage as G
from maskweave.sources import queries

DOC = '{"a":"hello","b":{"c":["x@y.example","plain"]},"d":"hidden"}'
PATHS = {"$.a": ("scan", ""), "$.b.c[*]": ("scan", ""), "$.b": ("allow", ""), "$.b.c": ("allow", "")}


def json_masked(spark, **settings):
    df = spark.createDataFrame([(DOC,)], "doc string")
    return mask(df, Masking({"doc": ColumnPolicy("scan", paths=PATHS)}, **settings)).first()[0]


def test_json_leaves_go_through_the_given_detector(spark):
    every = lambda text: F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), F.lit("any").alias("type"), F.lit(1.0).alias("score")))
    marked = json_masked(spark, detector=every)
    assert "hello" not in marked and "plain" not in marked and marked.count("⟨redacted:any⟩") == 3
    own = json_masked(spark, detector=D.custom_detector(lambda t: [(0, 2, "two", 1.0)]))
    assert '"⟨redacted:two⟩llo"' in own and '"⟨redacted:two⟩ain"' in own
    broken = json_masked(spark, detector=D.custom_detector(lambda t: 1 / 0))
    assert "hello" not in broken and "plain" not in broken


def test_json_without_detector_masks_whole(spark):
    for masked in (json_masked(spark, detector=None), json_masked(spark, detection="off")):
        assert "hello" not in masked and "plain" not in masked and "y.example" not in masked
    assert '"a":"hello"' in json_masked(spark) and "y.example" not in json_masked(spark)


def test_long_addresses_are_masked_whole(spark):
    texts = ["a" * 70 + "@x.example", "me@" + ".".join("abcdefghij") + ".example", "me@" + "y" * 80 + ".example", "me@x." + "z" * 30]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(D.redact_spans(F.col("t"), D.spans(F.col("t")))).collect()] == ["⟨redacted:email_address⟩"] * 4


def test_map_keys_that_mask_alike_keep_their_entries(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2", "c": "3"},)], "m map<string,string>")
    got = df.select(nested.map_strings(F.col("m"), df.schema["m"].dataType, lambda s: F.when(s == "c", s).otherwise(F.lit(REDACTED)))).first()[0]
    assert len(got) == 3 and "c" in got and REDACTED in got and not {"a", "b"} & set(got)


def test_merge_adds_unmatched_rows_whatever_the_delete(spark):
    target = spark.createDataFrame([(1, 10), (4, 90)], "k int, v int")
    source = spark.createDataFrame([(1, 20), (2, 99), (3, 5), (4, 99)], "k int, v int")
    assert sorted(map(tuple, C.upserted(target, source, ["k"], F.col("v") > 50).collect())) == [(1, 20), (2, 99), (3, 5)]


def test_bindings_keep_rows_without_token(spark):
    inputs = spark.createDataFrame(
        [("s", "c", "email", "a", 1), ("s", "", "email", "b", 2), ("s", "c", "not:valid", "d", 3), ("other", "c", "email", "e", 4)],
        "session string, conn string, namespace string, value string, seq int",
    )
    from maskweave.functions import tokens as K

    keys = K.key_table(spark, K.key_rows("c", "s", {1: b"key"}))
    minted = B.mint(inputs, keys, F.lit("2026-01-01").cast("timestamp"))
    shown = {r.value: r.shown for r in B.tokens_or_redacted(minted, B.bind(minted)).collect()}
    assert len(shown) == 4 and shown["a"].startswith("⟨email") and {shown[v] for v in "bde"} == {REDACTED}


STATEMENTS = [
    ("SELECT 1", "SELECT"), ("WITH x AS (SELECT 1 AS a) SELECT * FROM x", "SELECT"), ("VALUES (1)", "SELECT"), ("FROM src SELECT a", "SELECT"),
    ("SELECT a FROM src UNION SELECT 2 ORDER BY 1 LIMIT 3", "SELECT"), ("SELECT a, count(*) FROM src GROUP BY a HAVING count(*) > 1", "SELECT"),
    ("INSERT INTO t VALUES (1)", "INSERT"), ("WITH x AS (SELECT 1 AS a) INSERT INTO t SELECT * FROM x", "INSERT"),
    ("FROM src INSERT INTO t SELECT a INSERT INTO u SELECT a", "INSERT"), ("INSERT OVERWRITE DIRECTORY '{d}' USING parquet SELECT 1 AS a", "INSERT"),
    ("WITH x AS (SELECT 1 AS a) INSERT OVERWRITE DIRECTORY '{d}' USING parquet SELECT * FROM x", "INSERT"), ("UPDATE t SET a = 1", "UPDATE"),
    ("DELETE FROM t", "DELETE"), ("MERGE INTO t USING src ON t.a = src.a WHEN MATCHED THEN DELETE", "MERGE"),
    ("CREATE TABLE t USING parquet AS SELECT 1 AS a", "DDL"), ("CREATE OR REPLACE TABLE t USING parquet AS SELECT 1 AS a", "DDL"),
    ("LOAD DATA INPATH '{d}' INTO TABLE t", "DDL"), ("CACHE TABLE c AS SELECT 1", "DDL"), ("ALTER VIEW v AS SELECT 1", "DDL"),
    ("SET VAR x = 1", "DDL"), ("DROP TABLE t", "DDL"), ("SHOW TABLES", "DDL"), ("EXPLAIN SELECT 1", "DDL"), ("SET a = b", "DDL"),
]


@pytest.mark.parametrize("sql,kind", STATEMENTS)
def test_dry_run_judges_and_never_executes(spark, tmp_path, sql, kind):
    target = tmp_path / "out"
    spark.range(3).withColumnRenamed("id", "a").createOrReplaceTempView("src")
    sql = sql.replace("{d}", str(target))
    report = G.dry_run(spark, sql, {})
    assert report["statement_type"] == kind and not os.path.exists(target)
    if kind != "SELECT":
        with pytest.raises(ValueError):
            queries.run(spark, sql)
        with pytest.raises(ValueError):
            queries.describe(spark, sql)


def test_whole_numbers_have_one_text(spark):
    from pyspark.sql import types as T

    from maskweave.operators.masking import value_text

    rows = [(5, "5.00", 5.0), (10**15, "1000000000000000.00", 1e15), (2**60, str(2**60), float(2**60)), (120, "120.00", 120.0), (0, "0.00", 0.0)]
    df = spark.createDataFrame(rows, "b bigint, s string, d double").withColumn("c", F.col("s").cast("decimal(38,2)"))
    kinds = {"b": T.LongType(), "d": T.DoubleType(), "c": T.DecimalType(38, 2)}
    for r in df.select(*(value_text(F.col(k), t).alias(k) for k, t in kinds.items())).collect():
        assert r.b == r.c == r.d
    assert df.limit(1).select(value_text(F.lit("5.50").cast("decimal(9,2)"), T.DecimalType(9, 2))).first()[0] == "5.5"


def test_search_without_the_optional_library(monkeypatch):
    from maskweave.operators import emission as E

    monkeypatch.setattr(E, "ahocorasick", None)
    index = E.Index([("abcdef", "1", False), ("cdefgh", "2", False), ("bcde", "3", False), ("ab", "4", True)])
    assert sorted(index.all_hits("abcdefgh")) == [(0, 6, "1"), (1, 5, "3"), (2, 8, "2")]
    assert index.replace("\x1cab") == ("\x1cab", 0) and index.replace(" ab ") == ("4", 1)


def test_strict_spans_leave_no_known_value_in_clear(spark):
    """A card number behind another number fails the check as one long run; others stand inside a longer word."""
    texts = ["card 4366089147969128 mail", "from 41 4366089147969128 mail", "4366089147969128 77 end", "host 10.20.30.40 up", "_10.20.30.40_ up",
             "ssn 123-45-6789", "no 9123-45-67890", "pay DE89370400440532013000 now", "pay de89370400440532013000x now", "plain 12 words"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    truth = df.select(F.explode(F.flatten(F.array(*(D.matched(F.col("text"), e) for e in D.ENTITIES)))).alias("value")).distinct().select(F.lit("any").alias("kind"), "value")
    assert truth.count() == 4

    def leaks(**settings):
        masked = mask(df, Masking({"text": ColumnPolicy("scan")}, **settings))
        return L.leak_counts([masked], truth).first()["leaks"], [r[0] for r in masked.collect()]

    assert leaks()[0] == 4  # the plain reading, which the SQL of the detection queries fixes
    found, masked = leaks(detector=D.strict_spans)
    assert found == 0 and masked[-1] == "plain 12 words" and masked[0] == "card ⟨redacted:credit_card⟩ mail"


def test_masked_documents_leak_no_card_that_follows_a_number(spark, tmp_path):
    from maskweave.registry import QUERIES

    rows = [(1, "card 4366089147969128 mail"), (2, "from 41 4366089147969128 mail")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in QUERIES["leak_counts_masked"](spark, str(tmp_path)).collect()] == [("credit_card", 0)]


def test_a_document_goes_by_paths_made_once_and_repeated_leaves_are_examined_once(spark):
    from maskweave.operators import jsonpaths as J
    from maskweave.session import spread

    calls = spark.sparkContext.accumulator(0)

    def find(text):
        calls.add(1)
        return [(0, 2, "two", 1.0)]

    rows = spark.createDataFrame([('{"a.b":"hello","a":{"b":["hello",1.50,"x"]}}',)] * 50, "doc string").coalesce(1)
    paths = {"$.a.b": ("scan", ""), "$.a.b[*]": ("scan", "")}
    got = rows.select(J.mask_paths(F.col("doc"), paths, None, detector=D.custom_detector(find))).distinct().collect()
    assert [r[0] for r in got] == ['{"a.b":"⟨redacted:two⟩llo","a":{"b":["⟨redacted:two⟩llo",1.50,"⟨redacted⟩"]}}'] and calls.value == 2
    assert J._leading({"$.a[*].c": 0, "$.ab": 0}) == {"$", "$.a", "$.a[*]", "$.a[*].c", "$.ab"}
    cores = spark.sparkContext.defaultParallelism
    assert spread(rows).rdd.getNumPartitions() == 4 * cores
