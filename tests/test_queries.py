"""Registered queries on inputs that the given tables do not hold."""

from pyspark.sql import functions as F

from maskweave.registry import QUERIES


def folder_of(tmp_path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_a_recursion_of_more_than_a_million_rows_ends(spark, tmp_path):
    customer = spark.range(340_000).select(F.col("id").alias("c_custkey"), F.lit("x").alias("c_name"), (F.col("id") % 25).alias("c_nationkey"))
    assert QUERIES["rel_recursive"](spark, folder_of(tmp_path, customer=customer)).count() == 3 * 340_000


def test_described_columns_name_their_relation(spark):
    rows = QUERIES["describe_statement"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.name, r.relation, r.column) for r in rows} == {
        ("n", "customer", "c_name"), ("u", "", ""), ("o_totalprice", "orders", "o_totalprice"), ("s", "", ""),
    }


def overlapping(spark, tmp_path):
    # An address whose end is the start of a card number, and one that a phone number runs into.
    texts = [(1, "ensh 38.211.12.42 4366089147969128 ly"), (2, "ahe 38.253.197.126 488076134"), (3, "1.2.3.4 and"), (4, None), (5, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    return folder_of(tmp_path, documents=docs)


def test_overlapping_identifiers_are_all_counted(spark, tmp_path):
    rows = QUERIES["detect_distinct_texts"](spark, overlapping(spark, tmp_path)).collect()
    assert {r.doc_id: r.n for r in rows} == {1: 2, 2: 2, 3: 1, 4: 0, 5: 0}


def test_every_kind_of_overlapping_identifiers_is_told(spark, tmp_path):
    rows = QUERIES["screen_texts"](spark, overlapping(spark, tmp_path)).collect()
    assert {r.doc_id: (r.kinds, r.accepted) for r in rows} == {
        1: ("credit_card,ip_address", False), 2: ("ip_address,phone_number", False), 3: ("ip_address", False), 4: ("", True), 5: ("", True),
    }
