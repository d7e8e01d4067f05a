"""The pipeline's stages, each against what its operator says, and the registered queries."""

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__ as entry
from maskweave.llm import jaccard, mixing, quality_rules

SMALL = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("kept", F.lit("clash")).withColumn("size", F.lit("clash"))
    columns = docs.columns
    good = corpus_pipeline.keep_good(spark, docs, SMALL)
    assert good.columns == columns
    assert ids(good) == ids(quality_rules.measure(docs.drop("kept")).where("kept"))
    clean = corpus_pipeline.keep_clean(spark, good, SMALL).cache()
    assert clean.columns == columns and 0 < clean.count() <= good.count()
    one = corpus_pipeline.keep_one(spark, clean, SMALL)
    assert ids(one) == sorted(r.doc_id for r in jaccard.join(clean, corpus_pipeline.NEAR).where("doc_id = component_id").collect())
    mixed = corpus_pipeline.mix_sources(spark, one, SMALL)
    assert mixed.columns == columns
    assert ids(mixed) == sorted(r.doc_id for r in mixing.mix(one.drop("size")).collect() for _ in range(r.copies))
    tokens = corpus_pipeline.to_tokens(spark, mixed, SMALL)
    assert ids(tokens) == ids(mixed) and tokens.where("n_tokens > 0").count() > 0


def test_run_and_registration(spark):
    names = entry.queries()
    assert names["pipeline"] is corpus_pipeline.run
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert corpus_pipeline.run(spark, SMALL).count() > 0
