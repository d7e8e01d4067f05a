"""A training corpus from the documents: rules, toxicity, near-duplicates, mixture, tokens.

Each stage takes all that the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.llm import jaccard, mixing, quality_rules, toxicity
from maskweave.llm.common import table, written
from maskweave.llm.queries import bpe_digests


def _whole(docs: DataFrame) -> DataFrame:
    """Rows as one struct beside their text, so that no operator's column meets a column of theirs."""
    return docs.select(F.struct("*").alias("_row"), "text")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, with their texts as they are."""
    return quality_rules.measure(_whole(docs)).where("kept").select("_row.*")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under one half, by a network learned on the labelled ones among them."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(_whole(docs), model).where("score < 0.5").select("_row.*")


#: Near-duplicates of the pipeline: five words, a similarity of 0.8.
NEAR = jaccard.JaccardRules(width=5, percent=80)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Repeated rows are one."""
    return jaccard.first_of_each(docs, NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "source", "text")
    return mixing.emitted(mixing.mix(rows)).select("_row.*")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of each document's tokens."""
    return bpe_digests(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("toxicity", keep_clean),
    ("ngram_jaccard_join", keep_one),
    ("mixing", mix_sources),
    ("byte_bpe", to_tokens),
]

#: A learned network and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
