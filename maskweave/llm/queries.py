"""One query per operator over its whole table, and SQL with the same answer where SQL can give it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.llm import bpe, forest, jaccard, lexical, lm, mixing, negatives, pages, quality, quality_rules, token_counts, toxicity, warc
from maskweave.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def classified(docs: DataFrame, bound: float) -> DataFrame:
    return docs.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= bound).cast("int").alias("predicted")
    )


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return classified(toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels"))), 0.5)


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return classified(quality.score(docs, quality.fit(docs, table(spark, folder, "labels"))), 0.3)


#: The vocabulary file of the word-piece counts.
PIECES_PATH = public_tokenizers.path("word_bpe_49k.json")


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    pieces, end = token_counts.word_end_vocabulary(PIECES_PATH)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, pieces, end).select("doc_id", "n_tokens")


@query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op5_embedding_forest")
def op5_embedding_forest(spark: SparkSession, folder: str) -> DataFrame:
    return forest.near_duplicates(table(spark, folder, "embeddings"))


#: The same mix by sorts and windows over whole sources.
_MIX = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
r AS (SELECT *, source_size * CAST(2 AS DOUBLE) / weight AS reach FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM r) * CAST(1.5 AS DOUBLE) - coalesce(sum(source_size) OVER o, 0) * CAST(2 AS DOUBLE))
    / ((SELECT sum(weight) FROM r) - coalesce(sum(weight) OVER o, 0)) AS level
    FROM r WINDOW o AS (ORDER BY reach, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(source_size * CAST(2 AS DOUBLE),
    coalesce((SELECT level FROM l WHERE reach > level ORDER BY reach, source_size, level LIMIT 1) * weight, source_size * CAST(2 AS DOUBLE))) AS target FROM l),
p AS (SELECT d.*, source_size, target, row_number() OVER (PARTITION BY d.source ORDER BY size, k) - 1 AS place,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix/' || coalesce('s' || d.source, '')), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296 AS start
    FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, size * CAST(least(floor(start + (place + 1) * rate) - floor(start + place * rate), ceil(rate)) AS BIGINT) AS taken FROM p
"""


@query("op6_mixing", _MIX)
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.measure(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost"
    )


@query("op7_ngram_jaccard_join")
def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(table(spark, folder, "documents"))


#: The vocabulary file of the byte-level BPE query.
BPE_PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def bpe_digests(docs: DataFrame) -> DataFrame:
    ranks = bpe.read_ranks(docs.sparkSession, BPE_PATH)
    return bpe.encode_digests(docs, ranks, public_tokenizers.PATTERN)


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_digests(table(spark, folder, "documents"))


@query("op10_lm_scoring")
def op10_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    good = table(spark, folder, "labels").where((F.col("quality") == 1) & ~held_out())
    return lm.fit_and_score(docs, good).drop("text")


#: The same negatives by all pairs of anchors and rows.
_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query("op13_hard_negatives", _NEGATIVES)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").where(negatives.finite(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select("vec_id", label.alias("label"), negatives.whole_vectors(F.col("embedding")).alias("vector"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


#: The same ranking by all terms of all documents.
_SEARCH = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT count(*) AS n_docs, sum(len(terms)) AS n_terms FROM d WHERE len(terms) > 0),
p AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM b) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term, n_docs),
i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + CAST((75 * n * n_docs) // n_terms AS BIGINT)))) AS impact
    FROM t JOIN w USING (term), c),
s AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM b JOIN i USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""


@query("op11_lexical_search", _SEARCH)
def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    index = lexical.build(table(spark, folder, "documents"))
    return lexical.search(index, table(spark, folder, "benchmark"))


#: The same roles without the archives.
_WARC = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f
"""


@query("op12_warc", _WARC)
def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages_of = table(spark, folder, "pages")
    records = warc.read(warc.write(pages_of), with_payload=False)
    return warc.payloads(records, pages_of.schema["page_id"].dataType.simpleString())
