"""Ranked lexical search over hashed max-sketches.

The index holds, for each document, a few rows of coordinates: every term is hashed to one coordinate of each row, which
keeps the greatest number of occurrences of the terms that fall there. What a term gives to a document's score grows with
its occurrences, so the greatest number stands for the greatest impact, whatever the rest of the corpus is. Queries are
taken in blocks: a batch of sketches is looked up for all terms of a block at once, a term's bound is its least over the
rows, and their weighted sum bounds the score of each document for each query. A few documents of the highest bounds are
scored exactly first; the score they reach is the threshold from which all others go on, in the order of falling bounds,
until their bound is below what the query's best documents have.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskweave.llm.common import written

# Digits, ASCII letters in lower case and all bytes beyond ASCII make terms, all else parts them.
_TERM_BYTES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
#: Occurrences are held in a byte; this value stands for itself and any more.
MOST = 255


@dataclass(frozen=True)
class SearchRules:
    """top: documents wanted of each query; rows: coordinates of a term; load: coordinates of a row for each term of a
    document, to the next power of two; seeds: documents of a query scored before the threshold is set; items, chars:
    about as many queries, and characters of queries, in a block; batch: documents looked up at once."""

    top: int = 10
    rows: int = 6
    load: int = 4
    seeds: int = 32
    items: int = 256
    chars: int = 1 << 18
    batch: int = 512


@dataclass(frozen=True)
class LexicalIndex:
    """Documents with at least one term: ``docs (row, id, text, n, bits, sketch)``, their number and all their terms'."""

    docs: DataFrame
    n_docs: int
    n_terms: int
    rules: SearchRules


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_TERM_BYTES).split()


def hashes(some: list[bytes], rows: int) -> np.ndarray:
    """A number of 32 bits per row and term."""
    h = np.fromiter(map(zlib.crc32, some), np.uint64, len(some))
    mixed = [(h * np.uint64(2 * (0x9E3779B97F4A7C15 >> (r + 1)) + 1)) >> np.uint64(32) for r in range(rows)]
    return np.array(mixed, np.int64).reshape(rows, len(some))


def sketch(counts: dict[bytes, int], rules: SearchRules) -> tuple[int, bytes]:
    """Width of the rows as a power of two, and the rows of greatest occurrences."""
    bits = max(6, (rules.load * len(counts) - 1).bit_length())
    places = hashes(list(counts), rules.rows) & ((1 << bits) - 1)
    cells = np.zeros((rules.rows, 1 << bits), np.uint8)
    tf = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), MOST).astype(np.uint8)
    for r in range(rules.rows):
        np.maximum.at(cells[r], places[r], tf)
    return bits, cells.tobytes()


def build(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: SearchRules = SearchRules()) -> LexicalIndex:
    """The index of ``docs``, written to the shared folder. Null texts and texts without a term are not in it; a repeated
    row is there as often as it comes; other columns are not read."""
    source = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rules.batch):
                batch = whole.slice(at, rules.batch)
                kept, found = [], []
                for k, data in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                    words = terms(data) if data else []
                    if words:
                        kept.append(k)
                        found.append((len(words), *sketch(Counter(words), rules)))
                some = batch.take(pa.array(kept, pa.int64()))
                n, bits, cells = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(n, pa.int64()), pa.array(bits, pa.int32()), pa.array(cells, pa.binary())],
                    names=["id", "text", "n", "bits", "sketch"],
                )

    made = source.mapInArrow(sketched, f"id {kind}, text string, n bigint, bits int, sketch binary")
    table = written(made.select(F.monotonically_increasing_id().alias("row"), "*"), "lexical-index")
    n_docs, n_terms = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return LexicalIndex(table, n_docs, n_terms, rules)


class _Queries:
    """A block of queries: its terms numbered, and per query their numbers and how often each comes."""

    def __init__(self, texts: list[bytes]):
        self.number: dict[bytes, int] = {}
        self.of: list[tuple[np.ndarray, np.ndarray]] = []
        for text in texts:
            counts = Counter(terms(text))
            at = [self.number.setdefault(t, len(self.number)) for t in counts]
            self.of.append((np.array(at, np.int64), np.array(list(counts.values()), np.int64)))
        self.weight = np.zeros(len(self.number), np.int64)
        self.kept: dict[int, np.ndarray] = {}

    def weights(self, start: int, size: int) -> np.ndarray:
        """What one unit of impact of each of some terms adds to each query, (term, query). Kept where all of it is small."""
        if start in self.kept:
            return self.kept[start]
        out = np.zeros((size, len(self.of)))
        for q, (t, times) in enumerate(self.of):
            here = (t >= start) & (t < start + size)
            out[t[here] - start, q] = times[here] * self.weight[t[here]]
        if len(self.number) * len(self.of) <= 1 << 22:
            self.kept[start] = out
        return out

    def occurrences(self, text: bytes) -> np.ndarray:
        """How often each term of the block is in a text."""
        found, number = np.zeros(len(self.number), np.int64), self.number
        for t, n in Counter(terms(text)).items():
            if (at := number.get(t)) is not None:
                found[at] = n
        return found

    def weigh(self, df: dict[int, int], n_docs: int) -> None:
        for k in range(len(self.number)):
            self.weight[k] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(k, 0) + 1)))


def _length_norm(n: np.ndarray, index: tuple[int, int]) -> np.ndarray:
    """m of documents with n terms, from the numbers of documents and terms of the index."""
    n_docs, n_terms = index
    return 25 + (75 * n * n_docs) // n_terms


def _exact(queries: _Queries, found: np.ndarray, m: int, q: int) -> int:
    at, times = queries.of[q]
    tf = found[at]
    return int((times * queries.weight[at] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))).sum())


def _bounds(queries: _Queries, bits: np.ndarray, cells: list, m: np.ndarray, rows: int) -> np.ndarray:
    """Upper bounds (document, query): whole numbers, as doubles."""
    words = list(queries.number)
    at = hashes(words, rows)
    out = np.zeros((len(bits), len(queries.of)))
    for b in np.unique(bits).tolist():
        own = np.flatnonzero(bits == b)
        table = np.frombuffer(b"".join(cells[k] for k in own.tolist()), np.uint8).reshape(len(own), rows, 1 << b)
        for start in range(0, len(words), 4096):
            places = at[:, start : start + 4096] & ((1 << b) - 1)
            tf = table[:, 0, places[0]]
            for r in range(1, rows):
                tf = np.minimum(tf, table[:, r, places[r]])
            some = tf.astype(np.float64)
            impact = np.floor(1e9 * some / (1000 * some + 8.0 * m[own][:, None]))
            impact[tf == MOST] = 1e6  # more than any number of occurrences gives
            out[own] += impact @ queries.weights(start, some.shape[1])
    return out


def _sliced(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, size):
            yield whole.slice(at, size)


def _frequencies(index: LexicalIndex, queries: Broadcast) -> dict[int, int]:
    """How many documents hold each term of a block; at most as many numbers as the block has terms."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, found = queries.value.number, Counter()
        known = number.keys()
        for batch in _sliced(batches, index_batch):
            for data in batch.column("text").cast(pa.binary()).to_pylist():
                found.update(known & set(terms(data)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([number[t] for t in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["term", "df"]
        )

    index_batch = index.rules.batch
    sums = index.docs.select("text").mapInArrow(counted, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in sums.collect()}


def _highest_bounds(index: LexicalIndex, queries: Broadcast) -> dict[int, list[int]]:
    """The rows of the highest bounds of each query, as row: queries."""
    rules, size = index.rules, (index.n_docs, index.n_terms)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = queries.value
        n_queries = len(block.of)
        best, row = np.zeros((n_queries, 0)), np.zeros((n_queries, 0), np.int64)
        for batch in _sliced(batches, rules.batch):
            m = _length_norm(np.asarray(batch.column("n")), size)
            found = _bounds(block, np.asarray(batch.column("bits")), batch.column("sketch").to_pylist(), m, rules.rows).T
            best = np.concatenate([best, found], axis=1)
            row = np.concatenate([row, np.broadcast_to(np.asarray(batch.column("row")), found.shape)], axis=1)
            if best.shape[1] > rules.seeds:
                top = np.argpartition(-best, rules.seeds - 1, axis=1)[:, : rules.seeds]
                best, row = np.take_along_axis(best, top, 1), np.take_along_axis(row, top, 1)
        q = np.repeat(np.arange(n_queries), best.shape[1])
        hit = best.ravel() > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(q[hit], pa.int32()), pa.array(best.ravel()[hit]), pa.array(row.ravel()[hit])], names=["q", "bound", "row"]
        )

    top = W.partitionBy("q").orderBy(F.desc("bound"), "row")
    found = index.docs.select("row", "n", "bits", "sketch").mapInArrow(bounded, "q int, bound double, row bigint")
    seeds: dict[int, list[int]] = {}
    for r in found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= rules.seeds).collect():
        seeds.setdefault(r.row, []).append(r.q)
    return seeds


def _thresholds(index: LexicalIndex, queries: Broadcast, n_queries: int) -> list[int]:
    """For each query, a score that its best ``top`` documents reach: from the exact scores of those with the highest bounds."""
    spark, size = index.docs.sparkSession, (index.n_docs, index.n_terms)
    seeds = _highest_bounds(index, queries)
    shared = spark.sparkContext.broadcast(seeds)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, row in enumerate(batch.column("row").to_pylist()):
                found = queries.value.occurrences(batch.column("text")[k].as_py().encode())
                m = int(_length_norm(batch.column("n")[k].as_py(), size))
                out += [(q, _exact(queries.value, found, m, q)) for q in shared.value[row]]
            q, score = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(score, pa.int64())], names=["q", "score"])

    # At most ``seeds`` rows of each query of a block.
    wanted = F.broadcast(spark.createDataFrame([(r,) for r in seeds], "row bigint"))
    found = index.docs.select("row", "n", "text").join(wanted, "row", "left_semi").mapInArrow(scored, "q int, score bigint")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"))))
    reached = {r.q: r.score for r in ranked.where(F.col("rank") == index.rules.top).collect()}
    return [max(1, reached.get(q, 1)) for q in range(n_queries)]


def _best(index: LexicalIndex, queries: Broadcast, thresholds: list[int]) -> DataFrame:
    """The best documents of each query: (q, score, id, row), from the best of each task."""
    rules, size = index.rules, (index.n_docs, index.n_terms)
    kind = index.docs.schema["id"].dataType.simpleString()

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, least = queries.value, np.array(thresholds, np.float64)
        best: list[list[tuple]] = [[] for _ in block.of]
        id_type = None
        for batch in _sliced(batches, rules.batch):
            id_type = batch.schema.field("id").type
            m = _length_norm(np.asarray(batch.column("n")), size)
            bounds = _bounds(block, np.asarray(batch.column("bits")), batch.column("sketch").to_pylist(), m, rules.rows)
            known: dict[int, np.ndarray] = {}
            for q in np.flatnonzero((bounds >= least).any(axis=0)).tolist():
                along = bounds[:, q]
                hits = np.flatnonzero(along >= least[q])
                for k in hits[np.argsort(-along[hits], kind="stable")].tolist():
                    if along[k] < least[q]:
                        break  # nothing after it can be among the best
                    if k not in known:
                        known[k] = block.occurrences(batch.column("text")[k].as_py().encode())
                    score = _exact(block, known[k], int(m[k]), q)
                    if score >= least[q]:
                        name = batch.column("id")[k].as_py()
                        # Distinct rows, so that no comparison gets to the id after them.
                        key = (-score, name is None, 0 if name is None else name, batch.column("row")[k].as_py())
                        best[q] = sorted([*best[q], (*key, name)])[: rules.top]
                        if len(best[q]) == rules.top:
                            least[q] = max(least[q], -best[q][-1][0])
        out = [(q, -x[0], x[4], x[3]) for q, some in enumerate(best) for x in some]
        if out:
            q, score, name, row = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int32()), pa.array(score, pa.int64()), pa.array(name, id_type), pa.array(row, pa.int64())],
                names=["q", "score", "id", "row"],
            )

    found = index.docs.mapInArrow(searched, f"q int, score bigint, id {kind}, row bigint")
    ranks = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= rules.top)


def search(index: LexicalIndex, items: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each row of ``items``, those with a score above 0.

    A score is BM25 in whole numbers: over the item's terms, repeats included, weight * ((10^9 * tf) div (1000 * tf + 8 * m)).
    Equal scores go by ascending doc_id, null ids last. Each row of the documents and of the items counts by itself, also
    where ids or texts repeat. Items that are null or without a term, and an empty index, give no rows. Weights and lengths
    are those of the whole index. Other columns are not read.
    """
    spark, rules = index.docs.sparkSession, index.rules
    doc_kind = index.docs.schema["id"].dataType.simpleString()
    source = items.select(F.col(id).alias("id"), F.col(text).alias("text")).where("text is not null")
    item_kind = source.schema["id"].dataType.simpleString()
    rows = written(source.select(F.monotonically_increasing_id().alias("row"), "*"), "lexical-items")
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(-(-n // rules.items), -(-chars // rules.chars)) if index.n_docs else 0
    out = []
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).orderBy("row").collect()  # about ``items`` rows
        queries = _Queries([r.text.encode() for r in own])
        if not queries.number:
            continue
        queries.weigh(_frequencies(index, spark.sparkContext.broadcast(queries)), index.n_docs)
        shared = spark.sparkContext.broadcast(queries)
        best = _best(index, shared, _thresholds(index, shared, len(own)))
        names = spark.createDataFrame([(q, r.id) for q, r in enumerate(own)], f"q int, item_id {item_kind}")
        found = best.join(F.broadcast(names), "q").select("item_id", F.col("rank").cast("int"), F.col("id").alias("doc_id"), "score")
        out.append(written(found, "lexical-found") if blocks > 1 else found)
    if not out:
        return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score bigint")
    found = out[0]
    for more in out[1:]:
        found = found.unionAll(more)
    return found
