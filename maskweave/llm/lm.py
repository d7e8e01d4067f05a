"""Language-model scoring by cross-entropy difference.

Two bigram models, one of target texts and one of all texts, over all words and word pairs there are. A text's score
is the mean, over its tokens, of the target loss less the background loss; low means close to the target.

A gram is a word or a pair, known by 80 bits of hashes of its words. Counts of both models stand beside each other in
one table that grows with the texts, cut into buckets by the hash. Texts are taken in chunks of bounded length: a chunk's
distinct grams travel to the buckets, packed, and their counts travel back to the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from maskweave.llm.common import written

#: Characters of a chunk.
CHUNK_CHARS = 16_000_000
#: Hashes of what stands before a text's first word, and of the gram that counts tokens.
_MARKS = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b"\xff" + x) for x in (b"start", b"tokens")), "<u8").reshape(2, 2)
_GRAMS = ("<u8", "<u2")  # differences of the sorted keys, and the tags
_COUNTS = ("<u8", "<u8")  # of the target texts, and of all


@dataclass(frozen=True)
class LmRules:
    """The weights of the pair's and the word's share in the mixture, the rest being even over 2^word_bits words."""

    word_bits: int = 18
    pair_weight: float = 0.6
    word_weight: float = 0.35


def _pack(pack: zstandard.ZstdCompressor, *columns: np.ndarray) -> bytes:
    """Columns of numbers of one length, byte by byte of equal weight, compressed."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns if len(c)]
    return pack.compress(len(columns[0]).to_bytes(8, "little") + b"".join(planes))


def _unpack(unpack: zstandard.ZstdDecompressor, packed: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    data = unpack.decompress(packed)
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T.copy().view(kind).ravel())
        at += n * width
    return out


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (left * np.uint64(0x9E3779B97F4A7C15)) ^ right
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Grams:
    """The distinct grams of some tokens: the words, the two marks, then the pairs. ``order`` sorts them by key."""

    def __init__(self, hashes: np.ndarray, tokens: np.ndarray, lengths: np.ndarray):
        self.words = len(hashes)
        hashes = np.concatenate([hashes, _MARKS])
        tokens = tokens.astype(np.int64)
        left = np.roll(tokens, 1)
        left[(np.cumsum(lengths) - lengths)[lengths > 0]] = self.words
        codes, self.pair_of = np.unique(left * len(hashes) + tokens, return_inverse=True)
        self.left, self.right = codes // len(hashes), codes % len(hashes)
        pairs = [_mixed(hashes[self.left, k], hashes[self.right, k]) for k in (0, 1)]
        self.keys = np.concatenate([hashes[:, 0], pairs[0]])
        self.tags = (np.concatenate([hashes[:, 1], pairs[1]]) >> np.uint64(48)).astype("<u2")
        self.order = np.argsort(self.keys, kind="stable")

    def counts(self, tokens: np.ndarray, lengths: np.ndarray, some: np.ndarray) -> np.ndarray:
        """How often each gram is in the texts that ``some`` marks."""
        of = np.repeat(some, lengths)
        marks = [np.count_nonzero(lengths[some]), np.count_nonzero(of)]
        words = np.bincount(tokens[of], minlength=self.words)
        return np.concatenate([words, marks, np.bincount(self.pair_of[of], minlength=len(self.left))]).astype("<u8")

    def by_bucket(self, buckets: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """For each bucket with grams: its number, the places of its grams, and their keys and tags to be packed."""
        bucket = _bucket(self.keys[self.order], buckets)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True):
            places = self.order[a:b]
            yield int(bucket[a]), places, [np.diff(self.keys[places], prepend=np.uint64(0)), self.tags[places]]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)


class _Chunk:
    """Texts in a row, as numbers into a list of their distinct words."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.tokens: list[np.ndarray] = []
        self.others: list = []
        self.size = 0
        self.digest = xxhash.xxh3_128()

    def add(self, text: str, other, split: bool = True) -> None:
        if split:
            words, known = text.lower().split(), self.numbers
            self.tokens.append(np.fromiter((known.setdefault(w, len(known)) for w in words), "<u4", len(words)))
        self.others.append(other)
        self.size += len(text)
        for data in (text.encode(), repr(other).encode()):
            self.digest.update(len(data).to_bytes(8, "little") + data)

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hashes of the words, the tokens of all texts, and each text's number of tokens."""
        hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w.encode()) for w in self.numbers), "<u8").reshape(-1, 2)
        self.numbers = {}
        lengths = np.fromiter(map(len, self.tokens), "<i8", len(self.tokens))
        return hashes, np.concatenate(self.tokens), lengths


def _chunks(batches: Iterator[pa.RecordBatch], split: bool = True) -> Iterator[_Chunk]:
    """Chunks of ``(text, other)``; without ``split``, the same chunks but not their tokens."""
    chunk = _Chunk()
    for batch in batches:
        for k in range(batch.num_rows):
            chunk.add(batch.column(0)[k].as_py() or "", batch.column(1)[k].as_py(), split)
            if chunk.size >= CHUNK_CHARS:
                yield chunk
                chunk = None  # its memory goes before the next one grows
                chunk = _Chunk()
    if chunk.others:
        yield chunk


@dataclass
class Model:
    """``grams``: a row per bucket with its grams, sorted, and how often each is in the target and in all texts."""

    rules: LmRules
    buckets: int
    grams: DataFrame


def _buckets(docs: DataFrame) -> int:
    """As many as keep each one's share of the texts bounded."""
    characters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return 1 << (max(16, min(2048, characters >> 18), characters >> 24) - 1).bit_length()


def _marked(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """``docs`` with whether their doc_id is in ``target_ids``. Null ids are in no target."""
    # A merge at every size: the targets grow with the input, so they are never broadcast.
    marked = target_ids.select("doc_id").distinct().withColumn("target", F.lit(True)).hint("merge")
    return docs.join(marked, "doc_id", "left")


def _counted(grams: _Grams, tokens: np.ndarray, lengths: np.ndarray, target: np.ndarray, buckets: int) -> dict:
    pack = zstandard.ZstdCompressor(level=1)
    counts = [grams.counts(tokens, lengths, some) for some in (target, np.ones(len(target), bool))]
    rows = [(k, _pack(pack, *keys, *(c[at] for c in counts))) for k, at, keys in grams.by_bucket(buckets)]
    return {"bucket": pa.array([k for k, _ in rows], pa.int32()), "grams": pa.array([x for _, x in rows], pa.binary())}


def _summed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, list[int]]:
    """Keys, tags and counts of all grams in the rows of a bucket, each gram once; each row's grams' places among
    them, one row after the other, and the rows' numbers of grams."""
    unpack = zstandard.ZstdDecompressor()
    found = [_unpack(unpack, x, _GRAMS + _COUNTS) for x in rows.column("grams").to_pylist()]
    keys = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in found])
    tags, target, every = (np.concatenate([x[k] for x in found]) for k in (1, 2, 3))
    order = np.lexsort((tags, keys))
    keys, tags = keys[order], tags[order]
    new = np.append(True, (np.diff(keys) != 0) | (np.diff(tags) != 0))
    first = np.flatnonzero(new)
    places = np.empty(len(order), np.int64)
    places[order] = np.cumsum(new) - 1
    counts = [np.add.reduceat(c[order], first) for c in (target, every)]
    return keys[first], tags[first], counts, places, [len(x[0]) for x in found]


def fit(docs: DataFrame, target_ids: DataFrame, rules: LmRules = LmRules()) -> Model:
    """Count the words and pairs of all texts, and of those whose doc_id is in ``target_ids``. Null ids are in no target.

    Each chunk sends the counts of its distinct grams; a bucket adds them up.
    """
    buckets = _buckets(docs)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            hashes, tokens, lengths = chunk.parts()
            target = np.array([bool(x) for x in chunk.others])
            yield pa.RecordBatch.from_pydict(_counted(_Grams(hashes, tokens, lengths), tokens, lengths, target, buckets))

    def summed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        keys, tags, counts, _, _ = _summed(rows)
        data = _pack(zstandard.ZstdCompressor(level=1), np.diff(keys, prepend=np.uint64(0)), tags, *counts)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "grams": pa.array([data], pa.binary())})

    source = _marked(docs.select("doc_id", "text"), target_ids).select("text", "target")
    found = source.mapInArrow(counted, "bucket int, grams binary")
    return Model(rules, buckets, written(found.groupBy("bucket").applyInArrow(summed, "bucket int, grams binary"), "lm-grams"))


def _found(keys: np.ndarray, tags: np.ndarray, known: np.ndarray, known_tags: np.ndarray) -> np.ndarray:
    """The place of each gram among the known ones, sorted by key and tag; -1 if it is not there."""
    at = np.searchsorted(known, keys)
    while True:
        near = np.minimum(at, len(known) - 1)
        same = (at < len(known)) & (known[near] == keys)
        other = same & (known_tags[near] != tags)
        if not other.any():
            return np.where(same, near, -1)
        at[other] += 1


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with n_tokens, target_loss, background_loss and difference (target less background).

    Null, empty and blank texts have no tokens and losses of 0. Columns with these names are replaced; other columns
    pass through. A chunk is known by a digest of its texts, so both sides find the same chunks when they read
    the table; if the rows came in another order on a second read, the job fails. Losses, one row for each
    distinct text, are written and joined to the rows by a digest of the text.
    """
    buckets = model.buckets
    source = docs.where(F.col("text").isNotNull()).select("text", _digest().alias("other"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for chunk in _chunks(batches):
            rows = [(k, _pack(pack, *keys)) for k, _, keys in _Grams(*chunk.parts()).by_bucket(buckets)]
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array([k for k, _ in rows], pa.int32()),
                    "chunk": pa.array([chunk.digest.digest()] * len(rows), pa.binary()),
                    "grams": pa.array([x for _, x in rows], pa.binary()),
                }
            )

    def answered(key, asks: pa.Table, grams: pa.Table) -> pa.Table:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        known, known_tags, *counts = (np.zeros(0, x) for x in _GRAMS + _COUNTS)
        for x in grams.column("grams").to_pylist():
            known, known_tags, *counts = _unpack(unpack, x, _GRAMS + _COUNTS)
        known, counts = np.cumsum(known, dtype=np.uint64), [np.append(c, np.uint64(0)) for c in counts]  # the last: of none
        out = []
        for x in asks.column("grams").to_pylist():
            keys, tags = _unpack(unpack, x, _GRAMS)
            at = _found(np.cumsum(keys, dtype=np.uint64), tags, known, known_tags) if len(known) else np.full(len(keys), -1)
            out.append(_pack(pack, *(c[at] for c in counts)))
        return pa.table({"chunk": asks.column("chunk"), "bucket": asks.column("bucket"), "counts": pa.array(out, pa.binary())})

    asks = source.mapInArrow(asked, "bucket int, chunk binary, grams binary")
    answers = asks.groupBy("bucket").cogroup(model.grams.groupBy("bucket")).applyInArrow(answered, _ANSWERS)
    return _joined(docs, source.mapInArrow(_held, _TEXTS), answers, model.rules)


def fit_and_score(docs: DataFrame, target_ids: DataFrame, rules: LmRules = LmRules()) -> DataFrame:
    """The same as ``score(docs, fit(docs, target_ids))``, but the grams travel once: a bucket adds up the counts and
    sends the sums back. Texts do not travel: only their ids meet the targets."""
    buckets = _buckets(docs)
    source = docs.where(F.col("text").isNotNull()).select("text", F.struct(_digest().alias("digest"), "doc_id").alias("other"))
    kind = docs.schema["doc_id"].dataType

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, False):
            ids = [x["doc_id"] for x in chunk.others]
            chunks = pa.array([chunk.digest.digest()] * len(ids), pa.binary())
            columns = [chunks, pa.array(range(len(ids)), pa.int64()), pa.array(ids, to_arrow_type(kind))]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "place", "doc_id"])

    def counted(key, texts: pa.Table, places: pa.Table) -> pa.Table:
        out = []
        for row in texts.to_pylist():
            grams, tokens, lengths = _grams_of(row)
            target = np.zeros(len(lengths), bool)
            target[places.column("place").to_numpy()] = True
            columns = _counted(grams, tokens, lengths, target, buckets)
            out.append(pa.table(columns | {"chunk": pa.array([row["chunk"]] * len(columns["bucket"]), pa.binary())}))
        names = ["bucket", "chunk", "grams"]
        if not out:
            raise RuntimeError("a chunk has lost its texts: the table changed between two reads")
        return pa.concat_tables(out).select(names)

    def answered(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        pack = zstandard.ZstdCompressor(level=1)
        _, _, counts, places, sizes = _summed(rows)
        out = [_pack(pack, *(c[at] for c in counts)) for at in np.split(places, np.cumsum(sizes)[:-1])]
        return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "counts": pa.array(out, pa.binary())})

    texts = source.mapInArrow(_held, _TEXTS)
    places = _marked(source.mapInArrow(placed, f"chunk binary, place bigint, doc_id {kind.simpleString()}"), target_ids)
    places = places.where("target").select("chunk", "place")
    grams = texts.groupBy("chunk").cogroup(places.groupBy("chunk")).applyInArrow(counted, "bucket int, chunk binary, grams binary")
    return _joined(docs, texts, grams.groupBy("bucket").applyInArrow(answered, _ANSWERS), rules)


def _digest() -> Column:
    return F.unhex(F.md5("text"))


_ANSWERS = "chunk binary, bucket int, counts binary"
_TEXTS = "chunk binary, digests binary, lengths binary, tokens binary, hashes binary"


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per chunk, with all that is needed to score its texts when the counts of its grams are known."""
    pack = zstandard.ZstdCompressor(level=1)
    for chunk in _chunks(batches):
        hashes, tokens, lengths = chunk.parts()
        digests = b"".join(x["digest"] if isinstance(x, dict) else x for x in chunk.others)
        columns = {
            "chunk": chunk.digest.digest(), "digests": digests, "lengths": _pack(pack, lengths),
            "tokens": _pack(pack, tokens), "hashes": _pack(pack, hashes[:, 0], hashes[:, 1]),
        }
        yield pa.RecordBatch.from_pydict({k: pa.array([x], pa.binary()) for k, x in columns.items()})


def _grams_of(row: dict) -> tuple[_Grams, np.ndarray, np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    (lengths,), (tokens,) = _unpack(unpack, row["lengths"], ("<i8",)), _unpack(unpack, row["tokens"], ("<u4",))
    return _Grams(np.column_stack(_unpack(unpack, row["hashes"], ("<u8", "<u8"))), tokens, lengths), tokens, lengths


def _joined(docs: DataFrame, texts: DataFrame, answers: DataFrame, rules: LmRules) -> DataFrame:
    """``docs`` with the losses of their texts, from the chunks and the counts of their grams."""

    def scored(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        if not texts.num_rows:
            raise RuntimeError("a chunk has lost its texts: the table changed between two reads")
        row = texts.slice(0, 1).to_pylist()[0]  # equal chunks have equal texts, ask and are answered alike
        grams, _, lengths = _grams_of(row)
        by_bucket = dict(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist(), strict=True))
        found = [_unpack(unpack, by_bucket[k], _COUNTS) for k in sorted(by_bucket)]
        if sum(len(x[0]) for x in found) != len(grams.order):
            raise RuntimeError("a chunk has lost its grams: the table changed between two reads")
        text, out = np.repeat(np.arange(len(lengths)), lengths), []
        for k in (0, 1):
            counts = np.empty(len(grams.order))
            counts[grams.order] = np.concatenate([x[k] for x in found])
            words, pairs = counts[: grams.words + 2], counts[grams.words + 2 :]
            p = rules.pair_weight * np.minimum(1, pairs / np.maximum(1, words[grams.left]))
            p += rules.word_weight * words[grams.right] / max(1, words[grams.words + 1])
            p += (1 - rules.pair_weight - rules.word_weight) / (1 << rules.word_bits)
            losses = np.bincount(text, weights=-np.log(p)[grams.pair_of], minlength=len(lengths))
            out.append(losses / np.maximum(1, lengths))
        digests = [row["digests"][a : a + 16] for a in range(0, len(row["digests"]), 16)]
        return pa.table(
            {"_digest": pa.array(digests, pa.binary()), "n_tokens": lengths, "target_loss": out[0], "background_loss": out[1]}
        )

    names = ["n_tokens", "target_loss", "background_loss"]
    kinds = "_digest binary, n_tokens bigint, target_loss double, background_loss double"
    scores = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, kinds)
    # Equal texts have equal losses but for the order of their additions.
    losses = scores.groupBy("_digest").agg(*(F.max(x).alias(x) for x in names))
    out = docs.drop(*names, "difference").withColumn("_digest", _digest())
    out = out.join(written(losses, "lm-losses").hint("merge"), "_digest", "left").drop("_digest")
    out = out.withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0).cast("bigint")))
    out = out.withColumns({x: F.coalesce(x, F.lit(0.0)) for x in names[1:]})
    return out.withColumn("difference", F.col("target_loss") - F.col("background_loss"))
