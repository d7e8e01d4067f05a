"""N-gram Jaccard join with token-combination prefixes.

Two texts link when their shingle sets have a Jaccard similarity of ``percent`` or more. The steps:

1. Shingles are counted by class (a hash of 24 bits) over all texts. A class far above the mean is frequent.
   The counts travel as compressed slices; the answer is a bitmap of fixed size, which is broadcast.
2. Each distinct set is ordered with its rare shingles first. Sets that link share two shingles within the
   prefix extended by one, so each shares a rare shingle there, which is indexed alone, or two frequent ones,
   which are indexed as a combination. Where a long set would have too many combinations, its frequent shingles
   are indexed alone, and so are those of shorter sets that a long one can link with.
3. The index is ordered by key, size class and number of rare shingles. Each set is checked against the head of
   its class and its neighbour, which joins a group of near copies by a star, not by all its pairs. Then all pairs
   of sets that share a key and are not yet connected are checked. So no link between different components is
   lost, and pairs within a component, which cannot change the answer, are never made.

Sets are known by a 64-bit digest, shingles by a 64-bit hash. No step gathers a group: the index is dealt out
by ranges, so that one key with many sets lies over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskweave.llm.common import components, written

CLASS_BITS = 24
SLICE = 1 << 16
FREQUENT = 32


@dataclass(frozen=True)
class JaccardRules:
    """width: words of a shingle; percent: 100 * intersection >= percent * union; combine_below: set size up to
    which frequent shingles are indexed in pairs."""

    width: int = 4
    percent: int = 85
    combine_below: int = 256

    def __post_init__(self):
        if not 50 < self.percent <= 100 or self.width < 1:
            raise ValueError("percent must be over 50 and at most 100, width at least 1")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A-Z are lower-cased; a null text has none."""
    words = [(t or "").encode().lower().split() for t in texts]
    flat = [w for ws in words for w in ws]
    known = {w: xxhash.xxh64_intdigest(w) for w in dict.fromkeys(flat)}
    hashes = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
    n = len(hashes) - width + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        rolled = _mixed(rolled + hashes[k : k + n] + np.uint64(k))
    out, at = [], 0
    for ws in words:
        if len(ws) >= width:
            out.append(np.unique(rolled[at : at + len(ws) - width + 1]))
        elif ws:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(ws), seed=len(ws))], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += len(ws)
    return out


def parts(batch: pa.RecordBatch, characters: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded text, so that memory does not follow the length of texts."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0))
    part = (np.cumsum(lengths) // characters).astype(np.int64)
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
    for a, b in zip(starts, starts[1:], strict=False):
        yield batch.slice(a, b - a)


def _frequent(docs: DataFrame, rules: JaccardRules) -> np.ndarray:
    """A bitmap of the frequent classes: counts over all distinct shingles of all texts."""
    width = rules.width

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CLASS_BITS, np.uint32)
        seen = set()
        for batch in batches:
            for part in parts(batch):
                for s in shingle_sets(part.column("text").to_pylist(), width):
                    sid = xxhash.xxh64_intdigest(s.tobytes())
                    if len(s) and sid not in seen:
                        seen.add(sid)
                        counts[(s >> np.uint64(64 - CLASS_BITS)).astype(np.int64)] += 1
        pack = zstandard.ZstdCompressor(level=3)
        for at in range(0, len(counts), SLICE):
            some = counts[at : at + SLICE]
            if some.any():
                data = pack.compress(np.minimum(some, 65535).astype(np.uint16).tobytes())
                yield pa.RecordBatch.from_pydict({"slice": pa.array([at // SLICE], pa.int32()), "counts": pa.array([data])})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, at, total = zstandard.ZstdDecompressor(), None, None

        def bits():
            limit = FREQUENT + 4 * total.mean()
            return pa.RecordBatch.from_pydict(
                {"slice": pa.array([at], pa.int32()), "bits": pa.array([np.packbits(total > limit).tobytes()])}
            )

        for batch in batches:
            for k, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != at:
                    if at is not None:
                        yield bits()
                    at, total = k, np.zeros(SLICE, np.int64)
                total += np.frombuffer(unpack.decompress(data), np.uint16)
        if at is not None:
            yield bits()

    slices = (1 << CLASS_BITS) // SLICE
    found = (
        docs.select("text")
        .mapInArrow(counted, "slice int, counts binary")
        .repartition(slices, "slice")
        .sortWithinPartitions("slice")
        .mapInArrow(summed, "slice int, bits binary")
        .collect()
    )
    bitmap = np.zeros(1 << (CLASS_BITS - 3), np.uint8)
    for row in found:
        bitmap[row.slice * SLICE // 8 : (row.slice + 1) * SLICE // 8] = np.frombuffer(row.bits, np.uint8)
    return bitmap


def _keys(s: np.ndarray, bitmap: np.ndarray, rules: JaccardRules) -> tuple[np.ndarray, int, int]:
    """The index keys of one set, how many of its shingles are rare, and how many keys are rare shingles."""
    n = len(s)
    least = -(-rules.percent * n // 100)
    if least < 2:
        return np.empty(0, np.uint64), 0, 0
    cls = (s >> np.uint64(64 - CLASS_BITS)).astype(np.int64)
    heavy = ((bitmap[cls >> 3] >> (7 - (cls & 7)).astype(np.uint8)) & 1).astype(np.int64)
    order = _mixed(s)
    prefix = np.lexsort((order, heavy))[: min(n, n - least + 2)]
    rare, often = s[prefix[heavy[prefix] == 0]], s[prefix[heavy[prefix] == 1]]
    found = [rare]
    if n <= rules.combine_below and len(often) > 1:
        often = np.sort(often)
        a, b = np.triu_indices(len(often), 1)
        found.append(_mixed(often[a] * np.uint64(3) + _mixed(often[b])))
    if 100 * n >= rules.percent * rules.combine_below:
        found.append(often)
    return np.concatenate(found), int(n - heavy.sum()), len(rare)


def _outline(s: np.ndarray) -> bytes | None:
    """How many shingles of a set fall in each of n / 8 to n / 4 parts of the hash space, a byte each."""
    bits = max(3, len(s).bit_length() - 3)
    counts = np.bincount((_mixed(s) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _may_link(x: bytes | None, y: bytes | None, n_x: int, n_y: int, percent: int) -> bool:
    """Whether two sets can link by their outlines: part by part, they share no more than the smaller has there."""
    if x is None or y is None:
        return True
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    parts = min(len(a), len(b))
    both = int(np.minimum(a.reshape(parts, -1).sum(axis=1), b.reshape(parts, -1).sum(axis=1)).sum())
    return 100 * both >= percent * (n_x + n_y - both)


def _index(docs: DataFrame, bitmap: np.ndarray, rules: JaccardRules) -> DataFrame:
    """``(doc_id, sid, n, keys, ...)`` per text; what belongs to a set stands once in each task."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part in parts(batch):
                sids, sizes, keys, rare, alone, outlines = [], [], [], [], [], []
                for s in shingle_sets(part.column("text").to_pylist(), rules.width):
                    sid = xxhash.xxh64_intdigest(s.tobytes()) if len(s) else None
                    sizes.append(len(s))
                    new = sid is not None and sid not in seen
                    found, n_rare, n_alone = _keys(s, shared.value, rules) if new else (None, None, None)
                    keys.append(found.view(np.int64) if new else None)
                    rare.append(n_rare)
                    alone.append(n_alone)
                    outlines.append(_outline(s) if new else None)
                    seen.add(sid)
                    sids.append(None if sid is None else int(np.uint64(sid).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(sids, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(rare, pa.int64()),
                        pa.array(alone, pa.int64()),
                        pa.array(outlines, pa.binary()),
                    ],
                    names=["doc_id", "sid", "n", "keys", "n_rare", "n_alone", "outline"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(
        keyed, f"doc_id {kind}, sid bigint, n bigint, keys array<bigint>, n_rare bigint, n_alone bigint, outline binary"
    )
    return written(out, "jaccard-index")


def _fits(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of one key can link, by (n, h) in two columns: similar sizes, and no more shared than h."""
    small, large = np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, 0], b[:, 0])
    most = np.minimum(a[:, 1], b[:, 1])
    return (100 * small >= percent * large) & ((100 + percent) * most >= percent * (small + large))


def _shared_keys(index: DataFrame, rules: JaccardRules) -> DataFrame:
    """``(key, n, h, sid, near)``: the index without keys that only one set has.

    h bounds what a set shares with another through this key: all of it for a rare shingle, else its frequent
    shingles, since sets that also share a rare one meet by that one. Rows of a key are in the order of size class
    and then of rare shingles, fewest first: the first of a class is the text that edited copies come from, if it
    is there. near: the heads of the row's class and of the class below, and the row before, where they can link.
    """
    percent = rules.percent

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_, class_, n_, h_, sid_ = 0, 1, 3, 4, 5
        held = None  # the last row, until what follows it is known
        before = head = below = None  # rows that the next block goes on from
        first = None  # the partition's first and last key may go on in other partitions

        def rows(block: np.ndarray, following: int | None) -> pa.RecordBatch | None:
            """following: the key of the row after the block, None at the partition's end."""
            nonlocal before, head, below, first
            if first is None:
                first = block[0, key_]
            start = before if before is not None else np.full(6, -1)
            earlier = np.vstack([start, block[:-1]])
            fresh = (earlier != block).any(axis=1)
            fresh[0] |= before is None
            block, earlier = block[fresh], earlier[fresh]
            if not len(block):
                return None
            same_key = earlier[:, key_] == block[:, key_]
            if before is None:
                same_key[0] = False
            new_run = ~same_key | (earlier[:, class_] != block[:, class_])
            at = np.maximum.accumulate(np.where(new_run, np.arange(len(block)), -1))
            none = np.full(6, -1)
            heads = np.where((at >= 0)[:, None], block[at], none if head is None else head)
            run_starts = np.flatnonzero(new_run)
            # The head of the run before, for each run that this block starts.
            previous = np.vstack([[head if head is not None else none], block[run_starts]])[: len(run_starts)]
            run_of = np.cumsum(new_run) - 1
            belows = np.where(
                (run_of >= 0)[:, None],
                previous[run_of] if len(run_starts) else none,
                none if below is None else below,
            )
            usable = lambda other: (
                (other[:, key_] == block[:, key_])
                & (other[:, n_] > 0)
                & (other[:, sid_] != block[:, sid_])
                & _fits(other[:, [n_, h_]], block[:, [n_, h_]], percent)
            )
            others = [heads, belows, earlier]
            near = np.stack([usable(o) for o in others], axis=1)
            sids = np.stack([o[:, sid_] for o in others], axis=1)
            before, head, below = block[-1], heads[-1], belows[-1]
            keep = same_key | np.append(same_key[1:], following is not None and following == block[-1, key_])
            keep |= (block[:, key_] == first) | ((following is None) & (block[:, key_] == block[-1, key_]))
            if not keep.any():
                return None
            block, near, sids = block[keep], near[keep], sids[keep]
            ends = np.append(0, np.cumsum(near.sum(axis=1))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(sids[near]))
            columns = [pa.array(block[:, c]) for c in (key_, n_, h_, sid_)]
            return pa.RecordBatch.from_arrays([*columns, lists], names=["key", "n", "h", "sid", "near"])

        for batch in batches:
            block = np.column_stack([np.asarray(c) for c in batch.columns])
            block = block if held is None else np.vstack([held, block])
            held = block[-1:]
            if len(block) > 1 and (out := rows(block[:-1], block[-1, key_])) is not None:
                yield out
        if held is not None and (out := rows(held, None)) is not None:
            yield out

    listed = index.where(F.size("keys") > 0).select(
        F.posexplode("keys").alias("place", "key"), "sid", "n", "n_rare", "n_alone"
    )
    rows = listed.select(
        "key",
        F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent))).alias("class") if percent < 100 else F.col("n").alias("class"),
        "n_rare",
        "n",
        F.when(F.col("place") < F.col("n_alone"), F.col("n")).otherwise(F.col("n") - F.col("n_rare")).alias("h"),
        "sid",
    )
    order = ["key", "class", "n_rare", "n", "h", "sid"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(
        ordered.mapInArrow(kept, "key bigint, n bigint, h bigint, sid bigint, near array<bigint>"), "jaccard-keys"
    )


def bitmap_of(ids: DataFrame, column: str, per_row: int = 16, most_bits: int = 26) -> tuple[np.ndarray, int]:
    """A bitmap over a hash of the ids, at most 8 MB: who is not in it is not among them."""
    n = ids.count()
    bits = max(16, min(most_bits, int(np.ceil(np.log2(max(1, n * per_row))))))
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    found = (
        ids.select(F.shiftright(slot, 6).cast("int").alias("word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        .toArrow()
    )
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[np.asarray(found.column("word"))] = np.asarray(found.column("bits")).view(np.uint64)
    return words, bits


def _verified(docs: DataFrame, index: DataFrame, pairs: DataFrame, rules: JaccardRules) -> DataFrame:
    """Those of ``pairs (a, b)`` of set digests that link: first by the bound of their outlines, then by whole sets."""
    width, percent = rules.width, rules.percent

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n_x", "n_y")), strict=True)
            mask = pa.array([_may_link(*r, percent) for r in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(mask)

    outlines = index.where("keys IS NOT NULL").groupBy("sid").agg(F.first("n").alias("n"), F.first("outline").alias("o"))
    outlined = pairs.join(outlines.select(F.col("sid").alias("a"), F.col("o").alias("x"), F.col("n").alias("n_x")), "a").join(
        outlines.select(F.col("sid").alias("b"), F.col("o").alias("y"), F.col("n").alias("n_y")), "b"
    )
    pairs = written(
        outlined.select("a", "b", "x", "y", "n_x", "n_y").mapInArrow(bounded, "a bigint, b bigint"), "jaccard-pairs"
    )
    ids = written(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct(), "jaccard-ids")
    words, bits = bitmap_of(ids, "sid")
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part in parts(batch):
                sids, sets = [], []
                for s in shingle_sets(part.column("text").to_pylist(), width):
                    if not len(s) or (sid := xxhash.xxh64_intdigest(s.tobytes())) in seen:
                        continue
                    slot = sid & ((1 << bits) - 1)
                    if int(shared.value[slot >> 6]) >> (slot & 63) & 1:
                        seen.add(sid)
                        sids.append(int(np.uint64(sid).astype(np.int64)))
                        sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sids, pa.int64()), pa.array(sets, pa.binary())], names=["sid", "data"]
                )

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(mask)

    found = docs.select("text").mapInArrow(wanted, "sid bigint, data binary").join(ids, "sid", "left_semi")
    sets = written(found.dropDuplicates(["sid"]), "jaccard-sets")
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("data").alias("x")), "a").join(
        sets.select(F.col("sid").alias("b"), F.col("data").alias("y")), "b"
    )
    return written(both.select("a", "b", "x", "y").mapInArrow(linked, "a bigint, b bigint"), "jaccard-edges")


def links(docs: DataFrame, index: DataFrame, rules: JaccardRules) -> DataFrame:
    """Links between set digests that join all that is connected."""
    keys = _shared_keys(index, rules)
    near = keys.select("sid", F.explode("near").alias("other"))
    near = near.select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).distinct()
    first = _verified(docs, index, near, rules)
    label = components(first).select(F.col("id").alias("sid"), "component")
    rows = keys.select("key", "n", "h", "sid").join(label, "sid", "left")
    rows = rows.withColumn("component", F.coalesce("component", "sid"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    rows = written(rows.join(mixed.select("key"), "key", "left_semi"), "jaccard-open")
    left, right = (rows.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("n", "h", "sid", "component")]) for s in "ab")
    fits = (
        "sid_a < sid_b AND component_a <> component_b"
        f" AND least(n_a, n_b) * 100 >= greatest(n_a, n_b) * {rules.percent}"
        f" AND least(h_a, h_b) * {100 + rules.percent} >= (n_a + n_b) * {rules.percent}"
    )
    rest = left.join(right, "key").where(fits).select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b")).distinct()
    return first.unionAll(_verified(docs, index, rest, rules))


def join(docs: DataFrame, rules: JaccardRules = JaccardRules()) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, a row per row of ``docs``.

    component_id is the smallest doc_id that links reach. Equal sets are one set from the start, so copies are never
    paired. Null, empty and blank texts have no shingles and link with nothing; a text with fewer words than a
    shingle is one shingle. Rows with a null doc_id belong to components like all others, but never name one;
    their own component is null if it has no other row.
    """
    index = _index(docs, _frequent(docs, rules), rules)
    label = components(links(docs, index, rules)).select(F.col("id").alias("sid"), "component")
    known = index.where("sid IS NOT NULL")
    sets = known.groupBy("sid").agg(F.min("doc_id").alias("least")).join(label, "sid", "left")
    sets = written(sets.withColumn("component", F.coalesce("component", "sid")), "jaccard-sets")
    named = sets.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = sets.join(named, "component").select("sid", "component_id")
    linked = known.join(by_set, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = index.where("sid IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone)


def first_of_each(docs: DataFrame, rules: JaccardRules = JaccardRules()) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps the one with its smallest doc_id.

    Texts without shingles all stay. Rows that repeat an id and a text stay once. Rows with a null id are not compared
    and all stay.
    """
    named = docs.where("doc_id IS NOT NULL")
    kept = join(named, rules).where("doc_id = component_id").select("doc_id").distinct()
    first = named.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return first.unionAll(docs.where("doc_id IS NULL"))
