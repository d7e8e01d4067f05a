"""Hard negatives by lists that clusters of anchors share.

Anchors are taken in blocks and grouped into clusters around a centre. In a task, the candidates of a batch are sorted
once for each cluster by a bound that holds for all its members: a candidate at angle t to the centre can be at no less
than t - s to a member, s being the widest angle between centre and member, so its score is at most the two lengths
times the cosine of that. Every member walks the list from the top, and stops where the bound falls below what it still
looks for. What a task has found so far goes on as the threshold for its next batches; the tasks' few best are merged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskweave.llm.common import shared_folder, written

#: Angles are computed to about 1e-8; bounds are widened by more than that.
ANGLE_SLACK = 1e-6
#: Whole numbers up to here are exact in double precision.
EXACT = 2.0**53


@dataclass(frozen=True)
class MiningRules:
    """positives, negatives: rows kept of each; low, high: a negative's score in percent of the positive's; block:
    anchors that meet all rows in one job; members: anchors aimed at in a cluster; batch: candidates sorted at once."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    block: int = 4096
    members: int = 64
    batch: int = 8192


@dataclass
class _Cluster:
    """Anchors (by their place in the block) around a unit centre, none farther from it than ``spread``."""

    members: np.ndarray
    centre: np.ndarray
    spread: float

    def order(self, vectors: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shared list: candidates by falling bound for an anchor of length 1, and the bounds."""
        bound = norms * np.cos(np.maximum(0, _angles(vectors, norms, self.centre) - self.spread - ANGLE_SLACK))
        order = np.argsort(-bound, kind="stable")
        return order, bound[order] * (1 + 1e-9) + 1e-9


def _angles(vectors: np.ndarray, norms: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centre / np.where(norms > 0, norms, 1), -1, 1))


def _lengths(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, initial=0)  # squares of very large numbers leave the range
    return scale * np.linalg.norm(vectors / np.where(scale > 0, scale, 1)[:, None], axis=1)


def clusters(vectors: np.ndarray, places: np.ndarray, members: int) -> list[_Cluster]:
    """A few rounds of spherical k-means over anchors of one length, the same for the same anchors."""
    norms = _lengths(vectors)
    unit = vectors / np.where(norms > 0, norms, 1)[:, None]
    k = -(-len(unit) // members)
    centres = unit[np.linspace(0, len(unit) - 1, k).astype(int)]
    for _ in range(6):
        own = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    own = np.argmax(unit @ centres.T, axis=1)
    found = []
    for c in np.unique(own).tolist():
        at = np.flatnonzero(own == c)
        found.append(_Cluster(places[at], centres[c], float(_angles(vectors[at], norms[at], centres[c]).max())))
    return found


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, as 64-bit integers; beyond these an error."""
    most = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(1, left.shape[1])
    if most < EXACT:
        return np.rint(left @ right.T).astype(np.int64)
    exact = [np.array([[int(x) for x in row] for row in side], object).reshape(side.shape) for side in (left, right)]
    return np.dot(exact[0], exact[1].T).astype(np.int64)


@dataclass
class _Block:
    """Anchors that meet the rows in one job. ``wanted``: for each anchor, the (score, row) of its positives, when negatives are sought."""

    rows: np.ndarray
    labels: list
    vectors: dict[int, np.ndarray]
    places: dict[int, np.ndarray]
    clusters: dict[int, list[_Cluster]]
    wanted: list[list[tuple[int, int]]] | None = None


class _Best:
    """The best rows found for one search so far, as (-score, id is null, id, row), best first."""

    __slots__ = ("found", "k")

    def __init__(self, k: int):
        self.found: list[tuple] = []
        self.k = k

    @property
    def least(self) -> float:
        """Rows below this score can't get in."""
        return -self.found[-1][0] if len(self.found) == self.k else -np.inf

    def add(self, more: list[tuple]) -> None:
        self.found = sorted(self.found + more)[: self.k]


class _Search:
    """What the anchors of a block look for, and what one task has found."""

    def __init__(self, block: _Block, rules: MiningRules):
        self.block, self.rules = block, rules
        n = len(block.rows)
        # Of a search: the anchor, the scores it takes, and the best so far.
        if block.wanted is None:
            self.of = [[_Best(rules.positives)] for _ in range(n)]
            self.bands = [[(-np.inf, np.inf)]] * n
        else:
            self.of = [[_Best(rules.negatives) for _ in some] for some in block.wanted]
            self.bands = [[(s * rules.low / 100, s * rules.high / 100) for s, _ in some] for some in block.wanted]
        self.numbers = {v: k for k, v in enumerate(dict.fromkeys(block.labels))}
        self.label = np.array([self.numbers[v] for v in block.labels], np.int64)
        self.least = np.array([self._least(a) for a in range(n)])
        # One step of a double wider, as scores may have more digits than a double; the searches compare exactly.
        self.highest = np.array([np.nextafter(max((b[1] for b in some), default=-np.inf), np.inf) for some in self.bands])

    def _least(self, a: int) -> float:
        """Candidates below this score are of no use to an anchor."""
        of = zip(self.bands[a], self.of[a], strict=True)
        return np.nextafter(min((max(b[0], o.least) for b, o in of if b[0] <= b[1]), default=np.inf), -np.inf)

    def batch(self, dim: int, rows: np.ndarray, ids: list, labels: list, vectors: np.ndarray) -> None:
        """Walks the lists of one batch of candidates."""
        norms = _lengths(vectors)
        label = np.array([self.numbers.get(v, -1) for v in labels], np.int64)
        own = self.block.vectors[dim]
        own_norms, at = _lengths(own), {p: k for k, p in enumerate(self.block.places[dim].tolist())}
        for cluster in self.block.clusters[dim]:
            order, bounds = cluster.order(vectors, norms)
            active, start, step = cluster.members, 0, 64
            local = np.array([at[p] for p in active.tolist()])
            while start < len(order):
                going = own_norms[local] * bounds[start] >= self.least[active]
                active, local = active[going], local[going]
                if not len(active):
                    break
                some = order[start : start + step]
                self._walk(active, scores(own[local], vectors[some]), rows[some], label[some], [ids[k] for k in some.tolist()])
                start, step = start + step, min(step * 2, 1024)

    def _walk(self, active: np.ndarray, score: np.ndarray, rows: np.ndarray, label: np.ndarray, ids: list) -> None:
        same = label[None, :] == self.label[active][:, None]
        if self.block.wanted is None:
            fits = same & (rows[None, :] != self.block.rows[active][:, None])
        else:
            fits = ~same & (score <= self.highest[active][:, None])
        fits &= score >= self.least[active][:, None]
        low, high = self.rules.low, self.rules.high
        for k in np.flatnonzero(fits.any(axis=1)).tolist():
            a, hits = int(active[k]), np.flatnonzero(fits[k])
            got = [(-s, ids[c] is None, ids[c] or 0, r) for s, c, r in zip(score[k, hits].tolist(), hits.tolist(), rows[hits].tolist(), strict=True)]
            if self.block.wanted is None:
                self.of[a][0].add(got)
            else:
                for (p, _), best in zip(self.block.wanted[a], self.of[a], strict=True):
                    best.add([x for x in got if low * p <= -100 * x[0] <= high * p])
            self.least[a] = self._least(a)

    def rows(self) -> pa.RecordBatch:
        out = [
            (int(self.block.rows[a]), p, *((-x[0], None if x[1] else x[2], x[3])))
            for a, some in enumerate(self.of)
            for p, best in enumerate(some)
            for x in best.found
        ]
        columns = list(zip(*out, strict=True)) or [()] * 5
        names = ("anchor", "place", "score", "vec_id", "row")
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


_FOUND = "anchor bigint, place int, score bigint, vec_id bigint, row bigint"


def _met(rows: DataFrame, block: _Block, rules: MiningRules, k: int) -> DataFrame:
    """The best rows of each search in a block: those of the tasks, merged."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(shared.value, rules)
        for whole in batches:
            for at in range(0, whole.num_rows, rules.batch):
                batch = whole.slice(at, rules.batch)
                lists = batch.column("vector")
                lengths = np.asarray(pa.compute.list_value_length(lists))
                row, ids, labels = np.asarray(batch.column("row")), batch.column("vec_id").to_pylist(), batch.column("label").to_pylist()
                for dim in np.unique(lengths).tolist():
                    if dim in shared.value.vectors:
                        own = np.flatnonzero(lengths == dim)
                        got = np.asarray(lists.take(pa.array(own)).flatten(), np.float64).reshape(len(own), dim)
                        search.batch(dim, row[own], [ids[i] for i in own.tolist()], [labels[i] for i in own.tolist()], got)
        yield search.rows()

    best = W.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    found = rows.select("row", "vec_id", "label", "vector").mapInArrow(searched, _FOUND)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def whole_vectors(embedding: Column) -> Column:
    """Each component x as floor(256*x), in doubles; a fixed-point form whose inner products are whole numbers."""
    return F.transform(embedding.cast("array<double>"), lambda x: F.floor(x * 256).cast("double"))


def finite(embedding: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    x = embedding.cast("array<double>")
    return F.coalesce(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


_MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(vectors: DataFrame, anchor: Column, rules: MiningRules = MiningRules()) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``vectors (vec_id, vector, label)``.

    ``vector`` holds whole numbers as doubles; a score is the exact inner product. An anchor, a row for which ``anchor``
    is true, has its ``positives`` best other rows of its label; for each, the ``negatives`` best rows of another label
    whose score is ``low`` to ``high`` percent of the positive's are returned, rank 1 first. Equal scores go by smaller
    vec_id, null ids last. Each row counts by itself, also where ids or vectors repeat. Rows with a null label or vector
    take no part, rows of other lengths don't meet, a zero vector scores 0. Empty tables, and anchors without positives
    or negatives, give no rows. Scores beyond 64 bits end the job. Other columns are not read.
    """
    spark = vectors.sparkSession
    source = vectors.select("vec_id", "label", "vector", F.coalesce(anchor, F.lit(False)).alias("anchor"))
    source = source.where("label is not null and vector is not null")
    rows = written(source.select(F.monotonically_increasing_id().alias("row"), "*"), "negatives-rows")
    n = rows.where("anchor").count()
    blocks = max(1, -(-n // rules.block))
    folder = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    paths = []
    for b in range(blocks if n else 0):
        own = rows.where("anchor").where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).orderBy("row")
        anchors = own.select("row", "vec_id", "label", "vector").toArrow()  # about ``block`` rows
        if not anchors.num_rows:
            continue
        row = np.asarray(anchors.column("row"))
        ids = dict(zip(row.tolist(), anchors.column("vec_id").to_pylist(), strict=True))
        lists = anchors.column("vector").to_pylist()
        length = np.array([len(v) for v in lists])
        places = {d: np.flatnonzero(length == d) for d in np.unique(length).tolist()}
        own_vectors = {d: np.array([lists[p] for p in at.tolist()], np.float64).reshape(len(at), d) for d, at in places.items()}
        grouped = {d: clusters(own_vectors[d], places[d], rules.members) for d in places}
        block = _Block(row, anchors.column("label").to_pylist(), own_vectors, places, grouped)

        first = _met(rows, block, rules, rules.positives).toArrow().to_pylist()  # ``positives`` rows an anchor
        at = {r: k for k, r in enumerate(row.tolist())}
        block.wanted = [[] for _ in row]
        names = []
        for x in sorted(first, key=lambda x: (x["anchor"], x["rank"])):
            some = block.wanted[at[x["anchor"]]]
            names.append((x["anchor"], len(some), ids[x["anchor"]], x["vec_id"], x["score"]))
            some.append((x["score"], x["row"]))
        if not names:
            continue
        pairs = spark.createDataFrame(names, "anchor bigint, place int, anchor_id bigint, positive_id bigint, positive_score bigint")
        mined = _met(rows, block, rules, rules.negatives).join(F.broadcast(pairs), ["anchor", "place"])
        paths.append(f"{folder}/{b}")
        mined.select(
            "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        ).write.parquet(paths[-1])
    if not paths:
        return spark.createDataFrame([], _MINED)
    return spark.read.schema(_MINED).parquet(*paths)
