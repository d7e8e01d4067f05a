"""Embedding near-duplicates by a forest of random-projection trees.

Each tree splits the space at the median of a random projection, again and again; vectors close to a split go to both
sides. Vectors that share a leaf, and a label, are compared, a pair only in the first leaf that it shares over all
trees. Links are counted and joined to components inside the leaves, so pairs are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.llm.common import components, written


@dataclass(frozen=True)
class ForestRules:
    """threshold: least cosine of a link; spill: how far from a split, in units of a unit vector, both sides get a
    vector; leaf: rows of a label aimed at in a leaf; block: rows compared at once, beyond which a leaf is cut in
    blocks that all meet; sample: most vectors that the splits are fitted on, chosen by a hash of the id."""

    threshold: float = 0.93
    trees: int = 8
    spill: float = 0.02
    leaf: int = 256
    block: int = 1024
    sample: int = 20_000
    seed: int = 5


@dataclass
class Forest:
    """Per length of vectors: directions (tree, level) and thresholds (tree, node), nodes as in a heap."""

    rules: ForestRules
    depth: dict[int, int] = field(default_factory=dict)
    thresholds: dict[int, np.ndarray] = field(default_factory=dict)

    def directions(self, dim: int, tree: int) -> np.ndarray:
        """A direction per node of a tree."""
        rng = np.random.default_rng([self.rules.seed, dim, tree])
        found = rng.standard_normal(((1 << self.depth[dim]) - 1, dim))
        return found / np.linalg.norm(found, axis=1, keepdims=True)

    def fit(self, vectors: np.ndarray, most: int) -> None:
        """Splits for vectors of one length, of which a label has ``most`` rows at most."""
        n, dim = vectors.shape
        wanted = int(np.ceil(np.log2(max(1, most / self.rules.leaf))))
        self.depth[dim] = depth = max(0, min(wanted, int(np.log2(max(1, n / 16)))))
        self.thresholds[dim] = np.zeros((self.rules.trees, max(1, (1 << depth) - 1)))
        for tree in range(self.rules.trees):
            at = np.zeros(n, np.int64)
            directions = self.directions(dim, tree)
            for node in range((1 << depth) - 1):
                own = np.flatnonzero(at == node)
                if not len(own):
                    continue
                along = vectors[own] @ directions[node]
                cut = self.thresholds[dim][tree, node] = np.median(along)
                at[own] = 2 * node + 1 + (along > cut)

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves, a pair for each leaf that a vector is in. Leaves are numbered over all trees."""
        n, dim = vectors.shape
        depth = self.depth.get(dim, 0)
        rows_of, leaves_of = [], []
        for tree in range(self.rules.trees):
            rows, at = np.arange(n), np.zeros(n, np.int64)
            directions = self.directions(dim, tree) if depth else None
            for _ in range(depth):
                along = np.einsum("rd,rd->r", vectors[rows], directions[at]) - self.thresholds[dim][tree, at]
                left, right = along <= self.rules.spill, along > -self.rules.spill
                rows, at = np.append(rows[left], rows[right]), np.append(2 * at[left] + 1, 2 * at[right] + 2)
            rows_of.append(rows)
            leaves_of.append(tree * (1 << (depth + 1)) + at)
            if not depth:
                break  # one leaf holds all
        return np.concatenate(rows_of), np.concatenate(leaves_of)


def usable(vector: Column, label: Column) -> Column:
    """Whether a row can link: a label, and a vector of finite numbers that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return label.isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)  # squares of very large or small numbers leave the range
    vectors = vectors / scale
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def near_duplicates(vectors: DataFrame, rules: ForestRules = ForestRules()) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row per row of ``vectors (vec_id, embedding, label)``.

    n_links counts the other rows of the same label and a cosine of ``threshold`` or more that the forest finds;
    component_id is the smallest vec_id that links reach; kept says whether that is the row itself. Equal vectors of a
    label are one from the start and count each other. Vectors that are null, empty, zero, or hold nulls or
    numbers that are not finite, and rows without a label link with nothing. Vectors of different lengths never link.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    rows = rows.withColumn("usable", F.coalesce(usable(F.col("embedding"), F.col("label")), F.lit(False)))
    alike = rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = written(alike.select(F.monotonically_increasing_id().alias("node"), "*"), "forest-nodes")

    forest = Forest(rules)
    sizes = nodes.groupBy(F.size("embedding").alias("dim"), "label").agg(F.count("*").alias("n"))
    most = {r.dim: r.n for r in sizes.groupBy("dim").agg(F.max("n").alias("n")).orderBy(F.desc("n")).limit(16).collect()}
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(rules.sample).select("embedding").toArrow()
    fitted = [np.array(v) for v in sample.column("embedding").to_pylist()]
    for dim, n in most.items():
        own = [v for v in fitted if len(v) == dim]
        if own:
            forest.fit(_unit(np.array(own)), n)
    shared = spark.sparkContext.broadcast(forest)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label, copies = (np.asarray(batch.column(c)) for c in ("node", "label", "copies"))
            lists = batch.column("embedding")
            lengths = np.asarray(pa.compute.list_value_length(lists))
            for dim in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dim)
                got = _unit(np.asarray(lists.take(pa.array(own)).flatten()).reshape(-1, dim))
                row, leaf = shared.value.leaves(got)
                by_row = np.argsort(row, kind="stable")
                ends = np.cumsum(np.bincount(row, minlength=len(own)))
                all_leaves = [np.sort(x).astype(np.int64).tobytes() for x in np.split(leaf[by_row], ends[:-1])]
                data = [x.tobytes() for x in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(label[own][row], batch.schema.field("label").type),
                        pa.array(np.full(len(row), dim, np.int32)),
                        pa.array(leaf),
                        pa.array(node[own][row]),
                        pa.array(copies[own][row]),
                        pa.array([data[k] for k in row.tolist()], pa.binary()),
                        pa.array([all_leaves[k] for k in row.tolist()], pa.binary()),
                    ],
                    names=["label", "dim", "leaf", "node", "copies", "data", "leaves"],
                )

    kind = nodes.schema["label"].dataType.simpleString()
    placed = nodes.select("node", "label", "copies", "embedding").mapInArrow(
        assigned, f"label {kind}, dim int, leaf bigint, node bigint, copies bigint, data binary, leaves binary"
    )
    placed = written(placed, "forest-leaves")
    leaf = ["label", "dim", "leaf"]
    # A leaf beyond the block size is cut in blocks by a hash, and each block meets each.
    large = placed.groupBy(*leaf).agg(F.count("*").alias("n")).where(F.col("n") > rules.block)
    blocks = F.coalesce(F.ceil(F.col("n") / rules.block), F.lit(1)).cast("int")
    cut = placed.join(large, leaf, "left").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        *leaf, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "data", "leaves"
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def done():
            _, dim, own_leaf, i, j = group
            node, copies = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            block = np.array([r[0] for r in rows])
            vectors = np.frombuffer(b"".join(r[3] for r in rows), np.float64).reshape(-1, dim)
            linked = vectors @ vectors.T >= rules.threshold
            np.fill_diagonal(linked, False)
            if i != j:
                linked &= block[:, None] != block[None, :]
            # Not pairs that share a leaf before this one.
            earlier = [x[x < own_leaf] for x in (np.frombuffer(r[4], np.int64) for r in rows)]
            seen, at = np.unique(np.concatenate(earlier), return_inverse=True)
            member = np.zeros((len(rows), len(seen)), np.float32)
            member[np.repeat(np.arange(len(rows)), [len(x) for x in earlier]), at] = 1
            linked &= member @ member.T == 0
            a, b = np.nonzero(linked)
            root = _roots(len(rows), a, b)
            hit = np.flatnonzero(linked.any(axis=1))
            return pa.RecordBatch.from_arrays(
                [pa.array(node[hit]), pa.array(node[root[hit]]), pa.array((linked @ copies)[hit].astype(np.int64))],
                names=["node", "root", "links"],
            )

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in (*leaf, "i", "j")), strict=True))
            values = zip(*(batch.column(c).to_pylist() for c in ("block", "node", "copies", "data", "leaves")), strict=True)
            for key, value in zip(keys, values, strict=True):
                if rows and key != group:
                    yield done()
                    rows = []
                group = key
                rows.append(value)
        if rows:
            yield done()

    task = [*leaf, "i", "j"]
    found = written(
        met.repartition(*task).sortWithinPartitions(*task).mapInArrow(compared, "node bigint, root bigint, links bigint"),
        "forest-links",
    )
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "node")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(joined, "node", "left").join(counts, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    named = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(named, "component").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    same = F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    linked = rows.where("usable").join(known, ["label", "embedding"])
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.select("vec_id", "n_links", "component_id").unionAll(alone).select("*", same)
