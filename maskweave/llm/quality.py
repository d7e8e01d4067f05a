"""Quality classifier: histogram gradient-boosted trees over document statistics, in numpy.

Trees are learned on the driver from statistics (never texts) of a bounded sample of labelled rows. They are
flattened into arrays, and all rows of a batch walk down all trees at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from maskweave.llm.toxicity import learning_labels, learning_rows

FEATURES = (
    "log_words", "mean_word", "distinct_share", "stutter_share", "top_share", "symbol_share", "upper_share",
    "digit_share", "punctuation_share", "shout_share", "bar_share", "log_lines", "dup_line_share", "line_words",
    "stop_share", "pack_ratio",
)
#: Bytes by kind, for counts over a byte histogram.
_KINDS = {
    "symbol": b"#*$%&|<>@^~_=+\\/{}[]",
    "upper": bytes(range(65, 91)),
    "digit": bytes(range(48, 58)),
    "punctuation": b".,;:!?",
    "letter": bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)),
}


@dataclass(frozen=True)
class TreeRules:
    """rows: most labelled rows of a class that are learned from, chosen by a hash of the id. They are weighted by their
    class's share of all labelled rows, so that scores do not depend on whether a class has more."""

    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    ridge: float = 1.0
    least: float = 2.0
    rows: int = 8000


def statistics(text: str | None) -> list[float]:
    """The features of one text. Those of a text without words are 0."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    data = text.encode()
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = {k: int(histogram[list(v)].sum()) for k, v in _KINDS.items()}
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    size = max(1, len(data))
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        len(counts) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        max(counts.values()) / n,
        kinds["symbol"] / size,
        kinds["upper"] / max(1, kinds["letter"]),
        kinds["digit"] / size,
        kinds["punctuation"] / n,
        text.count("!!") / n,
        text.count(" | ") / n,
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        sum(v for w, v in counts.items() if len(w) <= 3) / n,
        len(zlib.compress(data, 1)) / size,
    ]


@dataclass
class Trees:
    """All trees in arrays: node k's children are 2k+1 and 2k+2, ``leaf`` holds the values of the lowest level."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of features; all rows walk down all trees together."""
        trees, inner = self.feature.shape
        if not trees or not len(rows):
            return np.full(len(rows), 1 / (1 + np.exp(-self.base)))
        at = np.zeros((len(rows), trees), np.int64)
        tree = np.arange(trees)
        every = np.arange(len(rows))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            right = rows[every, self.feature[tree, at]] > self.threshold[tree, at]
            at = 2 * at + 1 + right
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, at - inner].sum(axis=1))))


def boost(
    rows: np.ndarray, target: np.ndarray, rules: TreeRules = TreeRules(), weight: np.ndarray | None = None
) -> Trees:
    """Gradient boosting of the logistic loss on binned features. Without both classes: no trees, their share.

    ``weight``: of each row, 1 on average."""
    target = np.asarray(target, np.float64)
    weight = np.ones(len(target)) if weight is None else weight
    share = ((weight * target).sum() + 0.5) / (weight.sum() + 1) if len(target) else 0.5
    base = float(np.log(share / (1 - share)))
    inner, leaves = (1 << rules.depth) - 1, 1 << rules.depth
    if len({*target.tolist()}) < 2:
        return Trees(np.empty((0, inner), np.int64), np.empty((0, inner)), np.empty((0, leaves)), base)
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, rules.bins + 1)[1:-1])) for f in range(rows.shape[1])]
    binned = np.column_stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)])
    feature = np.zeros((rules.trees, inner), np.int64)
    threshold = np.full((rules.trees, inner), np.inf)  # a node that is not split sends all rows left
    leaf = np.zeros((rules.trees, leaves))
    score = np.full(len(rows), base)
    for t in range(rules.trees):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = weight * (target - p), weight * p * (1 - p)
        at = np.zeros(len(rows), np.int64)
        for level in range(rules.depth):
            first, nodes = (1 << level) - 1, 1 << level
            best = np.full(nodes, 1e-6)
            for f, c in enumerate(cuts):
                cell = (at - first) * (len(c) + 1) + binned[:, f]
                g, h = (
                    np.bincount(cell, weights=w, minlength=nodes * (len(c) + 1)).reshape(nodes, -1).cumsum(axis=1)
                    for w in (gradient, hessian)
                )
                gl, hl, gr, hr = g[:, :-1], h[:, :-1], g[:, -1:] - g[:, :-1], h[:, -1:] - h[:, :-1]
                gain = gl**2 / (hl + rules.ridge) + gr**2 / (hr + rules.ridge) - g[:, -1:] ** 2 / (h[:, -1:] + rules.ridge)
                gain = np.where((hl >= rules.least) & (hr >= rules.least), gain, 0)
                if not gain.shape[1]:
                    continue
                k = gain.argmax(axis=1)
                top = gain[np.arange(nodes), k]
                better = np.flatnonzero(top > best)
                best[better] = top[better]
                feature[t, first + better] = f
                threshold[t, first + better] = c[k[better]]
            at = 2 * at + 1 + (rows[np.arange(len(rows)), feature[t, at]] > threshold[t, at])
        g = np.bincount(at - inner, weights=gradient, minlength=leaves)
        h = np.bincount(at - inner, weights=hessian, minlength=leaves)
        leaf[t] = rules.rate * g / (h + rules.ridge)
        score += leaf[t, at - inner]
    return Trees(feature, threshold, leaf, base)


@F.pandas_udf(ArrayType(DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return texts.map(statistics)


def fit(docs: DataFrame, labels: DataFrame, rules: TreeRules = TreeRules()) -> Trees:
    """Learn from a bounded sample of labelled rows; only their features come to the driver.

    Both classes are counted in the whole learning fold, and a row weighs what its class's sample stands for."""
    rows = (
        learning_rows(docs, labels, "quality", rules.rows)
        .select("doc_id", "label", _features("text").alias("features"))
        .orderBy("doc_id", "features")
        .toPandas()
    )
    features = np.array(rows["features"].tolist(), np.float64).reshape(-1, len(FEATURES))
    target = rows["label"].to_numpy()
    counts = {r.label: r["count"] for r in learning_labels(labels, "quality").groupBy("label").count().collect()}
    weight = np.array([counts[k] / min(counts[k], rules.rows) for k in target.tolist()], np.float64)
    return boost(features, target, rules, weight / weight.mean() if len(weight) else weight)


def score(docs: DataFrame, model: Trees, out: str = "score") -> DataFrame:
    """``docs`` with the probability that a whole text has label 1.

    Null, empty and blank texts have statistics of 0 and are scored by them. A column named ``out`` is replaced;
    other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))
            yield pd.Series(np.concatenate([shared.value.scores(rows[a : a + 4096]) for a in range(0, max(1, len(rows)), 4096)]))

    return docs.withColumn(out, scored(F.col("text")))
