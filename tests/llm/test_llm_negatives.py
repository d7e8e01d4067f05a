"""Hard negatives against brute force over all pairs."""

import math

import numpy as np
from pyspark.sql import functions as F

from maskweave.llm import negatives

SCHEMA = "vec_id bigint, label int, vector array<double>, row int, score double"


def brute(rows, is_anchor, rules):
    """rows: (vec_id, label, vector). The answer as a sorted list."""
    use = [r for r in rows if r[1] is not None and r[2] is not None]
    score = lambda a, b: sum(int(x) * int(y) for x, y in zip(a[2], b[2]))
    out = []
    for k, a in enumerate(use):
        if not is_anchor(a[0]):
            continue
        others = [(-score(a, b), b[0] is None, b[0] or 0, b) for i, b in enumerate(use) if i != k and len(b[2]) == len(a[2])]
        others.sort(key=lambda x: x[:3])
        for p in [x for x in others if x[3][1] == a[1]][: rules.positives]:
            fits = [x for x in others if x[3][1] != a[1] and -rules.low * p[0] <= -100 * x[0] <= -rules.high * p[0]]
            for rank, x in enumerate(fits[: rules.negatives], 1):
                out.append((a[0], p[3][0], rank, x[3][0], -p[0], -x[0]))
    return sorted(out, key=str)


def mined(spark, rows, rules=negatives.MiningRules(), every=3):
    df = spark.createDataFrame([(*r, 1, 0.5) for r in rows], SCHEMA)
    got = negatives.mine(df, F.col("vec_id") % every == 0, rules)
    return sorted([tuple(r) for r in got.collect()], key=str)


def test_equals_brute_force_over_blocks_and_batches(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((5, 6))
    rows = [(i, int(rng.integers(4)), [float(math.floor(20 * x)) for x in centres[i % 5] + rng.standard_normal(6) / 2]) for i in range(300)]
    # Ties, repeated rows, null ids, labels and vectors, zero vectors, other lengths.
    rows += rows[:20] + [(None, 1, rows[0][2]), (400, None, rows[0][2]), (402, 1, None), (405, 2, [0.0] * 6), (408, 2, [0.0] * 6)]
    rows += [(500 + i, i % 2, [float(i % 4), 1.0]) for i in range(12)] + [(600, 1, []), (603, 1, []), (604, 2, [])]
    for rules in (negatives.MiningRules(), negatives.MiningRules(block=40, members=7, batch=90, positives=3, negatives=2)):
        assert mined(spark, rows, rules) == brute(rows, lambda v: v is not None and v % 3 == 0, rules)


def test_large_components_stay_exact(spark):
    rows = [(i, i % 2, [float(2**28 + i * 3), float(2**27 - i)]) for i in range(40)]
    assert mined(spark, rows) == brute(rows, lambda v: v % 3 == 0, negatives.MiningRules())


def test_one_group_of_equal_vectors_and_no_rows(spark):
    rows = [(i, i % 2, [3.0, 4.0]) for i in range(200)]
    assert mined(spark, rows) == brute(rows, lambda v: v % 3 == 0, negatives.MiningRules())
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0])]) == []


def test_lists_end_before_all_rows_are_met(spark):
    """The bound certifies: most candidates far from an anchor are never scored."""
    rng = np.random.default_rng(1)
    vectors = np.floor(np.concatenate([rng.standard_normal((500, 8)) + 40 * np.eye(8)[k] for k in range(8)]) * 16)
    labels = np.tile([0, 1], 2000).tolist()
    block = negatives._Block(np.arange(20), labels[:20], {8: vectors[:20]}, {8: np.arange(20)}, {8: negatives.clusters(vectors[:20], np.arange(20), 10)})
    search, seen = negatives._Search(block, negatives.MiningRules()), []
    walk = search._walk
    search._walk = lambda active, score, *more: (seen.append(score.size), walk(active, score, *more))
    search.batch(8, np.arange(4000), list(range(4000)), labels, vectors)
    assert sum(seen) < 20 * 4000 / 5


def test_fixed_point_and_finite(spark):
    df = spark.createDataFrame([([0.5, -0.001],), ([float("nan")],), ([None],), (None,), ([float("inf")],)], "e array<float>")
    got = df.select(negatives.finite(F.col("e")).alias("f")).collect()
    assert [r.f for r in got] == [True, False, False, False, False]
    assert df.where(negatives.finite(F.col("e"))).select(negatives.whole_vectors(F.col("e")).alias("v")).collect()[0].v == [128.0, -1.0]
