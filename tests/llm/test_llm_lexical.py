"""Lexical search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np

from maskweave.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    lists = [(i, words(t)) for i, t in docs]
    lists = [(i, w) for i, w in lists if w]
    n_docs, n_terms = len(lists), sum(len(w) for _, w in lists)
    df = Counter(t for _, w in lists for t in set(w))
    out = []
    for name, text in items:
        found = []
        for k, (i, w) in enumerate(lists):
            m = 25 + (75 * len(w) * n_docs) // n_terms
            tf = Counter(w)
            score = 0
            for t in words(text):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += weight * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, k, i))
        out += [(name, rank, x[4], -x[0]) for rank, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, rules=lexical.SearchRules()):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id bigint, text string, score int, row int")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, rank int")
    return sorted([tuple(r) for r in lexical.search(lexical.build(d, rules=rules), q).collect()], key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Größe", "naïve", "日本語", "x9", "Ünder"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    text = lambda size: rng.choice([" ", "-", "_, "]).join(rng.choices(vocabulary, weights, k=size))
    docs = [(i, text(rng.choice([1, 3, 10, 60, 300]))) for i in range(n)]
    docs += docs[:15] + [(None, docs[3][1]), (None, docs[3][1]), (n, None), (n + 1, ""), (n + 2, " .,\n"), (n + 3, "w1 " * 3000)]
    items = [(i, text(rng.choice([1, 2, 8, 30]))) for i in range(30)]
    return docs, items + items[:2] + [(None, "W3 w3 W1"), (77, None), (78, ""), (79, "zzz"), (80, "Größe GRÖSSE größe"), (81, docs[0][1].upper())]


def test_equals_brute_force(spark):
    docs, items = corpus(1, 250)
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    # Few coordinates, small batches and many blocks give the same.
    small = lexical.SearchRules(rows=1, load=1, seeds=2, items=5, batch=20)
    assert found(spark, docs, items, small) == want
    assert found(spark, docs, items, lexical.SearchRules(top=3)) == brute(docs, items, 3)


def test_a_group_of_equal_documents_ties_by_id(spark):
    docs = [(i, "same words here") for i in range(300, 0, -1)] + [(0, "other")]
    items = [(1, "same words"), (2, "other here")]
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b")]) == []
    assert found(spark, [(1, None), (2, "..")], [(1, "a b")]) == []
    assert found(spark, [(1, "a b")], []) == []


def test_a_very_long_text(spark):
    docs = [(1, " ".join(f"t{k}" for k in range(120_000)) + " a a a"), (2, "a t5"), (3, "b")]
    items = [(1, "a t5 t119999"), (2, " ".join(f"t{k}" for k in range(9000)))]
    assert found(spark, docs, items) == brute(docs, items)


def test_bounds_hold_and_prune():
    docs, items = corpus(2, 400)
    texts = [t.encode() for _, t in docs if words(t)]
    rules, n = lexical.SearchRules(), np.array([len(lexical.terms(t)) for t in texts])
    queries = lexical._Queries([t.encode() for _, t in items if t])
    df = Counter(t for x in texts for t in set(lexical.terms(x)))
    queries.weigh({k: df[t] for t, k in queries.number.items()}, len(texts))
    bits, cells = zip(*(lexical.sketch(Counter(lexical.terms(t)), rules) for t in texts), strict=True)
    m = lexical._length_norm(n, (len(texts), int(n.sum())))
    bounds = lexical._bounds(queries, np.array(bits), list(cells), m, rules.rows)
    found = [queries.occurrences(t) for t in texts]
    exact = np.array([[lexical._exact(queries, found[d], int(m[d]), q) for q in range(len(queries.of))] for d in range(len(texts))])
    assert (bounds >= exact).all()
    assert (bounds - exact).sum() < 0.02 * exact.sum()
