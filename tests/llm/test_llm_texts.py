"""Text operators against brute force, and their answers on nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from maskweave.llm import bpe, jaccard, lm, mixing, quality, quality_rules, token_counts, toxicity
from maskweave.llm.common import components
from maskweave.llm.queries import BPE_PATH, PIECES_PATH, QUERIES, bpe_digests

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, source string, score double, kept string, n string"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def odd_rows():
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice("lorem dolor sit amet the of and x1 é漢").replace(" ", "a") + str(rng.randrange(40)) for _ in range(n))
    base = prose(60).split()
    near = [*base[:30], "changed", *base[31:]]
    long = prose(30_000)
    rows = [
        (1, None, "a", 0.5, "k", "x"), (2, "", "a", None, None, None), (3, " \n\t ", None, 1.0, "k", "x"),
        (4, " ".join(base), "b", 1.0, "k", "x"), (5, " ".join(near), "b", 1.0, "k", "x"), (6, " ".join(base), "b", 1.0, "k", "x"),
        (7, long, "c", 1.0, "k", "x"), (8, long + " end", None, 1.0, "k", "x"), (9, "two words", "c", 1.0, "k", "x"),
        (9, "two words", "c", 1.0, "k", "x"), (10, "Two WORDS", "c", 1.0, "k", "x"), (None, " ".join(base), "b", 1.0, "k", "x"),
        (11, "a b c d e f g h " * 9 + "\nsame line\nsame line", "a", 1.0, "k", "x"), (12, "\U0001f600 \x1c\x85 ﬁ \n\n  x", "a", 1.0, "k", "x"),
    ]
    return rows + [(100 + k, prose(rng.randrange(5, 90)), rng.choice("abc"), 1.0, "k", "x") for k in range(30)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def repeat_words(w, k=8):
    seen = Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    return len({p for j in range(len(w) - k + 1) if seen[tuple(w[j : j + k])] > 1 for p in range(j, j + k)})


def test_rules_count_as_defined(odd, documents):
    for docs in (odd.drop("n"), documents):
        for r in quality_rules.measure(docs).collect():
            w, seen, dup = words(r.text), set(), 0
            for line in (r.text or "").split("\n"):
                if words(line):
                    dup += line in seen
                    seen.add(line)
            assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), dup)
            assert r.n_symbols == sum(c in "#*$%&|<>" for c in r.text or "")
            assert r.n_repeat_words == repeat_words(w)
            assert r.base_failed == (len(w) < 20 or 100 * r.n_repeat_words > 30 * len(w))
            assert isinstance(r.kept, bool) and not (r.kept and r.base_failed)


def test_rules_lines(spark):
    good = "It was a long day, and nobody in the house had said a word about it until then."
    bad = ["Home | News | Sport | Contact", "WIN A PRIZE NOW TODAY!!", "a*** b### c$$$ d%%%", "go go go go go go", "All rights reserved."]
    after = "By noon the rain had come over the hill, so we closed the shutters and lit a fire."
    rows = [(k, "\n".join([good, b, after])) for k, b in enumerate(bad)] + [(9, "\n".join(bad * 6))]
    got = {r.doc_id: r for r in quality_rules.measure(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert all(got[k].clean_text == f"{good}\n{after}" and got[k].kept for k in range(len(bad)))
    assert got[9].clean_text == "" and got[9].lost == 1 and not got[9].kept


def test_rules_empty_table(none):
    assert quality_rules.measure(none).count() == 0


def mixed_by_hand(rows):
    """Targets by the words of the contract: share by weight, cut at twice, share the excess again."""
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len(words(text))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        step = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s, x in step.items():
            target[s] += x
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return sizes, target


def test_mix_targets_and_sizes(odd, documents):
    for docs in (odd, documents):
        rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        sizes, target = mixed_by_hand(rows)
        got = mixing.mix(docs).collect()
        assert sorted((r.doc_id or 0, r.size) for r in got) == sorted((i or 0, len(words(t))) for i, t, _ in rows)
        taken = defaultdict(int)
        for r in got:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
            assert r.taken in (0, r.size, 2 * r.size) and r.taken == r.copies * r.size
            taken[r.source] += r.taken
        longest = {s: max(len(words(t)) for _, t, x in rows if x == s) for s in sizes}
        assert all(abs(taken[s] - target[s]) <= 2 * longest[s] + 1 for s in sizes)


def test_mix_reruns_agree_and_emits(odd, none):
    key = lambda df: sorted(map(str, df.select("doc_id", "taken", "target").collect()))
    mixed = mixing.mix(odd)
    assert key(mixed) == key(mixing.mix(odd.repartition(7, "n")))
    assert mixing.emitted(mixed).count() == mixed.agg({"copies": "sum"}).first()[0]
    assert mixing.mix(none).count() == 0


def by_brute_force(rows, width, percent):
    sets = []
    for i, text, *_ in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((i, frozenset(tuple(w[j : j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        least[find(k)].append(i)
    known = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return sorted(((i, len(s), known[find(k)]) for k, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (2, 60)])
def test_jaccard_equals_brute_force(spark, odd, width, percent):
    rng = random.Random(7)
    text = [rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(40)]
    rows = [r[:2] for r in odd_rows()]
    for k in range(60):  # a group around one text, with one to four words changed
        own = list(text)
        for _ in range(k % 5):
            own[rng.randrange(40)] = f"new{rng.randrange(60)}"
        rows.append((1000 + k, " ".join(own)))
    rows += [(2000 + k, " ".join(text[k : k + 6 + k % 3])) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = jaccard.join(docs, jaccard.JaccardRules(width, percent, combine_below=16 if width == 5 else 256))
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_brute_force(rows, width, percent)


def test_jaccard_frequent_shingles(spark, monkeypatch):
    """Every shingle that two sets share counts as frequent, so links go by combinations."""
    monkeypatch.setattr(jaccard, "FREQUENT", 1)
    rng = random.Random(2)
    text = [f"w{k}" for k in range(50)]
    rows = []
    for k in range(80):
        own = list(text)
        for _ in range(k % 4):
            own[rng.randrange(50)] = f"new{rng.randrange(30)}"
        rows.append((k, " ".join(own)))
    got = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_brute_force(rows, 4, 85)


def test_jaccard_empty_and_first_of_each(odd, none):
    assert jaccard.join(none).count() == 0
    kept = sorted(str(r.doc_id) for r in jaccard.first_of_each(odd).collect())
    assert {"1", "2", "3", "4", "7", "9", "None"} <= set(kept) and not {"5", "6", "8", "10"} & set(kept)
    assert kept.count("9") == 1


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (500, 500)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 102: 100, 500: 500}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_take_few_jobs(spark):
    """The driver holds what it plans and serves for each job; a task's own edges need no rounds. Small pieces agree."""
    rng = random.Random(3)
    path = list(range(300))
    rng.shuffle(path)
    edges = list(zip(path, path[1:], strict=False)) + [(rng.randrange(-900, 0), rng.randrange(-900, 0)) for _ in range(500)]
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        above[high] = low
    want = {x: root(x) for x in above}
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    spark.sparkContext.setJobGroup("components", "")
    got = {r.id: r.component for r in components(frame).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    spark.sparkContext.setJobGroup("rest", "")
    assert got == want and jobs <= 20
    pieces = components(frame.repartition(4), at_once=8)
    assert {r.id: r.component for r in pieces.collect()} == want


def test_bpe_equals_library(spark, odd, documents, none):
    ranks = bpe.read_ranks(spark, BPE_PATH)
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in (odd, documents):
        want = []
        for r in docs.collect():
            ids = whole.encode_ordinary(r.text or "")
            digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            want.append((r.doc_id, len(ids), digest, hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert sorted(map(str, (tuple(r) for r in bpe_digests(docs).collect()))) == sorted(map(str, want))
        lists = bpe.digests(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
        assert sorted(map(str, (tuple(r) for r in lists.collect()))) == sorted(map(str, want))
    encoded = bpe.encode(odd, ranks, public_tokenizers.PATTERN)
    back = sorted(bytes(r.decoded) for r in bpe.decode(encoded, ranks).collect())
    assert back == sorted((t or "").encode() for _, t, *_ in odd_rows())
    assert bpe.encode(none, ranks, public_tokenizers.PATTERN).count() == 0


def test_bpe_chunks(spark, documents, monkeypatch):
    """Small chunks give the same ids."""
    ranks = bpe.read_ranks(spark, BPE_PATH)
    ids = lambda: sorted(map(str, bpe.encode(documents, ranks, public_tokenizers.PATTERN).collect()))
    whole = ids()
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 20_000)
    assert ids() == whole


def greedy(word, first, rest):
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (rest if at else first)), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_automaton_equals_greedy_match():
    rng = random.Random(3)
    first, rest = [b"a", b"abcdx", b"b", b"c", b"cdy", b"dz"], [b"b", b"c", b"cdy", b"dz", b"bc"]
    some = ["".join(rng.choice("abcdxyz") for _ in range(rng.randrange(8))).encode() for _ in range(3000)]
    assert token_counts.Automaton(first, rest).counts(some).tolist() == [greedy(w, first, rest) for w in some]
    assert token_counts.Automaton([], []).counts([b"x", b""]).tolist() == [1, 0]


def test_token_counts(odd, none):
    pieces, end = token_counts.word_end_vocabulary(PIECES_PATH)
    known = set(pieces)
    got = token_counts.count_tokens(odd, pieces, end, out="n").collect()
    for r in got:
        if len(r.text or "") < 2000:
            assert r.n == sum(greedy(w.encode() + end, known, known) for w in (r.text or "").lower().split())
    assert token_counts.count_tokens(none, pieces, end).count() == 0


TOXIC = ["vile" + s for s in ("ab", "cd", "ef", "gh")] + ["scumbag", "dirtbag"]


def labelled(n=700):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(n):
        own = [rng.choice(["stone", "river", "tree", "of", "and", "the", "walk"]) + rng.choice(["", "s", "er"]) for _ in range(rng.randrange(10, 120))]
        bad = k % 3 == 0
        if bad:
            own.insert(rng.randrange(len(own)), rng.choice(TOXIC))
        rows.append((k, " ".join(own)))
        labels.append((k, int(k % 4 != 0), int(bad)))
    return rows, labels


def test_toxicity_held_out_and_odd_rows(spark, odd, none):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    held = [k for k, _ in rows if __import__("zlib").crc32(str(k).encode()) % 5 == 0]
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert sum((got[k] >= 0.5) == (k % 3 == 0) for k in held) >= 0.9 * len(held)
    scores = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert all(0 <= x <= 1 for x in scores.values()) and scores[1] == scores[2] == scores[3] == min(scores.values())
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit(docs, marks.limit(0)).scores(["x", None]).tolist() == [0.0, 0.0]


def test_toxicity_windows_cover_all_words():
    rules = toxicity.ToxicityRules(window=6, stride=4)
    for n in range(40):
        spans, _ = toxicity.windows_of([n], rules)
        assert {*spans.ravel().tolist()} - {-1} == set(range(n))


def test_toxicity_gradients():
    """Steps of learning follow the slope: a step lowers the loss on its own batch."""
    rules = toxicity.ToxicityRules(window=5, stride=5, rate=0.003)
    net = toxicity.Network(rules)
    slots = toxicity._slots(["one", "two", "three", "four"], rules)
    index, mask = np.array([[0, 1, 2, 3, 0], [1, 1, 2, 0, 0]]), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0]], np.float32)
    losses = [net.step(slots, index, mask, np.array([1, 0], np.float32), np.ones(2, np.float32)) for _ in range(60)]
    assert losses[-1] < 0.5 * losses[0]


def test_quality_trees(spark, odd, none):
    rng = np.random.default_rng(1)
    rows = rng.random((2000, 3))
    target = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.3)).astype(int)
    model = quality.boost(rows[:1500], target[:1500])
    assert ((model.scores(rows[1500:]) >= 0.5) == target[1500:]).mean() > 0.95
    assert model.scores(rows[:0]).tolist() == []

    def walk(t, row):  # one row, one tree at a time
        at = 0
        while at < model.feature.shape[1]:
            at = 2 * at + 1 + (row[model.feature[t, at]] > model.threshold[t, at])
        return model.leaf[t, at - model.feature.shape[1]]

    by_hand = [1 / (1 + np.exp(-(model.base + sum(walk(t, r) for t in range(len(model.leaf)))))) for r in rows[:20]]
    assert np.allclose(by_hand, model.scores(rows[:20]))
    texts, labels = labelled(200)
    fitted = quality.fit(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert all(0 <= r.score <= 1 for r in quality.score(odd, fitted).collect())
    assert quality.score(none, fitted).count() == 0
    assert quality.boost(rows[:0], target[:0]).scores(rows[:2]).tolist() == [0.5, 0.5]


def test_classifiers_on_held_out_documents(spark):
    """Over sf0.01: labels of the held-out fold."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = QUERIES["op2_quality_classifier"](spark, folder).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)


def test_lm_losses_by_hand(spark, odd, none):
    import math

    rows = [(1, "a b a b"), (2, "b c"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = lm.fit(docs, spark.createDataFrame([(1,), (None,), (1,)], "doc_id bigint"))
    got = {r.doc_id: r for r in lm.score(docs, model).collect()}

    def loss(corpus, text):
        flat, n = [w for t in corpus for w in t], len(corpus)
        pairs = Counter(p for t in corpus for p in zip(["<"] + t, t, strict=False))
        one, out = Counter(flat), 0.0
        for left, w in zip(["<"] + text, text, strict=False):
            context = n if left == "<" else one[left]
            out -= math.log(0.6 * pairs[left, w] / max(1, context) + 0.35 * one[w] / max(1, len(flat)) + 0.05 / (1 << 18))
        return out / len(text)

    a, b = "a b a b".split(), "b c".split()
    for k, text in ((1, a), (2, b)):
        assert got[k].target_loss == pytest.approx(loss([a], text), rel=1e-4)
        assert got[k].background_loss == pytest.approx(loss([a, b], text), rel=1e-4)
    assert got[1].difference < got[2].difference
    assert (got[3].n_tokens, got[3].difference, got[4].n_tokens) == (0, 0.0, 0)
    assert lm.score(odd, model).count() == len(odd_rows())
    assert lm.score(none, lm.fit(none, none)).count() == 0


def test_lm_counts_do_not_share_slots(spark):
    """More distinct words than a table of 2^18 slots holds: a pair that is in no target text gets no count of another."""
    import math

    n = 400_000
    words = [f"w{k}" for k in range(n)]
    rows = [(1, " ".join(words)), (2, " ".join(words[::-1])), (3, "w7 w3 w9 w1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in lm.score(docs, lm.fit(docs, spark.createDataFrame([(1,)], "doc_id bigint"))).collect()}
    even = 0.05 / (1 << 18)
    assert got[3].target_loss == pytest.approx(-math.log(0.35 / n + even), rel=1e-9)
    assert got[2].target_loss == pytest.approx(-math.log(0.35 / n + even), rel=1e-9)
    seen = -((n - 1) * math.log(0.6 + 0.35 / n + even) + math.log(0.6 + 0.35 / n + even)) / n
    assert got[1].target_loss == pytest.approx(seen, rel=1e-9)


def test_lm_grams_travel_once_or_twice(spark, odd, none):
    targets = spark.createDataFrame([(1,), (3,), (None,)], "doc_id bigint")
    docs = spark.createDataFrame([(1, "a b a"), (1, "b b"), (2, "a b a"), (None, "a c"), (4, None), (5, " ")], "doc_id bigint, text string")
    for rows in (docs, odd, none):
        two = lm.score(rows, lm.fit(rows, targets)).drop("text").collect()
        one = lm.fit_and_score(rows, targets).drop("text").collect()
        assert Counter(map(str, one)) == Counter(map(str, two))


def test_quality_keeps_class_shares_over_the_cap(spark):
    """Equal texts, three of four labelled 1: the score is their share, whether or not the cap takes as many of each class."""
    docs = spark.range(1000).selectExpr("id AS doc_id", "'the same few words' AS text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 4 > 0 AS int) AS quality")
    for rows in (8000, 100):
        model = quality.fit(docs, labels, quality.TreeRules(rows=rows))
        assert quality.score(docs.limit(1), model).first().score == pytest.approx(0.75, abs=0.03)


def test_toxicity_draws_its_hard_windows_from_all_clean_texts():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, 90)) + (" vile" if i % 4 == 0 else "") for i in range(80)]
    truth = [int(i % 4 == 0) for i in range(80)]
    model = toxicity.train(texts, truth, toxicity.ToxicityRules(hard_windows=5))
    again = toxicity.train(texts, truth, toxicity.ToxicityRules(hard_windows=5))
    scores = model.scores(texts)
    assert np.array_equal(scores, again.scores(texts))
    assert ((scores >= 0.5) == (np.array(truth) == 1)).mean() >= 0.9


def test_toxicity_finds_unseen_toxic_documents(spark):
    """Over sf0.1: labels of the held-out fold."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic IN (0, 1)")
    rows = QUERIES["op1_toxicity"](spark, folder).join(labels, "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.03 * len(clean)


@pytest.mark.parametrize(
    ("logits", "truth", "low", "high"),
    [([0, 1, 2, 3], [0, 0, 1, 1], 1, 2), ([0, 0, 0, 1], [0, 1, 1, 1], 0, 1), ([1, 1], [1, 1], 0, 1), ([1, 1], [0, 0], 1, 2)],
)
def test_toxicity_cut(logits, truth, low, high):
    """The cut lies between the classes, never between equal logits, and beyond all where there is one class."""
    assert low <= toxicity._cut(np.array(logits, float), np.array(truth), 2.0) <= high


def test_toxicity_is_learned_in_a_task_from_the_same_rows(spark, tmp_path):
    import resource

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.learning_rows(docs, labels, "toxic", 2500, 100_000).orderBy("doc_id", "text").toArrow()
    here = toxicity.train(rows.column("text").to_pylist(), rows.column("label").to_pylist())
    before = resource.getrusage(resource.RUSAGE_SELF).ru_utime
    there = toxicity.fit(docs, labels)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_utime - before < 3  # the driver does not learn
    assert there.shift == pytest.approx(here.shift, abs=1e-3)
    texts = rows.column("text").to_pylist()[:40] + [None, "", "one word"]
    assert there.scores(texts) == pytest.approx(here.scores(texts), abs=1e-3)
    assert toxicity.fit(docs, labels.where("false")).network is None
