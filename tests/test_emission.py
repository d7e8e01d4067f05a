import random

from pyspark.sql import functions as F

from maskweave.operators import emission as E
from maskweave.operators import leaks as L


def entries(spark, values):
    rows = [(v, v, f"⟨v1:{i:04x}⟩", i) for i, v in enumerate(values)]
    return E.patterns(spark.createDataFrame(rows, "value string, normalised string, token string, seq long"))


def naive(text, values):
    """Leftmost-longest replacement by trying every value at every place."""
    tokens, folded, out, at = {}, E.fold(text), [], 0
    for i, v in enumerate(values):
        tokens.setdefault(E.fold(v), f"⟨v1:{i:04x}⟩")
    while at < len(text):
        best = max((v for v in tokens if folded.startswith(v, at)), key=len, default=None)
        out.append(tokens[best] if best else text[at])
        at += len(best) if best else 1
    return "".join(out)


def test_both_ways_equal_a_plain_search(spark):
    rng = random.Random(11)
    letters = "abAB"
    values = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(4, 8))) for _ in range(12)})
    texts = ["".join(rng.choice(letters + " ") for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    texts += ["ab" * 700 + "abba " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    e = entries(spark, values)
    small = {r.i: r.t for r in E.replace_known(df, ["t"], e, small=True).collect()}
    large = {r.i: r.t for r in E.replace_known(df, ["t"], e, small=False).collect()}
    for i, t in enumerate(texts):
        assert small[i] == large[i] == naive(t, values)


def test_without_the_automaton_library(spark, monkeypatch):
    index = E.Index([("abcd", "X", False), ("cdefg", "Y", False), ("bcdefgh", "Z", False)])
    monkeypatch.setattr(E, "ahocorasick", None)
    plain = E.Index([("abcd", "X", False), ("cdefg", "Y", False), ("bcdefgh", "Z", False)])
    for text in ("ABCDefgh", "xbcdefghcdefg", "cdefgabcd"):
        assert index.replace(text) == plain.replace(text)


def test_short_foreign_and_folded_values(spark):
    values = ["Li", "名前", "İSTANBUL", "ΟΔΟΣ"]
    texts = [(0, " li "), (1, "Lima"), (2, "私の名前です"), (3, "in istanbul"), (4, "οδοσ ΟΔΟΣ"), (5, None), (6, "")]
    df = spark.createDataFrame(texts, "i int, t string")
    want = {0: "⟨v1:0000⟩", 1: "Lima", 2: "私の⟨v1:0001⟩です", 3: "in ⟨v1:0002⟩", 4: "⟨v1:0003⟩ ⟨v1:0003⟩", 5: None, 6: ""}
    for small in (True, False):
        got = {r.i: r.t for r in E.replace_known(df, ["t"], entries(spark, values), small=small).collect()}
        assert got == want


def test_own_tokens_are_left_alone(spark):
    values = ["redacted", "phone", "v1:0"]
    texts = [(0, "⟨redacted⟩ redacted"), (1, "⟨redacted:phone⟩"), (2, "⟨v1:0000⟩ v1:0"), (3, "⟨fake phone⟩")]
    df = spark.createDataFrame(texts, "i int, t string")
    a, b = ({r.i: r.t for r in E.replace_known(df, ["t"], entries(spark, values), small=s).collect()} for s in (True, False))
    assert a == b
    assert a[0] == "⟨redacted⟩ ⟨v1:0000⟩"
    assert a[1] == "⟨⟨v1:0000⟩:⟨v1:0001⟩⟩"
    assert a[2] == "⟨v1:0000⟩ ⟨v1:0002⟩"
    assert a[3] == "⟨fake ⟨v1:0001⟩⟩"


def test_leaks(spark):
    truth = spark.createDataFrame([("n", "12.5"), ("n", "77"), ("name", "Ann"), ("name", "Bob"), ("name", None), ("name", "")], "kind string, value string")
    out = spark.createDataFrame([("x12.5y ann", 1), ("(77)", 2), ("a77", 3), (None, 4)], "t string, k int")
    want = {("n", "77"), ("name", "ann")}
    assert {tuple(r) for r in L.leaked_values([out], truth).collect()} == want
    assert {tuple(r) for r in L.leak_counts([out.select(F.lit("").alias("t"))], truth).collect()} == {("n", 0), ("name", 0)}
    assert L.leaked_values([out], truth.limit(0)).count() == 0


def test_leaks_equal_a_plain_search(spark):
    rng = random.Random(3)
    values = sorted({"".join(rng.choice("12.") for _ in range(rng.randrange(1, 6))) for _ in range(40)} | {"ΟΔΟΣ 1", "名前", "x" * 90})
    texts = ["".join(rng.choice("12.a (é") for _ in range(rng.randrange(0, 60))) for _ in range(150)] + ["οδοσ 12 私の名前", "y" + "X" * 95, "2" * 9, ".1"]
    truth = spark.createDataFrame([("v", v) for v in values], "kind string, value string")
    out = spark.createDataFrame([(t, [t]) for t in texts], "t string, `a b` array<string>")

    def shows(v, low):
        at = low.find(v)
        while at >= 0:
            edges = low[at - 1 : at] + low[at + len(v) : at + len(v) + 1]
            if not (set(v) <= set(".0123456789")) or not (set(edges) & set(".0123456789abcdefghijklmnopqrstuvwxyz")):
                return True
            at = low.find(v, at + 1)
        return False

    want = {E.fold(v) for v in values if any(shows(E.fold(v), E.fold(t)) for t in texts)}
    assert {r.value for r in L.leaked_values([out], truth).collect()} == want




def test_texts_side_by_side_are_told_apart(spark):
    """Many texts in one array: no gram reaches over, a text that repeats gives its places once."""
    texts = ["abcd", "efgh", "", "xabcdefghx" * 30, "abc", "dabcdefgh"] * 3
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)
    known = ["abcdefgh", "abcd", "efghx"]
    want = [(i, m, m + len(v)) for i, t in enumerate(texts) for v in known for m in range(len(t)) if t.startswith(v, m)]
    got = E.window_hits(rows, entries(spark, known)).collect()
    assert sorted((r.id, r.start, r.end) for r in got) == sorted(want)
    hits = E.window_hits(rows.withColumn("id", F.col("id") % 6), entries(spark, known), repeated=True).collect()
    assert sorted((r.id, r.start, r.end) for r in hits) == sorted(w for w in want if w[0] < 6)


def test_short_texts_are_searched_together():
    batches = [E.pa.RecordBatch.from_arrays([E.pa.array(list("abc") * 1000), E.pa.array(["one", "two", "three"] * 1000)], names=["id", "text"])]
    assert [len(b.rows) for b in E._blocks(iter(batches))] == [3000]
    assert [len(b.rows) for b in E._blocks(iter(batches), repeated=True)] == [3]


def test_pieces_of_a_long_text_lose_no_place(monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 64)
    texts = ["ab", "abcdefghij" * 40, "", "xyzabcdefgh", "c" * 64]
    batches = [E.pa.RecordBatch.from_arrays([E.pa.array(texts)], names=["text"])]
    every = E.np.full(1 << 15, 255, E.np.uint8)
    for q in E.GRAMS:
        got = []
        for b in E._blocks(iter(batches)):
            grams, pieces, places = b.passing(q, every, 18)
            got += [(b.rows[p], b.starts[p] + at, g) for g, p, at in zip(grams.tolist(), pieces.tolist(), places.tolist())]
        want = [(k, at, g) for k, t in enumerate(texts) for at, g in enumerate(E._grams(E._points(t), q).tolist())]
        assert sorted(got) == sorted(want)


def test_a_large_dictionary_is_not_held_by_every_worker(spark, monkeypatch):
    some = spark.range(40).selectExpr("concat('customer#', id) AS pattern", "concat('t', id) AS token", "false AS short")
    assert E.fits_dictionary(some)
    monkeypatch.setattr(E, "DICTIONARY_ROWS", 39)
    assert not E.fits_dictionary(some)
    assert E.DICTIONARY_BYTES <= 16 << 20


def test_the_gate_lets_few_other_places_through(spark):
    rng = random.Random(5)
    digits = ["".join(rng.choice("0123456789") for _ in range(12)) for _ in range(2000)]
    texts = spark.createDataFrame([(i, "".join(rng.choice("0123456789") for _ in range(5000))) for i in range(40)], "id int, text string")
    known = entries(spark, digits)
    *_, bits, shared = E._rarest_keys(texts.select("text"), known)
    rows = E.pa.RecordBatch.from_arrays([E.pa.array([r.text for r in texts.collect()])], names=["text"])
    through = sum(len(b.passing(8, shared.value, bits)[0]) for b in E._blocks(iter([rows])))
    assert through < 0.003 * 40 * 5000
    found = E.window_hits(texts.unionByName(texts.limit(0)), entries(spark, [*digits[:5], rows.column("text")[3].as_py()[70:82]]))
    assert (3, 70) in [(r.id, r.start) for r in found.collect()]


def test_grams_are_counted_inside_texts_only():
    texts = ["abab", "", "ab", "a", "xyzzy", "名ab"] * 3
    for b in E._blocks(iter([E.pa.RecordBatch.from_arrays([E.pa.array(texts)], names=["text"])])):
        for q in E.GRAMS:
            want = E.np.zeros(1 << E.CLASS_BITS, int)
            for t in texts:
                for g in E._grams(E._points(t), q).tolist():
                    want[g >> (64 - E.CLASS_BITS)] += 1
            assert (b.counted(q) == want).all()


def test_places_near_the_cut_of_a_long_text(spark):
    values = ["abcdefgh12", "12.5", "é9"]
    text = "x" * (E.BLOCK - 5) + "ABCDEFGH12 12.5 " + "名" * (E.BLOCK - 20) + "(12.5) É9"
    rows = spark.createDataFrame([(1, "abcdefgh 1212.5"), (2, text), (3, "é9")], "id int, text string").coalesce(1)
    known = spark.createDataFrame([(v, v, False) for v in values], "pattern string, token string, short boolean")
    want = {(i, m) for i, t in ((1, "abcdefgh 1212.5"), (2, text.lower()), (3, "é9")) for v in values for m in range(len(t)) if t.startswith(v, m)}
    assert {(r.id, r.start) for r in E.window_hits(rows, known).collect()} == want
    around = {(r.token, r.folded[max(0, r.start - 1) : r.end + 1]) for r in E.surroundings(rows, known).collect()}
    assert around == {("abcdefgh12", "xabcdefgh12 "), ("12.5", " 12.5 "), ("12.5", "(12.5)"), ("12.5", "212.5"), ("é9", " é9"), ("é9", "é9")}


def test_texts_are_not_shuffled_for_few_answers(spark, monkeypatch):
    """Both joins of texts, by their places and with their answers, send the small side; a large one is left to a shuffle."""
    rows = [(i, f"text {i % 50} with {'anna.smith' if i % 5 == 0 else 'nobody'} in it") for i in range(400)] + [(400, None), (401, "li")]
    df = spark.createDataFrame(rows, "i int, t string")
    known = entries(spark, ["anna.smith", "Li"])
    sent = E.replace_known(df, ["t"], known, counts=True, small=False)
    plan = sent._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    want = {(i, t and t.replace("anna.smith", "⟨v1:0000⟩").replace("li", "⟨v1:0001⟩"), int(bool(t) and ("anna" in t or t == "li"))) for i, t in rows}
    assert {tuple(r) for r in sent.collect()} == want
    monkeypatch.setattr(E, "fits_broadcast", lambda *_, **__: False)
    shuffled = E.replace_known(df, ["t"], known, counts=True, small=False)
    assert "strategy=broadcast" not in shuffled._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in shuffled.collect()} == want
