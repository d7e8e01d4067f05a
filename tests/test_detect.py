import random

from pyspark.sql import functions as F

from maskweave.functions import detect as D
from maskweave.operators.masking import ColumnPolicy, Masking, mask, transforms

TEXTS = [
    "mail a.b@example.com, card 4532-0151-1283-0366, bad 4532015112830367",
    "é10.0.0.1é 123-45-6789 +1 (555) 123-4567 DE89370400440532013000 DE88370400440532013000",
    "x@y.z.example.org@example.com 1.2.3.4.5 256.1.1.1 ⟨redacted⟩",
    "",
    "nothing here",
]


def spans_of(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    out = df.select("i", D.spans(F.col("t")).alias("s"), D.redact_spans(F.col("t"), D.spans(F.col("t"))).alias("m"))
    return [(r.s, r.m) for r in out.orderBy("i").collect()]


def test_native_spans_equal_the_text_form(spark):
    for text, (spans, masked) in zip(TEXTS, spans_of(spark, TEXTS)):
        assert masked == D.redact_text(text)
        assert all(0 <= s.start < s.end <= len(text) for s in spans)
    kinds = [s.type for spans, _ in spans_of(spark, TEXTS[:2]) for s in spans]
    assert kinds == ["email_address", "credit_card", "ip_address", "us_ssn", "phone_number", "iban"]


def test_merge_against_a_plain_loop(spark):
    rng = random.Random(7)
    cases = [[(a := rng.randrange(40), a + rng.randrange(1, 9), rng.choice("abc"), 1.0) for _ in range(rng.randrange(6))] for _ in range(300)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, s {D.SPANS_TYPE}")
    got = {r.i: [(s.start, s.end, s.type) for s in r.m] for r in df.select("i", D.merge_spans(F.col("s")).alias("m")).collect()}
    for i, case in enumerate(cases):
        want = []
        for start, end, kind, _ in sorted(case):
            if want and start < want[-1][1]:
                want[-1] = (want[-1][0], max(want[-1][1], end), want[-1][2])
            else:
                want.append((start, end, kind))
        assert got[i] == want


def test_unexamined_text_is_masked_whole(spark):
    df = spark.createDataFrame([("abc",), ("boom",), ("none",), (None,)], "t string")

    def find(text):
        if text == "boom":
            raise RuntimeError("recogniser failed")
        return None if text == "none" else [(0, 1, "letter", 1.0)]

    got = [r[0] for r in df.select(D.redact_spans(F.col("t"), D.custom_detector(find)(F.col("t")))).collect()]
    assert got == ["⟨redacted:letter⟩bc", "⟨redacted⟩", "⟨redacted⟩", None]
    settings = Masking({"t": ColumnPolicy("scan")}, detector=None)
    assert [r[0] for r in mask(df, settings).collect()] == ["⟨redacted⟩"] * 3 + [None]
    report = transforms(df, settings).first()
    assert (report.basis, report.spans) == ("unexamined", 0)


def test_bad_spans_mask_the_cell(spark):
    bad = [[(0, 9, "x", 1.0)], [(2, 2, "x", 1.0)], [(0, 2, "x", 1.0), (1, 3, "y", 1.0)], [(-1, 2, "x", 1.0)]]
    df = spark.createDataFrame([("abc", b) for b in bad], f"t string, s {D.SPANS_TYPE}")
    assert {r[0] for r in df.select(D.redact_spans(F.col("t"), F.col("s"))).collect()} == {"⟨redacted⟩"}


def test_a_look_at_the_first_character_and_for_a_digit_loses_no_match(spark):
    rng = random.Random(23)
    parts = ["4532-0151-1283-0366", "4532015112830366", "10.0.0.1", "123-45-6789", "(555) 123-4567", "+1 555.123.4567", "a@b.co", "DE89370400440532013000", "é", "_", " ", "1", "x", "", "-", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(8))) for _ in range(400)] + TEXTS
    for e in (e for e in D.ENTITIES if e is not D.EMAIL):
        plain = f"{D._BEFORE}(?:{e.pattern}){D._AFTER}" if e.word else e.pattern
        assert e.java.startswith("(?=[") and [e.matches(t) for t in texts] == [[m.span() for m in D.re.finditer(plain, t)] for t in texts]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    each = F.array(*(F.regexp_extract_all("t", F.lit(e.java), F.lit(0)) for e in D.ENTITIES))
    kept = F.array(*(D.matched(F.col("t"), e) for e in D.ENTITIES))
    for t, all_values, found, by_kind in df.select("t", D.values(F.col("t"), "kind"), each, kept).collect():
        if t is None:
            assert all_values is None and found == by_kind == [None] * len(D.ENTITIES)
        else:
            assert [(v.kind, v.value) for v in all_values] == [(e.name, m) for e, ms in zip(D.ENTITIES, by_kind) for m in ms]
            assert all(b == f for e, f, b in zip(D.ENTITIES, found, by_kind) if not e.valid)
