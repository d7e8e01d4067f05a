"""Known values in every text of a masked result, and what the report says of nested texts."""

import json
import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskweave.functions.nested import leaves, map_strings
from maskweave.functions.tokens import REDACTED
from maskweave.operators import emission as E
from maskweave.operators import masking as M
from maskweave.operators import results as R
from maskweave.operators.emission import patterns
from maskweave.registry.base import key
from maskweave.session import shared_folder

SCHEMA = (
    "name string, n bigint, note string, tags array<string>, m map<string, array<string>>, "
    "s struct<t: string, k: int, b: binary, deep: array<struct<x: string>>>, doc string"
)
ROWS = [
    ("Ada Lovelace", 1815, "met ADA LOVELACE, id 1815", ["x", "by ada lovelace", None], {"Ada Lovelace": ["q", "Ada Lovelace!"]},
     ("Grace Hopper", 7, b"Ada Lovelace", [("Ada Lovelace",), (None,)]), '{"b": [1.50, "Ada Lovelace"], "Ada Lovelace": 1815, "a": null}'),
    ("Grace Hopper", 2, "Bob", [], {}, None, '"Ada Lovelace"'),
    (None, None, None, None, None, (None, None, None, None), None),
    ("Grace Hopper", 2, "Bob", [], {}, None, "{not json Ada Lovelace"),
]
ALLOWED = {c: M.ColumnPolicy("allow") for c in ("n", "note", "tags", "m", "s", "doc")}


@pytest.fixture(scope="module")
def result(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    settings = M.Masking(ALLOWED | {"name": M.ColumnPolicy("token", "person")}, key=key(spark))
    token = M.mask_column(F.col("name"), T.StringType(), settings.policies["name"], settings)
    tokens = {r.name: r.t for r in df.select("name", token.alias("t")).collect()}
    return df, settings, tokens["Ada Lovelace"], tokens["Grace Hopper"]


def test_a_value_tokenised_in_one_column_is_caught_in_all_others(result):
    df, settings, ada, grace = result
    got = R.apply_result(df, settings, json=frozenset({"doc"}), counts=True).orderBy(F.desc("n"), "doc").collect()
    first = got[0]
    assert (first.name, first.n, first.note) == (ada, 1815, f"met {ada}, id 1815")
    assert (first.tags, first.m) == (["x", f"by {ada}", None], {ada: ["q", f"{ada}!"]})
    assert (first.s.t, first.s.k, bytes(first.s.b).decode(), [d.x for d in first.s.deep]) == (grace, 7, ada, [ada, None])
    assert first.doc == f'{{"b":[1.50,"{ada}"],"{ada}":1815,"a":null}}' and json.loads(first.doc)["b"][1] == ada
    assert [first[f"{c}_hits"] for c in ("name", "note", "tags", "m", "s", "doc")] == [0, 1, 1, 2, 3, 2]
    assert sorted(r.doc for r in got if r.doc)[:2] == sorted([f'"{ada}"', first.doc])
    assert [r.doc for r in got if r.n == 2 and "not" in r.doc] == [f"{{not json {ada}"]
    none = [r for r in got if r.n is None][0]
    assert none.asDict(True) | {"s": 0} == dict.fromkeys(SCHEMA_COLUMNS) | {"s": 0} | {f"{c}_hits": 0 for c in ("name", "note", "tags", "m", "s", "doc")}


SCHEMA_COLUMNS = ["name", "n", "note", "tags", "m", "s", "doc"]


def test_both_searches_agree(result):
    df, settings, *_ = result
    masked, entries = M.mask(df, settings), patterns(R.own_bindings(df, settings))
    rows = [sorted(map(str, R.replace_in_leaves(masked, entries, frozenset({"doc"}), True, small).collect())) for small in (True, False)]
    assert rows[0] == rows[1]


def test_both_searches_agree_on_odd_texts_and_types(spark):
    """Own tokens, markers, look-alikes, values of a whole cell, rows without texts; cells that Arrow carries and one that it does not."""
    values = ["ada lovelace", "lovelace", "a b", "no", "ab", "email", "id", "person1", "İstanbul", "é", "xy z", "ſs"]
    bound = spark.createDataFrame([(v, v.strip(), f"⟨person1:{i:04x}⟩", i) for i, v in enumerate(values)], "value string, normalised string, token string, seq bigint")
    entries = patterns(bound)
    words = [*values, "⟨person1:0001⟩", "⟨person1:00ff⟩", "⟨redacted⟩", "⟨redacted:email⟩", "⟨redacted:id⟩", "⟨redacted:phone⟩", "⟨", "⟩", " ", "A B", "NO ", "\u2003Ab", "İSTANBUL", "é", ""]
    r = random.Random(7)
    texts = [r.choice(("", " ", "x")).join(r.choices(words, k=r.randint(0, 4))) for _ in range(600)] + ["y" * 70_000 + "ada lovelace", None]
    rows = [(i, t, [t, None, texts[i // 2]], {"k": t}, json.dumps({"p": t, t or "": [1.5]})) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (-1, None, None, None, None)], "n bigint, t string, a array<string>, m map<string, string>, j string")
    df = df.selectExpr("*", "cast(n / 7 as decimal(38, 9)) d", "timestamp_seconds(n) at", "timestamp_ntz '2020-01-01 00:00:01' ntz", "date '1500-02-03' day", "float('nan') f", "make_dt_interval(1, 2, 3, 4.5) dt", "null v", "array(named_struct('b', cast(t as binary), 'z', null)) deep")
    odd = df.selectExpr("*", "make_ym_interval(1, cast(n as int)) ym", "named_struct('x', t, 'i', make_ym_interval(2, 3)) s")
    json_columns = frozenset({"j"})
    for given in (df, odd, df.where("n < 0"), df.limit(0)):
        shown = [R.replace_in_leaves(given, entries, json_columns, True, small) for small in (True, False)]
        assert shown[0].drop("v").dtypes == shown[1].drop("v").dtypes
        got = [sorted(r[0] for r in x.select(F.to_json(F.struct("*"))).collect()) for x in shown]
        assert got[0] == got[1] and len(got[0]) == given.count()


def test_texts_are_neither_numbered_nor_shuffled(spark):
    """Rows lie in the checkpoint folder once and compressed, or not at all; before, they and each place did as they are."""
    pad = F.concat_ws(" ", *(F.concat(F.lit("Customer#"), F.lpad(((F.col("id") * 7 + i) % 5000).cast("string"), 9, "0")) for i in range(8)))
    df = spark.range(0, 4000, 1, 3).select("id", pad.alias("t"), F.array(pad, pad).alias("a"))
    known = spark.range(3000).select(F.format_string("customer#%09d", "id").alias("pattern"), F.format_string("⟨person1:%016x⟩", "id").alias("token"), F.col("id").alias("seq"), F.lit(False).alias("short"))
    plain = df.select(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]

    def lies():
        return sum(p.stat().st_size for p in Path(shared_folder(spark).removeprefix("file:")).rglob("*") if p.is_file())

    got = []
    for small, most in ((True, 0), (False, 0.4 * plain)):
        before = lies()
        out = R.replace_in_leaves(df, known, counts=True, small=small)
        got.append(sorted(map(str, out.collect())))
        assert lies() - before <= most
        assert small is False or "Exchange" not in out._jdf.queryExecution().toString()
    assert got[0] == got[1] and "a_hits=" in got[0][0]


def test_chunks_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(E, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(E, "CHUNK_STEP", 3)
    rows = pa.RecordBatch.from_pydict({"n": range(1000), "t": [["x" * (n % 50), None] for n in range(1000)], "long": ["y" * (5000 if n == 7 else 1) for n in range(1000)]})
    packed = list(E._packed(iter([rows, rows.slice(0, 0), rows.slice(10, 5)])))
    parts = [E._unpacked(p, 0) for p in packed]
    assert pa.Table.from_batches(parts).to_pylist() == [*rows.to_pylist(), *rows.slice(10, 5).to_pylist()]
    assert len(parts) > 10 and all(p.nbytes <= 4000 or p.num_rows == 1 for p in parts)


def test_earlier_bindings_and_nothing_to_find(spark, result):
    df, settings, ada, _ = result
    before = spark.createDataFrame([("Bob the builder", "bob the builder", "⟨person1:00⟩", 5)], "value string, normalised string, token string, seq bigint")
    plain = M.Masking(ALLOWED | {"name": M.ColumnPolicy("allow")})
    other = spark.createDataFrame([("Bob the Builder",), (None,)], "note string")
    assert sorted(map(str, R.apply_result(other, plain, before).collect())) == ["Row(note='⟨person1:00⟩')", "Row(note=None)"]
    assert sorted(map(str, R.apply_result(df, plain).collect())) == sorted(map(str, df.collect()))
    assert R.apply_result(df.limit(0), settings).count() == 0
    assert R.apply_result(spark.range(3).select("id"), M.Masking({"id": M.ColumnPolicy("allow")}), before).count() == 3


def test_report_counts_nested_spans(spark):
    mail = "a@b.example and c@d.example"
    df = spark.createDataFrame(
        [(mail, [mail, None, "x"], {mail: "e@f.example"}, json.dumps({"p": mail, "q": [mail], "r": mail}))] * 3,
        "t string, a array<string>, m map<string, string>, j string",
    )
    scan = M.ColumnPolicy("scan")
    paths = M.ColumnPolicy("scan", paths={"$.p": ("scan", ""), "$.q[*]": ("scan", ""), "$.r": ("redact", "")})
    settings = M.Masking({"t": scan, "a": scan, "m": scan, "j": paths})
    report = {r.name: (r.spans, r.basis) for r in M.transforms(df, settings).collect()}
    assert {k: v[0] for k, v in report.items()} == {"t": 6, "a": 6, "m": 9, "j": 12}
    off = M.Masking(settings.policies, detector=None)
    assert {r.name: r.basis for r in M.transforms(df, off).collect()}["a"] == "unexamined"
    assert [r.layer for r in M.degradations(M.transforms(df.select("a"), M.Masking({"a": scan}, detector=None))).collect()] == ["detector"]


def test_map_keys_are_never_lost(spark):
    hide = lambda s: F.lit(REDACTED)
    rows = [({"a": 1, "b": 2, "⟨redacted:2⟩": 3, "⟨redacted:9⟩": 4},)]
    df = spark.createDataFrame(rows, "m map<string, int>")
    keep = lambda s: F.when(s.startswith("⟨"), s).otherwise(F.lit(REDACTED))
    got = df.select(map_strings(F.col("m"), df.schema["m"].dataType, keep).alias("m")).first().m
    assert sorted(got.values()) == [1, 2, 3, 4] and got[REDACTED] == 1 and got["⟨redacted:2⟩"] == 3
    for kind in ("struct<x: string, y: int>", "array<string>", "binary"):
        make = {"s": "map(named_struct('x','a','y',1), 1, named_struct('x','b','y',1), 2)", "a": "map(array('a'), 1, array('b'), 2, array('c','d'), 3)", "b": "map(cast('a' as binary), 1, cast('b' as binary), 2)"}[kind[0]]
        keyed = spark.range(1).select(F.expr(make).alias("m"))
        out = keyed.select(F.map_values(map_strings(F.col("m"), keyed.schema["m"].dataType, hide)).alias("v")).first().v
        assert sorted(out) == list(range(1, len(out) + 1)) and len(out) >= 2


def test_leaves(spark):
    df = spark.createDataFrame(ROWS[:1], SCHEMA)
    got = df.select(leaves(F.struct("*"), df.schema).alias("x")).first().x
    assert len(got) == 11 and None not in got
