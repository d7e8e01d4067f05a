import hashlib
import hmac
import unicodedata

from pyspark.sql import functions as F

from maskweave.functions import tokens as K
from maskweave.operators import bindings as B
from maskweave.operators.masking import ColumnPolicy, Masking, mask

KEY = b"a key for tests"


def table(spark, *sessions):
    return K.key_table(spark, [r for s in sessions for r in K.key_rows("c", s, {1: KEY})])


def expected(session, namespace, value):
    key = K.session_key(KEY, session)
    return f"⟨{namespace}1:{hmac.new(key, (namespace + value).encode(), hashlib.sha256).hexdigest()[:16]}⟩"


def test_token_is_hmac_of_normalised_value(spark):
    values = ["Jane", " jane ", "Amélie\t", " 名前", "ÀÉ", ""]
    key = K.current_key(table(spark, "s"), "c", "s")
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(K.token(key, "person", K.normalise(F.col("v")))).collect()]
    assert got == [expected("s", "person", unicodedata.normalize("NFC", v).strip()) for v in values]


def test_key_bytes_are_not_in_the_plan(spark):
    key = K.current_key(table(spark, "s"), "c", "s")
    df = spark.range(3).select(K.token(key, "id", F.col("id").cast("string")).alias("t"))
    df.collect()
    plan = df._jdf.queryExecution().toString() + df._jdf.queryExecution().logical().toJSON()
    ipad, opad = K.key_pads(K.session_key(KEY, "s"))
    for secret in (KEY.decode(), ipad.hex(), opad.hex(), ipad.hex().upper(), str(list(ipad))[1:-1]):
        assert secret not in plan


def test_long_keys_are_hashed_first():
    long = b"k" * 100
    ipad, opad = K.key_pads(long)
    inner = hashlib.sha256(ipad + b"message").digest()
    assert hashlib.sha256(opad + inner).hexdigest() == hmac.new(long, b"message", hashlib.sha256).hexdigest()


def test_parse_is_strict(spark):
    good, bad = "⟨email12:aF0⟩", ["email1:af", "⟨email:af⟩", "⟨1:af⟩", "⟨email1:⟩", "⟨email1:xy⟩", "⟨email1:af⟩ ", "⟨e1:a:b⟩", "⟨email99999999999999999999:af⟩"]
    rows = spark.createDataFrame([(t,) for t in [good, *bad]], "t string").select(K.parse_token(F.col("t")).alias("p")).collect()
    assert tuple(rows[0].p) == ("email", 12, "aF0")
    assert all(r.p is None for r in rows[1:])


def test_first_binding_stands_and_use_extends_it(spark):
    rows = [("s", "c", "n", "b", 2), ("s", "c", "n", "a", 1), ("s", "c", "n", "a", 5), ("t", "c", "n", "a", 1), ("s", "", "n", "x", 1), ("s", "c", "n1", "x", 1)]
    inputs = spark.createDataFrame(rows, "session string, conn string, namespace string, value string, seq long")
    now = F.lit("2026-01-01").cast("timestamp")
    minted = B.mint(inputs, table(spark, "s", "t"), now)
    assert minted.count() == 6
    minted = minted.where("token IS NOT NULL")  # the other two are shown as the marker
    assert minted.count() == 4
    clash = minted.withColumn("token", F.lit("⟨n1:00⟩"))
    bound = {r.session: (r.value, r.losers) for r in B.bind(clash).collect()}
    assert bound == {"s": ("a", 1), "t": ("a", 0)}
    shown = {(r.session, r.value): r.shown for r in B.tokens_or_redacted(clash, B.bind(clash)).collect()}
    assert shown == {("s", "a"): "⟨n1:00⟩", ("s", "b"): "⟨redacted⟩", ("t", "a"): "⟨n1:00⟩"}


def test_null_stays_null_and_no_key_masks(spark):
    df = spark.createDataFrame([("a", 1), (None, None)], "t string, n int")
    out = mask(df, Masking({"t": ColumnPolicy("token", "x"), "n": ColumnPolicy("redact")})).collect()
    assert [tuple(r) for r in out] == [("⟨redacted⟩", "⟨redacted⟩"), (None, None)]


def test_json_and_column_tokens_agree(spark):
    from maskweave.operators.jsonpaths import mask_paths

    key = K.current_key(table(spark, "s"), "c", "s")
    df = spark.createDataFrame([('{"a": "Jane"}',)], "d string")
    got = df.select(mask_paths(F.col("d"), {"$.a": ("token", "person")}, key)).first()[0]
    assert got == '{"a":"' + expected("s", "person", "Jane") + '"}'
