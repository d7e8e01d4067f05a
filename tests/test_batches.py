import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from maskweave.functions import detect as D
from maskweave.functions.batches import answered
from maskweave.operators import emission as E


def test_answers_keep_their_places_and_repeats_are_asked_once():
    asked = []
    texts = ["a", None, "b", "a", "", None, "é" * 5]
    got = answered(pa.array(texts), lambda t: asked.append(t) or (None if t is None else {"n": len(t)}), pa.struct([("n", pa.int32())]))
    assert got.to_pylist() == [None if t is None else {"n": len(t)} for t in texts] and asked == ["a", None, "b", "", "é" * 5]
    assert answered(pa.array([], pa.string()), len, pa.int32()).to_pylist() == []


def test_a_batch_is_never_held_as_python_objects():
    texts = pa.array([f"{i} " + "x" * 100_000 for i in range(400)])  # 40 MB
    tracemalloc.start()
    answered(texts, lambda t: t.upper(), pa.string())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000


def test_replacing_and_finding_keep_nulls_and_many_rows(spark):
    bound = spark.createDataFrame([("ann@x.example", "ann@x.example", "⟨email1:aa⟩", 1)], "value string, normalised string, token string, seq int")
    texts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit("to ann@x.example")).otherwise(F.col("id").cast("string")).alias("t"))
    entries = E.patterns(bound)
    out = E.replace_known(texts.coalesce(1), ["t"], entries, counts=True, small=True)
    wrong = out.join(texts.withColumnRenamed("t", "was"), "id").where(
        ~F.when(F.col("id") % 3 == 0, F.col("t").isNull() & (F.col("t_hits") == 0))
        .when(F.col("id") % 3 == 1, (F.col("t") == "to ⟨email1:aa⟩") & (F.col("t_hits") == 1)).otherwise((F.col("t") == F.col("was")) & (F.col("t_hits") == 0))
    )
    assert wrong.count() == 0
    spans = texts.select(D.custom_detector(lambda t: [(0, 2, "two", 1.0)] if t[0] == "t" else None)(F.col("t")).alias("s"), "t")
    assert spans.where((F.col("t") == "to ann@x.example") & (F.col("s")[0]["end"] == 2)).count() == spans.where("s is not null").count() == 1000
