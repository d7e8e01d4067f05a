from maskweave.operators import triage


def test_known_names_by_table_and_by_join(spark, capsys):
    odd = ["a\x00b", "\x01a", "\x01\x00", "", "x\\0"]
    columns = spark.createDataFrame([("s", "t", c) for c in odd] + [("s", "u", "k"), ("s", "u", None)], "schema string, relation string, column string")
    used = [(1, "s", "t"), (1, "s", "u"), (1, "s", "u"), (2, "s", "u"), (3, "s", "gone\x00"), (4, "s", None)]
    used = spark.createDataFrame(used, "id bigint, schema string, relation string")
    want = {1: sorted([*odd, "t", "u", "k"]), 2: ["k", "u"], 3: ["gone\x00"], 4: []}
    for small in (True, False, None):
        out = triage.known_names(used, columns, small=small)
        assert {r["id"]: r["known"] for r in out.collect()} == want
    # Names are shuffled once for each relation, never for each statement.
    capsys.readouterr()
    triage.known_names(used.union(used), columns.union(columns)).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning(id") == 1
