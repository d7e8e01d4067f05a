import random
from datetime import datetime, timedelta

from maskweave.streaming import streams as S
from maskweave.streaming.latest import LatestLog

START = datetime(2026, 1, 1)


def event(session, token, kind, value, minute):
    return (session, token, kind, "n", value, None if minute is None else START + timedelta(minutes=minute))


def frame(spark, rows):
    return spark.createDataFrame(rows, S.EVENTS_SCHEMA).coalesce(1)


def test_bindings_live_on_use_and_end_with_the_session(spark, tmp_path):
    batches = [
        [event("a", "t1", "bind", "x", 0), event("a", "t1", "bind", "y", 1), event("b", "t1", "bind", "z", 1)],
        [event("a", "t1", "resolve", None, 30), event("a", "t9", "resolve", None, 30)],
        [event("a", "t1", "resolve", None, 80), event("b", "t1", "resolve", None, 80)],
        [event("a", None, "close", None, 81)],
        [event("a", "t1", "resolve", None, 82), event("a", "t2", "bind", "q", 82)],
    ]
    for rows in batches:
        frame(spark, rows).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(S.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    log = S.SessionLog(spark, str(tmp_path / "log"), fan=2)
    log.start(stream).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.session, r.token, r.kind, r.at): (r.status, r.value) for r in log.outcomes().collect()}
    at = lambda m: START + timedelta(minutes=m)
    assert got[("a", "t1", "bind", at(0))] == ("bound", None)
    assert got[("a", "t1", "bind", at(1))] == ("collision", None)
    assert got[("a", "t1", "resolve", at(30))] == ("ok", "x")
    assert got[("a", "t9", "resolve", at(30))] == ("stale_token", None)
    assert got[("a", "t1", "resolve", at(80))] == ("ok", "x")
    assert got[("b", "t1", "resolve", at(80))] == ("stale_token", None)
    assert got[("a", "t1", "resolve", at(82))] == ("session_closed", None)
    assert got[("a", "t2", "bind", at(82))] == ("session_closed", None)


def by_hand(batches, ttl):
    """The same outcomes from a plain loop."""
    held, out = {}, []
    for batch in batches:
        for s, t, kind, ns, v, at in sorted(batch, key=lambda e: (e[5], e[2], e[4] is not None, e[4] or "")):
            mine = held.get((s, t))
            alive = mine is not None and mine[2] > at
            if kind == "resolve":
                status, shown = ("ok", mine[1]) if alive else ("stale_token", None)
            else:
                status, shown = ("collision" if alive and mine[:2] != (ns, v) else "bound"), None
            if status in ("ok", "bound"):
                ns, v = mine[:2] if alive else (ns, v)
                held[s, t] = (ns, v, max(at + ttl, mine[2] if alive else at))
            out.append((s, t, kind, shown, status, at))
    return sorted(out, key=str)


def test_a_hot_token_in_many_frames_and_a_batch_done_twice(spark, tmp_path):
    rng = random.Random(5)
    batches = []
    for b in range(5):
        rows = []
        for i in range(1200):
            token = "hot" if i % 3 == 0 else f"t{rng.randrange(40)}"
            kind = rng.choice(["bind", "bind", "resolve"])
            rows.append(event(rng.choice("ab"), token, kind, None if kind == "resolve" else f"v{rng.randrange(3)}", b * 300 + rng.randrange(300)))
        batches.append(rows)
    log = S.SessionLog(spark, str(tmp_path / "log"), ttl_seconds=1200, fan=2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for number, rows in enumerate(batches):
            log.step(frame(spark, rows), number)
            if number in (1, 3):
                log.step(frame(spark, rows), number)  # as after a failure before the commit: runs are merged by then
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = sorted((tuple(r) for r in log.outcomes().collect()), key=str)
    assert got == by_hand(batches, timedelta(seconds=1200))


def test_late_untimed_and_unknown_events_change_nothing(spark, tmp_path):
    log = S.SessionLog(spark, str(tmp_path / "log"), ttl_seconds=600, delay_seconds=600)
    log.step(frame(spark, [event("a", "t", "bind", "x", 100)]), 0)
    log.step(frame(spark, [event("a", "t", "bind", "y", 5), event("a", "t", "bind", "y", None), event("a", "t", None, "y", 101), event(None, None, "bind", "z", 101)]), 1)
    log.step(frame(spark, [event("a", "t", "resolve", None, 102), event(None, None, "resolve", None, 102)]), 2)
    log.step(frame(spark, []), 3)
    got = {(r.token, r.kind, r.at): (r.status, r.value) for r in log.outcomes().collect()}
    at = lambda m: START + timedelta(minutes=m)
    assert got[("t", "bind", at(5))] == ("late", None)
    assert got[("t", "bind", None)] == ("untimed", None)
    assert got[("t", None, at(101))] == ("unknown", None)
    assert got[("t", "resolve", at(102))] == ("ok", "x")
    assert got[(None, "resolve", at(102))] == ("ok", "z")


def test_latest_log_merges_runs_and_repeats_harmlessly(spark, tmp_path):
    log = LatestLog(spark, str(tmp_path / "log"), ["id"], "seq", fan=2)
    assert log.read() is None
    want = {}
    for number in range(7):
        rows = [(f"r{i % 5}", number * 10 + i, f"{number}/{i}") for i in range(8)]
        want |= {r[0]: r for r in sorted(rows, key=lambda r: r[1])}
        for _ in range(2):
            log.append(spark.createDataFrame(rows, "id string, seq int, v string"), number)
        assert sorted(tuple(r) for r in log.read().collect()) == sorted(want.values())
    assert log.chosen() == [(0, 3), (4, 5), (6, 6)]
    assert {f.rsplit("/", 1)[1] for f in log.superseded()} == {"run-0-0", "run-1-1", "run-2-2", "run-3-3", "run-0-1", "run-2-3", "run-4-4", "run-5-5"}
    assert log.read(before=5).count() == 5
    (tmp_path / "log" / "run-0-7").mkdir()  # a merge that did not finish
    assert log.chosen()[0] == (0, 3)


def test_latest_log_takes_empty_batches_and_null_orders(spark, tmp_path):
    log = LatestLog(spark, str(tmp_path / "log"), ["id"], "seq")
    schema = "id string, seq int, v string"
    log.append(spark.createDataFrame([], schema), 0)
    assert log.read().count() == 0
    log.append(spark.createDataFrame([("a", None, "x"), ("a", 1, "y"), (None, 2, "z"), (None, 2, "z")], schema), 1)
    assert sorted(map(str, map(tuple, log.read().collect()))) == ["('a', 1, 'y')", "(None, 2, 'z')"]
