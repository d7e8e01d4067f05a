"""WARC archives written and read back by ranges."""

import gzip
import hashlib
import random

import pytest

from maskweave.llm import warc
from maskweave.llm.common import shared_folder

SCHEMA = "page_id bigint, url string, html string, row int, n string, digest string"


def roles(rows, least=100):
    """What each row comes back as, rows in order (page_id, url, html)."""
    out = []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    first = {}
    for k in order:
        data = (rows[k][2] or "").encode()
        again = len(data) >= least and data in first
        out.append((rows[k][0], len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first.get(data) if again else None))
        first.setdefault(data, rows[k][0])
    return sorted(out, key=str)


def round_trip(spark, rows, rules=warc.WarcRules()):
    df = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA).repartition(3)
    found = warc.payloads(warc.read(warc.write(df, rules=rules), rules))
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted([tuple(r) for r in found.collect()], key=str)


def some_pages(n=300):
    rng = random.Random(4)
    text = lambda k: "".join(rng.choices("abc <>é日\r\n\0WARC/1.1", k=k))
    rows = [(i, f"http://h{i % 7}/ä b\r\n{i}", text(rng.choice([0, 5, 99, 100, 2000]))) for i in range(n)]
    same = "<p>" + "copy " * 40
    rows += [(1000 - i, "u", same) for i in range(200)] + [(5000, None, "short")] * 3 + [(None, "u", same), (None, None, None), (7, "", "")]
    rows += [(6000, "u", "once more " * 30)] * 4  # repeated rows: one response
    return rows + [(8000, "u", "long text, " * 200_000)]


def test_round_trip(spark):
    rows = some_pages()
    assert round_trip(spark, rows) == roles(rows)


def test_small_ranges_and_files(spark):
    rows = some_pages(150)
    rules = warc.WarcRules(file=2000, span=301, level=1)
    assert round_trip(spark, rows, rules) == roles(rows)
    # Hardly compressed, so that one record goes through many ranges.
    assert round_trip(spark, rows[:40] + rows[-1:], warc.WarcRules(file=1 << 30, span=4097, level=0)) == roles(rows[:40] + rows[-1:])


def test_no_pages(spark):
    assert round_trip(spark, []) == []
    assert round_trip(spark, [(None, None, None)]) == roles([(None, None, None)])


def record(body, kind="resource"):
    return warc._record([("WARC-Type", kind), ("WARC-Record-ID", f"<{hashlib.md5(body).hexdigest()}>")], body)


def archive(spark, name, data):
    path = f"{shared_folder(spark).removeprefix('file:')}/{name}.warc.gz"
    with open(path, "wb") as out:
        out.write(data)
    return spark.createDataFrame([(path, len(data))], "path string, bytes bigint")


def test_an_archive_inside_a_record_is_its_payload(spark):
    inner = b"".join(gzip.compress(record(b"inner %d" % k), 0) for k in range(50))
    bodies = [b"first", inner, b"last"]
    data = b"".join(warc._gzipped(record(b), 0) for b in bodies)
    for span in (100, 700, 1 << 20):
        found = warc.read(archive(spark, f"nested-{span}", data), warc.WarcRules(span=span))
        assert [bytes(r.payload) for r in found.orderBy("offset").collect()] == bodies


def test_several_records_in_a_member_and_padding(spark):
    data = gzip.compress(record(b"a") + record(b"b" * 999) + record(b"")) + b"\0" * 600 + gzip.compress(record(b"c"))
    found = warc.read(archive(spark, "several", data), warc.WarcRules(span=64)).orderBy("offset", "place").collect()
    assert [bytes(r.payload) for r in found] == [b"a", b"b" * 999, b"", b"c"]


def test_a_damaged_member_is_told_and_passed(spark):
    members = [bytearray(gzip.compress(record(bytes([65 + k]) * 3000 + random.Random(k).randbytes(3000)))) for k in range(4)]
    members[1][1500:1600] = bytes(100)
    files = archive(spark, "damaged", b"".join(members))
    found = warc.read(files, warc.WarcRules(span=1000)).orderBy("offset").collect()
    assert [(r.damaged, r.payload and bytes(r.payload[:1])) for r in found] == [(False, b"A"), (True, None), (False, b"C"), (False, b"D")]
    with pytest.raises(Exception, match="can't be read"):
        warc.payloads(warc.read(files)).collect()


def test_header_fields():
    head = b"WARC/1.0\r\nWARC-Type: resource\r\nX-Long: one\r\n two\r\ncontent-LENGTH: 2\r\n\r\nab\r\n\r\n"

    class File:
        data = gzip.compress(head)

        def read_at(self, n, at):
            return self.data[at : at + n]

    (got,) = warc.records_of(File(), 0, 10)
    assert (got["record_type"], got["payload"], got["next"]) == ("resource", b"ab", len(File.data))
