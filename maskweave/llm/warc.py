"""WARC archives: each record a gzip member of its own, read back by ranges of bytes.

A reading task gets a range of a file. It looks for the magic number of gzip, takes a place for a record's start if what
follows inflates to a WARC header, and then goes from member to member. It owns the records that start in its range, and
reads the last of them beyond it. A range could still begin inside a record that holds a whole archive as its payload; so
each start is held against the ends of the file's records, and a file with a start that no record leads to is read again
as one range. Files are opened by their URI, in any store that Arrow's file systems reach.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskweave.llm.common import shared_folder, written

MAGIC = b"\x1f\x8b\x08"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Characters that stay as they are in a target URI.
_URI = "%/:=&?~#+!$,;'@()*[]-._"
_READ = 1 << 18
#: Most bytes of a record's header; more is no header.
_HEADER = 1 << 20


@dataclass(frozen=True)
class WarcRules:
    """least: bytes from which an equal payload is a revisit; file: bytes after which a new file is begun; span: bytes of a
    reading range; level: of compression; date: the records' date."""

    least: int = 100
    file: int = 1 << 30
    span: int = 16 << 20
    level: int = 6
    date: str = "2024-01-01T00:00:00Z"


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _gzipped(record: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def roles(records: DataFrame, rules: WarcRules) -> DataFrame:
    """Records that revisit another, (record_id, first_record, first_url): of the rows of a payload, all but the
    one with the smallest id. Null ids come last, a repeated id goes by the record's own id."""
    thin = records.where(F.col("n") >= rules.least).select("record_id", "id", "url", "n", "digest")
    key = F.struct(F.col("id").isNull().alias("none"), "id", "record_id", "url")
    firsts = thin.groupBy("digest", "n").agg(F.min(key).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    same = thin.select("record_id", "digest", "n").join(firsts, ["digest", "n"]).where("record_id != first.record_id")
    return same.select(
        "record_id", F.col("first.record_id").alias("first_record"), F.col("first.url").alias("first_url")
    )


def write(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", rules: WarcRules = WarcRules()) -> DataFrame:
    """Archives of ``pages`` in the shared folder, and their list ``(path, bytes, records)``.

    A row is a record: its payload the html in UTF-8, none for null. Of rows with an equal payload of at least ``least``
    bytes, that with the smallest id is a response, and the others revisit it; all smaller ones are responses. A repeated
    row is a record each time. An id goes into the field ``Page-ID``, percent-encoded, and no field for null; a null URL
    has no field. An empty table has no archive. Only files that are in the list count: a task that was lost leaves
    others behind. Other columns are not read.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    source = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), payload.alias("payload"))
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"

    made = written(
        source.select(
            "id", "url", "payload", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("digest"),
            F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")).alias("record_id"),
        ),
        "warc-rows",
    )
    records = made.join(roles(made, rules), "record_id", "left").withColumn("id", F.col("id").cast("string"))

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        path, out, size, count = "", None, 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array([size], pa.int64()), "records": pa.array([count], pa.int64())})

        for batch in batches:
            for row in _rows(batch):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, size, count = f"{folder}/{name}", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    info = [("WARC-Type", "warcinfo"), ("WARC-Date", rules.date), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")]
                    size += out.write(_gzipped(_record(info, b"format: WARC File Format 1.1\r\n"), rules.level))
                body = row["payload"] if row["first_record"] is None else b""
                size += out.write(_gzipped(_page_record(row, body, rules), rules.level))
                count += 1
                if size >= rules.file:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return written(records.mapInArrow(archived, "path string, bytes bigint, records bigint"), "warc-files")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time."""
    for k in range(batch.num_rows):
        yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


def _uri(url: str | None) -> str | None:
    return None if url is None else quote(url, safe=_URI)


def _page_record(row: dict, body: bytes, rules: WarcRules) -> bytes:
    """The record of a page, a revisit if ``row`` names a first record."""
    again = row.get("first_record")
    fields = [
        ("WARC-Type", "revisit" if again else "response"),
        ("WARC-Date", rules.date),
        ("WARC-Record-ID", row["record_id"]),
        ("WARC-Target-URI", _uri(row["url"])),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
        ("Page-ID", None if row["id"] is None else quote(str(row["id"]), safe="")),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if again:
        fields += [
            ("WARC-Profile", REVISIT),
            ("WARC-Refers-To", again),
            ("WARC-Refers-To-Target-URI", _uri(row["first_url"])),
            ("WARC-Refers-To-Date", rules.date),
        ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n']}\r\n\r\n"
    return _record(fields, http.encode() + body)


class _Member:
    """The decoded bytes of the gzip member at a place of a file, read as far as they are asked for."""

    def __init__(self, file, at: int):
        self.file, self.pos = file, at
        self.inflate = zlib.decompressobj(31)
        self.held = bytearray()
        self.end: int | None = None

    def more(self) -> bool:
        if self.end is not None:
            return False
        data = self.file.read_at(_READ, self.pos)
        if not data:
            raise ValueError("the file ends inside a member")
        self.pos += len(data)
        self.held += self.inflate.decompress(data)
        if self.inflate.eof:
            self.end = self.pos - len(self.inflate.unused_data)
        return True

    def head(self) -> dict[str, str] | None:
        """The fields of the next record's header, names in lower case; None at the member's end."""
        while (stop := self.held.find(b"\r\n\r\n")) < 0:
            if len(self.held) > _HEADER or (len(self.held) >= 5 and self.held[:5] != b"WARC/"):
                raise ValueError("no WARC header")
            if not self.more():
                if not self.held.strip(b"\r\n"):
                    return None
                raise ValueError("a member ends inside a header")
        if self.held[:5] != b"WARC/":
            raise ValueError("no WARC header")
        lines = bytes(self.held[:stop]).decode("utf-8", "replace").split("\r\n")[1:]
        del self.held[: stop + 4]
        fields, name = {}, ""
        for line in lines:
            if line[:1] in (" ", "\t") and name:
                fields[name] += " " + line.strip()
            else:
                name, _, value = line.partition(":")
                name = name.strip().lower()
                fields[name] = value.strip()
        return fields

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("a member ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip_line_ends(self) -> None:
        while True:
            lead = len(self.held) - len(self.held.lstrip(b"\r\n"))
            del self.held[:lead]
            if self.held or not self.more():
                return


def _starts_record(file, at: int) -> bool:
    """Whether the bytes at ``at`` inflate to a WARC header."""
    try:
        return _Member(file, at).head() is not None
    except (ValueError, zlib.error):
        return False


def _first_record(file, at: int, end: int) -> int | None:
    """The first place in [at, end) where a record's member starts."""
    while at < end:
        data = file.read_at(min(_READ, end - at) + len(MAGIC) - 1, at)
        hit = data.find(MAGIC)
        while 0 <= hit < end - at:
            if _starts_record(file, at + hit):
                return at + hit
            hit = data.find(MAGIC, hit + 1)
        at += _READ
    return None


_RECORD = (
    "path string, offset bigint, place int, next bigint, record_type string, record_id string, target_uri string, "
    "refers_to string, page_id string, payload_digest string, payload_bytes bigint, payload_sha256 string, payload binary, "
    "damaged boolean"
)
_NAMES = [x.split()[0] for x in _RECORD.split(", ")]


def records_of(file, start: int, end: int) -> Iterator[dict]:
    """The records whose members start in [start, end), and where the member after each starts. A member that can't be
    read to its end gives a row that is ``damaged``, and reading goes on at the next that can."""
    at = _first_record(file, start, end)
    while at is not None and at < end:
        member, place = _Member(file, at), 0
        try:
            found = []
            while (fields := member.head()) is not None:
                block = member.take(int(fields.get("content-length", "0")))
                member.skip_line_ends()
                found.append(_read(fields, block) | {"offset": at, "place": place, "next": None, "damaged": False})
                place += 1
                if len(found) > 1:  # only a record's end tells where its member ends
                    yield found.pop(0)
            for x in found:
                yield x | {"next": member.end}
        except (ValueError, zlib.error):
            yield {"offset": at, "place": place, "damaged": True}
            at = _first_record(file, at + 1, end)
            continue
        at = member.end
        if at < end and file.read_at(len(MAGIC), at) != MAGIC:
            at = _first_record(file, at, end)


def _read(fields: dict[str, str], block: bytes) -> dict:
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        _, _, payload = block.partition(b"\r\n\r\n")
    page = fields.get("page-id")
    return {
        "record_type": fields.get("warc-type"),
        "record_id": fields.get("warc-record-id"),
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"),
        "page_id": None if page is None else unquote(page),
        "payload_digest": fields.get("warc-payload-digest"),
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "payload": payload,
    }


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in _RECORD.split(", "))])


def _ranges_read(ranges: DataFrame, tasks: int, with_payload: bool) -> DataFrame:
    """Records of ``ranges (path, start, end)``."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema()
        for batch in batches:
            for row in _rows(batch):
                store, path = FileSystem.from_uri(row["path"])
                some, size = [], 0
                with store.open_input_file(path) as file:
                    for x in records_of(file, row["start"], row["end"]):
                        if not with_payload:
                            x.pop("payload", None)
                        some.append({n: x.get(n) for n in _NAMES} | {"path": row["path"]})
                        size += len(x.get("payload") or b"")
                        if size > 1 << 22 or len(some) >= 256:
                            yield pa.RecordBatch.from_pylist(some, schema)
                            some, size = [], 0
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema)

    return ranges.repartition(tasks, "path", "start").mapInArrow(scanned, _RECORD)


def read(files: DataFrame, rules: WarcRules = WarcRules(), with_payload: bool = True) -> DataFrame:
    """All records of the archives ``files (path, bytes)``, each once, written to the shared folder.

    ``path, offset, place``: where it is, ``place`` being its number in a member that holds several; ``payload``: the
    block, without the HTTP header where it has one, null unless ``with_payload``; ``payload_bytes, payload_sha256``: of what
    was read; ``payload_digest``: what the header states; ``damaged``: a member that can't be read. No files give no rows.
    """
    spans = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(rules.span).cast("long"))
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(spans).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + rules.span, F.col("bytes")).alias("end"))
    tasks = min(max(1, ranges.count()), 20_000)
    found = written(_ranges_read(ranges, tasks, with_payload), "warc-records")
    ends = found.where("next is not null").select("path", F.col("next").alias("offset"))
    lost = found.where("offset > 0").select("path", "offset").join(ends, ["path", "offset"], "left_anti").select("path").distinct()
    again = written(files.join(lost, "path", "left_semi").select("path", F.lit(0).cast("long").alias("start"), F.col("bytes").alias("end")), "warc-again")
    n = again.count()
    if not n:
        return found
    return found.join(again.select("path"), "path", "left_anti").unionByName(written(_ranges_read(again, min(n, 20_000), with_payload), "warc-records"))


def payloads(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of the responses and revisits among ``records``.

    Bytes and digest are those of the full payload, computed from what was read: a revisit has those of the response it
    refers to, and that one's id as ``refers_to``. A response whose digest isn't the one its header states, a revisit
    without its response, and a damaged member end the job.
    """

    wanted = F.col("record_type").isin("response", "revisit") | F.col("damaged")
    digest = F.col("payload_sha256")
    said = F.lower(F.substring_index("payload_digest", ":", -1))
    broken = F.col("damaged") | ((F.col("record_type") == "response") & (said != digest))
    own = records.where(wanted).select(
        F.col("page_id").cast(id_type).alias("page_id"), "record_type", "record_id", "refers_to",
        F.when(broken, F.raise_error(F.concat(F.lit("a record can't be read: "), "path", F.lit(" "), F.col("offset").cast("string"))).cast("string"))
        .otherwise(digest).alias("digest"),
        F.col("payload_bytes").alias("bytes"),
    )
    responses = own.where("NOT record_type <=> 'revisit'")
    first = responses.select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("first_id"), F.col("digest").alias("first_digest"),
        F.col("bytes").alias("first_bytes"),
    )
    revisits = own.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to").join(first, "refers_to", "left")
    whole = F.coalesce("first_digest", F.raise_error(F.lit("a revisit has no response")).cast("string"))
    return responses.select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type",
        F.lit(None).cast(id_type).alias("refers_to"),
    ).unionAll(revisits.select("page_id", "first_bytes", whole, "record_type", "first_id"))
