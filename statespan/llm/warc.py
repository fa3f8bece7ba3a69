"""WARC archives: writing, normalising and reading, with archives as rows.

An archive is a row (archive, content): the same shape that Spark's binaryFile
source gives for ``*.warc.gz`` files, so that files of any store can be
normalised; ``written`` archives live as a table in the shared folder.

``normalise`` takes archives that are one gzip stream over all records (or any
mix of members): it inflates the stream once, front to back, rewrites each
record as a gzip member of its own and notes member offset and length in a
sidecar index (archive, record, offset, length, record_id, type). Memory holds
one archive and one record at a time, and archives have at most about
``ARCHIVE_BYTES`` of records, so one never grows with the table.

``write_pages`` makes one record per page. Of pages with equal payloads of at
least ``MIN_REVISIT`` bytes the one with the largest page_id is the response and
the others are revisits of it.

Defined cases: a null html is an empty payload, a null url is "about:blank"
in the record; equal payloads on rows that share the largest page_id are all
responses; a null page_id counts as smaller than all others; a broken record
(no version line, a length beyond the stream) raises; an empty table gives no
archives; a payload of any length is one record, held whole by the task that
writes or reads it; extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, saved, small_batches, table

MIN_REVISIT = 1000
ARCHIVE_BYTES = 16 << 20
LEVEL = 1
_DATE = "1970-01-01T00:00:00Z"
_STEP = 1 << 16
_INDEX = "archive string, record bigint, offset bigint, length bigint, record_id string, type string"


# -- records ------------------------------------------------------------------

def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = "" if page_id is None else page_id
    uri = "".join(c if c.isprintable() and c != " " else "%" + "%".join(f"{b:02X}" for b in c.encode()) for c in url or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


class _Stream:
    """Inflates any number of gzip members, a step at a time; what was taken is dropped now and
    then, so that a record of any length costs time in proportion to it."""

    def __init__(self, content: bytes):
        self.content, self.at, self.tool = memoryview(content), 0, zlib.decompressobj(31)
        self.held, self.start = bytearray(), 0

    def more(self) -> bool:
        while True:
            if self.tool.eof:
                self.at -= len(self.tool.unused_data)
                if self.at >= len(self.content):
                    return False
                self.tool = zlib.decompressobj(31)
            step = self.tool.unconsumed_tail
            if not step:
                step = self.content[self.at: self.at + _STEP]
                if not len(step):
                    return False
                self.at += len(step)
            if got := self.tool.decompress(step, _STEP * 4):
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        seen = self.start
        while (i := self.held.find(mark, seen)) < 0:
            seen = max(self.start, len(self.held) - len(mark) + 1)
            if not self.more():
                return None
        return self.take(i + len(mark) - self.start)

    def take(self, n: int) -> bytes:
        while len(self.held) - self.start < n:
            if not self.more():
                raise ValueError("the stream ends inside a record")
        out = bytes(memoryview(self.held)[self.start: self.start + n])
        self.start += n
        if self.start > max(_STEP * 16, len(self.held) // 2):
            del self.held[: self.start]
            self.start = 0
        return out

    def rest(self) -> bytes:
        return bytes(self.held[self.start:])


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of each record of a gzip stream."""
    stream = _Stream(content)
    while True:
        head = stream.until(b"\r\n\r\n")
        if head is None:
            if stream.rest().strip():
                raise ValueError("bytes after the last record")
            return
        if not head.startswith(b"WARC/"):
            raise ValueError("no version line")
        fields = _headers(head)
        yield fields, head + stream.take(int(fields["content-length"]) + 4)


# -- archives -------------------------------------------------------------------

def _pack(archive_bytes: int, level: int):
    """Records of a partition into monolithic archives: one gzip stream each."""
    def run(batches):
        def done():
            parts.append(tool.flush())
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{first}.warc.gz"]), pa.array([b"".join(parts)], pa.large_binary())], names=["archive", "content"])

        tool, parts, size, first = None, [], 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "revisit", "place")]
            for page_id, url, html, digest, refers_to, revisit, place in zip(*columns):
                if tool is None:
                    tool, parts, size, first = zlib.compressobj(level, zlib.DEFLATED, 31), [], 0, place
                raw = record(page_id, url, (html or "").encode(), digest, refers_to, revisit)
                parts.append(tool.compress(raw))
                size += len(raw)
                if size >= archive_bytes:
                    yield done()
                    tool = None
        if tool is not None:
            yield done()
    return run


def write_pages(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Monolithic archives (archive, content) of pages (page_id, url, html), as a table
    in the shared folder."""
    small_batches(pages.sparkSession)
    page_id = F.col("page_id").cast("bigint").alias("page_id")
    html = F.coalesce("html", F.lit(""))
    # stored, as two plans read it: of the html itself there are this scan and that of the packing
    digests = saved(pages.where(F.octet_length(html) >= MIN_REVISIT).select(page_id, F.sha1(html.cast("binary")).alias("digest")), "digests")
    again = (digests.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low"), F.count("page_id").alias("known"), F.count("*").alias("n"))
             .where("n > 1 and (low < refers_to or known < n)").select("digest", "refers_to"))
    revisits = (digests.join(again, "digest").where("refers_to is not null and not (page_id <=> refers_to)")
                .select("page_id", "digest", "refers_to").distinct())
    rows = pages.select(page_id, F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    joined = rows.alias("p").join(revisits.alias("r"), F.expr("p.page_id <=> r.page_id and p.digest = r.digest"), "left")
    full = joined.select("p.page_id", "p.url", "p.html", "p.digest", "r.refers_to", F.col("r.refers_to").isNotNull().alias("revisit"), F.monotonically_increasing_id().alias("place"))
    out = saved(full.mapInArrow(_pack(archive_bytes, level), "archive string, content binary"), "archives")
    discard(digests)
    return out


def _rewrite(level: int):
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out, index, at = [], [], 0
                for k, (fields, raw) in enumerate(records(content)):
                    tool = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = tool.compress(raw) + tool.flush()
                    out.append(member)
                    index.append({"record": k, "offset": at, "length": len(member), "record_id": fields.get("warc-record-id"), "type": fields.get("warc-type")})
                    at += len(member)
                kind = pa.list_(pa.struct([("record", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("type", pa.string())]))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(out)], pa.binary()), pa.array([index], kind)], names=["archive", "content", "index"])
    return run


def normalise(archives: DataFrame, level: int = LEVEL) -> DataFrame:
    """Archives (archive, content) of any gzip layout as (archive, content, index), one
    member per record; for files: ``spark.read.format("binaryFile").load(...)`` renamed."""
    schema = "archive string, content binary, index array<struct<record:bigint,offset:bigint,length:bigint,record_id:string,type:string>>"
    return saved(archives.select("archive", "content").mapInArrow(_rewrite(level), schema), "members")


def sidecar(normal: DataFrame) -> DataFrame:
    """The offset index of normalised archives, a row per record."""
    return normal.select("archive", F.explode("index").alias("i")).select("archive", "i.*")


def _read(batches):
    for batch in batches:
        for content, index in zip(batch.column("content").to_pylist(), batch.column("index").to_pylist()):
            rows = []
            for i in index:
                member = zlib.decompress(content[i["offset"]: i["offset"] + i["length"]], 31)
                head, _, rest = member.partition(b"\r\n\r\n")
                fields = _headers(head)
                http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                size = int(_headers(http)["content-length"])
                kind = fields["warc-type"]
                if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"record {fields['warc-record-id']} does not match its digest")
                number = lambda s: int(s[10:-1]) if s and len(s) > 11 else None
                rows.append((number(fields["warc-record-id"]), size, digest, kind, number(fields.get("warc-refers-to")), fields.get("warc-target-uri")))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])


def read_records(normal: DataFrame) -> DataFrame:
    """Each record by its place in the index; the payloads of responses are checked
    against their digests."""
    return normal.mapInArrow(_read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string")


def op4(spark, sf_dir: str) -> DataFrame:
    archives = write_pages(table(spark, sf_dir, "pages"))
    normal = normalise(archives)
    discard(archives)
    return read_records(normal).drop("url")
