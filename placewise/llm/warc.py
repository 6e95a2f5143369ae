"""WARC archives: writing with segmented records, and reading with segment reassembly.

Writing. Each page becomes one WARC/1.1 record whose block is an HTTP response. Of pages with equal payloads of at
least MIN_REVISIT bytes the one with the largest page_id is stored as `response`, the others as `revisit` records that
name it and hold headers only. Payloads travel in chunked transfer framing. A block longer than segment_bytes is cut: the
first record has WARC-Segment-Number 1, the rest are `continuation` records with WARC-Segment-Origin-ID, and the last
has WARC-Segment-Total-Length. Every record is a gzip member of its own. Segmented and whole records go to archives of
their own. Each task writes files of its own under a name that no other attempt uses, closes them, and reports them;
only reported files are read, so a task that dies or runs twice leaves nothing that counts.

Reading. Each file is read once, record by record, in bounded memory. Records of archives of segments are grouped by
origin identifier and ordered by segment number (an exchange and a sort, not a collected group), whichever archives
they stand in; numbers must be gapless from 1 and lengths must add up to the stated total, else reading fails. Whole
records stay where they are read. Then HTTP headers are split off and chunked framing decoded.

Only narrow digests are grouped to find revisits, with partial aggregation, so a payload that a third of all pages
share is no hot group; payloads move once, by page_id.

Defined results: a null html is an empty payload; rows with the same page_id and payload are each a record of their
own, all responses if that page_id is the largest of its payload; rows with a null page_id are responses and never
referred to; an empty table gives archives without records and no rows; other columns don't matter.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.llm._common import shared_path

MIN_REVISIT = 1000
SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 4 * 1024
#: Size of a file beyond which a task begins another.
FILE_BYTES = 128 << 20

_VERSION = b"WARC/1.1\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_WROTE = "path string, segmented boolean, n_records long, n_bytes long"
_READ = "origin string, segment int, total long, last boolean, page_id long, record_type string, refers_to long, digest string, block binary"
_FIELDS = [x.split(" ")[0] for x in _READ.split(", ")]
_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in HTTP/1.1 chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of chunked transfer framing; chunk extensions and trailers are dropped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";", 1)[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2 + size
        if len(body) < at + 2 or body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than its framing says")
        out.append(body[end + 2 : at])
        at += 2


def _record(headers: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (headers | {"Content-Length": len(block)}).items())
    return gzip.compress(_VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The gzip members of a page's records."""
    name = f"<urn:uuid:{uuid.uuid4()}>"
    own = {"WARC-Type": "response", "WARC-Record-ID": name, "WARC-Date": "1970-01-01T00:00:00Z"}
    if url is not None:
        own["WARC-Target-URI"] = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    if page_id is not None:
        own["X-Page-ID"] = page_id
    own |= {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        own |= {"WARC-Type": "revisit", "WARC-Profile": _PROFILE, "X-Refers-To-Page-ID": refers_to}
        yield _record(own, head + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record(own, block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record(own | {"WARC-Segment-Number": 1}, parts[0])
    for i, part in enumerate(parts[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": own["WARC-Date"], "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": i}
        if i == len(parts):
            more["WARC-Segment-Total-Length"] = len(block)
        yield _record(more, part)


def _members(stream: pa.NativeFile, size: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a file, one at a time. What is left of a read is copied for each member, so reads are short."""
    data, unzip, out = b"", zlib.decompressobj(31), []
    while data or (data := stream.read(size)):
        out.append(unzip.decompress(data))
        data = unzip.unused_data
        if unzip.eof:
            yield b"".join(out)
            unzip, out = zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("the file ends within a record")


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes


def parse(member: bytes) -> Record:
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(headers["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's block isn't as long as its header says")
    return Record(headers, rest[:length])


def payload_of(block: bytes) -> tuple[bytes, int]:
    """An HTTP response's payload and the payload's length, which a revisit's headers alone also tell."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if headers.get(b"transfer-encoding", b"").lower() == b"chunked":
        body = dechunked(body)
        return body, len(body)
    return body, int(headers.get(b"content-length", len(body)))


def _planned(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, url, payload, digest, refers_to)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    url = F.col("url").cast("string") if "url" in {c.lower() for c in pages.columns} else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= min_bytes).where("page_id IS NOT NULL").select("page_id", "digest")
    groups = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    again = large.join(groups, "digest").where("page_id < refers_to").distinct()
    return rows.join(again, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


class _Archive:
    """A file that a task writes."""

    def __init__(self, fs: pa.fs.FileSystem, root: str) -> None:
        self.path, self.n_records, self.n_bytes = f"{uuid.uuid4().hex}.warc.gz", 0, 0
        self.out = fs.open_output_stream(f"{root}/{self.path}", compression=None)

    def add(self, members: list[bytes]) -> None:
        for member in members:
            self.out.write(member)
            self.n_bytes += len(member)
        self.n_records += len(members)

    def closed(self, segmented: bool) -> pa.RecordBatch:
        """The file's row of the report."""
        self.out.close()
        return pa.RecordBatch.from_pydict({"path": [self.path], "segmented": [segmented], "n_records": [self.n_records], "n_bytes": [self.n_bytes]})


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Archives of pages (page_id, html, and url if there is one) in a shared folder; (path, segmented, n_records, n_bytes) of each file.

    The report is itself kept in the folder, so reading it again doesn't write again.
    """

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(f"{folder}/archives")
        fs.create_dir(root, recursive=True)
        files: dict[bool, _Archive] = {}
        for batch in batches:
            for row in zip(*(c for c in batch.columns), strict=True):
                page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
                members = list(records(page_id, url, payload, digest, refers_to, segment_bytes))
                segmented = len(members) > 1
                if segmented not in files:
                    files[segmented] = _Archive(fs, root)
                files[segmented].add(members)
                if files[segmented].n_bytes >= FILE_BYTES:
                    yield files.pop(segmented).closed(segmented)
        for segmented, file in files.items():
            yield file.closed(segmented)

    _planned(pages, min_bytes).mapInArrow(written, _WROTE).write.parquet(f"{folder}/files")
    return pages.sparkSession.read.parquet(f"{folder}/files")


def _scanned(files: DataFrame, folder: str) -> DataFrame:
    """A row for each record in the files."""

    def scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(f"{folder}/archives")
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    for member in _members(stream):
                        r = parse(member)
                        rows.append(_row(r))
                        held += len(r.block)
                        if held > 4 << 20:
                            yield _table(rows)
                            rows, held = [], 0
                if rows:
                    yield _table(rows)

    paths = files.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(scanned, _READ)  # a file a task


def _row(r: Record) -> tuple:
    h = r.headers
    number = lambda k: int(h[k]) if k in h else None
    total = number("warc-segment-total-length")
    origin = h.get("warc-segment-origin-id", h["warc-record-id"])
    segment = number("warc-segment-number") or 0
    return origin, segment, total, total is not None, number("x-page-id"), h["warc-type"], number("x-refers-to-page-id"), h.get("warc-payload-digest", "").removeprefix("sha1:"), r.block


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _FIELDS)


def _reassembled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins runs of segments with the same origin, which come in order of segment number."""
    run: list[tuple] = []

    def joined() -> tuple:
        if [x[1] for x in run] != list(range(1, len(run) + 1)) or not run[-1][3]:
            raise ValueError(f"{run[0][0]}: segments are missing or come twice")
        block = b"".join(x[8] for x in run)
        if len(block) != run[-1][2]:
            raise ValueError(f"{run[0][0]}: {len(block)} bytes of {run[-1][2]}")
        return (run[0][0], 0, *run[0][2:8], block)

    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run and row[0] != run[0][0]:
                out.append(joined())
                run = []
            run.append(row)
        if out:
            yield _table(out)
    if run:
        yield _table([joined()])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record_type, refers_to, digest, n_bytes, payload) of each response and revisit in the folder's archives.

    digest is the one that the record states; a response whose payload has another fails the read. A revisit's payload
    is null and its n_bytes that of the payload it refers to.
    """
    files = spark.read.parquet(f"{folder}/files")
    parts = _scanned(files.where("segmented"), folder).repartition("origin").sortWithinPartitions("origin", "segment")
    whole = _scanned(files.where("NOT segmented"), folder).unionByName(parts.mapInArrow(_reassembled, _READ))

    def opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select(["page_id", "record_type", "refers_to", "digest"])
            payloads, lengths = [], []
            for origin, segment, kind, digest, block in zip(*(batch.column(i).to_pylist() for i in (0, 1, 5, 7)), batch.column(8), strict=True):
                if segment:
                    raise ValueError(f"{origin}: a segment in an archive of whole records")
                payload, n = payload_of(block.as_py())
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"a payload's digest isn't {digest}")
                payloads.append(payload if kind == "response" else None)
                lengths.append(n)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lengths, pa.int64()), pa.array(payloads, pa.binary())], [*kept.schema.names, "n_bytes", "payload"])

    return whole.mapInArrow(opened, "page_id long, record_type string, refers_to long, digest string, n_bytes long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to a new shared folder and reads them back (see read)."""
    folder = shared_path(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder)
