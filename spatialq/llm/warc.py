"""WARC archives: write monolithic gzip streams, normalise them to one member a record, read by index.

``write_archives`` writes pages as WARC/1.1 records into whole-file gzip streams and
returns a narrow row a record. ``archive_plan`` finds, from these rows alone, which
records repeat another's payload, and lists them by file. ``normalise`` inflates each
stream once, rewrites every record as a gzip member of its own - repeats as revisits,
without the payload - and writes a sidecar index of offsets; ``sidecar_rows`` reads the
sidecars and ``read_records`` fetches members by them. A record at a time passes through,
so an archive of any size may be normalised. Payloads are never shuffled. Archives roll over at a byte limit, files are put
in place by renaming, and only those that the rows of finished tasks name are read, so
lost executors cost only a retry.

Defined results: a null html is an empty payload; equal payloads (also empty ones) of
``dedup_min_bytes`` or more share one response record, that of the smallest page_id (a
null page_id counts as largest), and the others are revisits of it; repeated rows are
records of their own: of several with the smallest page_id, one is the response, the first
by url, then by its place in the archives; a very long page is one record, held whole only while it is written or read; an
empty table gives an empty result and no archive. Other columns are not read.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, scratch, written

CRLF = b"\r\n"
ROWS_PER_TASK = 2000
RECORDS = "file string, record long, page_id long, url string, payload_bytes long, digest string"
INDEX_SCHEMA = "file string, member long, offset long, length long"
RECORD_SCHEMA = (
    "page_id long, record_type string, refers_to long, target_uri string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def placing(uri: str) -> Iterator[pa.NativeFile]:
    """A stream whose file moves into place at the end, so that readers see all of it or none."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:12]}.part"
    with fs.open_output_stream(part, compression=None) as out:
        yield out
    fs.move(part, path)


def put(uri: str, data: bytes) -> None:
    with placing(uri) as out:
        out.write(data)


def digest_base32(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def archive_plan(records: DataFrame, dedup_min_bytes: int = 0) -> DataFrame:
    """(file, records, revisits): the records of each archive, and which of them revisit another page.

    records: the rows of ``write_archives``. The first record of each digest comes from a
    partial aggregate; a digest that fills a third of the table is split by the join.
    """
    rank = F.struct(F.col("page_id").isNull().alias("z"), "page_id", "url", "file", "record")
    first = (
        records.filter(F.col("payload_bytes") >= dedup_min_bytes)
        .groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1").select("digest", "first")
    )
    other = (F.col("file") != F.col("first.file")) | (F.col("record") != F.col("first.record"))
    again = records.select("file", "record", "digest").join(first, "digest").filter(other)
    # at most the records of one archive
    lists = again.groupBy("file").agg(F.collect_list(F.struct("record", F.col("first.page_id").alias("refers_to"))).alias("revisits"))
    return records.groupBy("file").agg(F.count("*").alias("records")).join(lists, "file", "left")


def record_bytes(row: dict) -> bytes:
    """One WARC/1.1 record. A revisit carries headers only; its digest and length describe the full payload."""
    page = "null" if row["page_id"] is None else row["page_id"]
    body = row["payload"] if row["record_type"] == "response" else b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    block = http + body
    heads = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", f"<urn:page:{page}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join(c if c > " " else "%%%02X" % ord(c) for c in row["url"])),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
        ("X-Payload-Length", str(row["payload_bytes"])),
    ]
    if row["record_type"] == "revisit":
        refers = "null" if row["refers_to"] is None else row["refers_to"]
        heads += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:page:{refers}>"),
        ]
    heads.append(("Content-Length", str(len(block))))
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in heads) + CRLF
    return head + block + CRLF + CRLF


def as_revisit(raw: bytes, refers_to: int | None) -> bytes:
    """A response record as a revisit of another page: the same headers, without the payload."""
    heads, block, _ = parse_record(io.BytesIO(raw))
    return record_bytes({
        "page_id": page_of(heads["warc-record-id"]),
        "url": heads["warc-target-uri"],
        "payload": b"",
        "payload_bytes": int(heads["x-payload-length"]),
        "payload_digest": heads["warc-payload-digest"].partition(":")[2],
        "record_type": "revisit",
        "refers_to": refers_to,
    })


def parse_record(stream: io.BufferedIOBase) -> tuple[dict, bytes, bytes] | None:
    """Headers, block and raw bytes of the next record; None at the end."""
    first = stream.readline()
    while first in (CRLF, b"\n"):
        first = stream.readline()
    if not first:
        return None
    if not first.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    raw, heads = [first], {}
    while True:
        line = stream.readline()
        if not line:
            raise ValueError("the headers of a record are cut off")
        raw.append(line)
        if line in (CRLF, b"\n"):
            break
        k, _, v = line.decode("utf-8").partition(":")
        heads[k.strip().lower()] = v.strip()
    n = int(heads["content-length"])
    block = stream.read(n)
    if len(block) < n:
        raise ValueError("the block of a record is cut off")
    return heads, block, b"".join(raw) + block + CRLF + CRLF


def gzip_bytes(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = 32 << 20, level: int = 1, rows: int | None = None) -> DataFrame:
    """Write the pages as whole-file gzip streams; returns a row a record (file, record, page_id, url, payload_bytes, digest).

    rows: about how many pages there are; few pages then make few archives.
    """
    p = pick(pages, "page_id", "url", "html").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    if rows is not None:
        p = p.coalesce(max(1, -(-rows // ROWS_PER_TASK)))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task may hold several partitions, so its number is not enough for a name
        part, serial, held, size = uuid.uuid4().hex, 0, [], 0
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal serial, held, size, done
            name = f"part-{part}-{serial:05d}.warc.gz"
            put(f"{folder}/{name}", gzip_bytes(b"".join(held), level))
            columns = [[name] * len(done), range(len(done)), *zip(*done, strict=True)]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            serial, held, size, done = serial + 1, [], 0, []
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in RECORDS.split(", ")])

        for batch in batches:
            for row in batch.to_pylist():
                n, digest = len(row["payload"]), digest_base32(row["payload"])
                held.append(record_bytes(row | {"payload_bytes": n, "payload_digest": digest, "record_type": "response"}))
                done.append((row["page_id"], row["url"], n, digest))
                size += len(held[-1])
                if size >= roll_bytes:
                    yield flush()
        if held:
            yield flush()

    return written(p.mapInArrow(write, RECORDS), "warc-records")


def split_members(uri: str, piece: int = 1 << 20) -> Iterator[bytes]:
    """The records of a gzip file, whole-file stream or many members, inflating it once in pieces."""
    fs, path = open_fs(uri)

    class Inflated(io.RawIOBase):
        def __init__(self, src) -> None:
            self.src, self.z, self.left, self.out = src, zlib.decompressobj(31), b"", b""

        def readable(self) -> bool:
            return True

        def readinto(self, buf) -> int:
            while not self.out:
                if self.z.eof:
                    self.left, self.z = self.z.unused_data or self.left, zlib.decompressobj(31)
                chunk = self.left or self.src.read(piece)
                self.left = b""
                if not chunk:
                    return 0
                self.out = self.z.decompress(chunk)
                if self.z.eof:
                    self.left = self.z.unused_data
            n = min(len(buf), len(self.out))
            buf[:n], self.out = self.out[:n], self.out[n:]
            return n

    with fs.open_input_stream(path, compression=None) as src:
        stream = io.BufferedReader(Inflated(src), piece)
        while (found := parse_record(stream)) is not None:
            yield found[2]


def normalise(files: DataFrame, source: str, folder: str, level: int = 6) -> DataFrame:
    """Rewrite each archive of (file, revisits) with one gzip member a record and a sidecar; returns (file, records).

    revisits: the records that become revisits, with the pages they refer to; null for none.
    The sidecar ``<file>.idx`` holds (offset, length) pairs as little-endian int64.
    """

    def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name, again = row["file"], {r["record"]: r["refers_to"] for r in row["revisits"] or ()}
                at = records = 0
                with placing(f"{folder}/{name}") as out, placing(f"{folder}/{name}.idx") as idx:
                    for raw in split_members(f"{source}/{name}"):
                        member = gzip_bytes(as_revisit(raw, again[records]) if records in again else raw, level)
                        out.write(member)
                        idx.write(struct.pack("<qq", at, len(member)))
                        at, records = at + len(member), records + 1
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records])], names=["file", "records"])

    plan = files.select("file", "revisits")
    plan = plan.repartition(max(1, min(plan.count(), 100_000)))
    return written(plan.mapInArrow(rewrite, "file string, records long"), "warc-members")


def read_index(uri: str) -> list[tuple[int, int]]:
    """The (offset, length) pairs of a sidecar."""
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as src:
        data = src.read()
    return [tuple(x) for x in struct.iter_unpack("<qq", data)]


def sidecar_rows(files: DataFrame, folder: str) -> DataFrame:
    """(file, member, offset, length) of every record, read from the sidecars in pieces."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = open_fs(f"{folder}/{name}.idx")
                member = 0
                with fs.open_input_stream(path, compression=None) as src:
                    while data := src.read(16 << 14):
                        pairs = np.frombuffer(data, "<i8").reshape(-1, 2)
                        n = len(pairs)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * n, pa.string()), pa.array(np.arange(member, member + n)), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())],
                            names=["file", "member", "offset", "length"],
                        )
                        member += n

    return files.select("file").mapInArrow(read, INDEX_SCHEMA)


def page_of(urn: str | None) -> int | None:
    found = (urn or "").strip("<>").rpartition(":")[2]
    return int(found) if found.lstrip("-").isdigit() else None


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Records read back by index rows: each member is fetched and inflated alone.

    Lengths and digests of responses are computed anew from the payloads that were read;
    a revisit takes them from its headers, its payload being that of the response.
    """

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            held, size = None, 0
            for name, offset, length in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if held is None or held[0] != name:
                    if held:
                        held[1].close()
                    fs, path = open_fs(f"{folder}/{name}")
                    held = (name, fs.open_input_file(path))
                raw = zlib.decompress(held[1].read_at(length, offset), 31)
                heads, block, _ = parse_record(io.BytesIO(raw))
                revisit = heads["warc-type"] == "revisit"
                payload = None if revisit else block.partition(CRLF + CRLF)[2]
                rows.append({
                    "page_id": page_of(heads["warc-record-id"]),
                    "record_type": heads["warc-type"],
                    "refers_to": page_of(heads.get("warc-refers-to")),
                    "target_uri": heads["warc-target-uri"],
                    "payload_bytes": int(heads["x-payload-length"]) if revisit else len(payload),
                    "payload_digest": heads["warc-payload-digest"].partition(":")[2] if revisit else digest_base32(payload),
                    "payload": payload,
                })
                size += len(raw)
                if size > 8 << 20:
                    yield as_batch(rows)
                    rows, size = [], 0
            if held:
                held[1].close()
            if rows:
                yield as_batch(rows)

    return index.mapInArrow(fetch, RECORD_SCHEMA)


def as_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64(), "target_uri": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def round_trip(pages: DataFrame, roll_bytes: int = 32 << 20, dedup_min_bytes: int = 0) -> DataFrame:
    """Write pages as monolithic archives, normalise them and read every record back by the sidecars."""
    base = scratch(pages.sparkSession, "warc")
    n = pages.count()
    records = write_archives(pages, f"{base}/whole", roll_bytes, rows=n)
    done = normalise(archive_plan(records, dedup_min_bytes), f"{base}/whole", f"{base}/members")
    spread = sidecar_rows(done, f"{base}/members").repartitionByRange(max(1, -(-n // ROWS_PER_TASK)), "file", "offset").sortWithinPartitions("file", "offset")
    return read_records(spread.select("file", "member", "offset", "length"), f"{base}/members")
