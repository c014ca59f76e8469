"""WARC records in ZIP-packaged archives, read by ranges.

An archive is a ZIP file whose members are stored, not compressed: one holds
WARC records, each a gzip member of its own, another an index of their
offsets. A reader finds the central directory (ZIP64 or plain) from the file's
end, from it the stored members, from the index the records, and reads each
record's range alone. Nothing is extracted.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, hinted, shared_dir

# Fixed signatures and limits of the ZIP format.
LOCAL, CENTRAL, END = 0x04034B50, 0x02014B50, 0x06054B50
DESCRIPTOR, END64, LOCATOR64 = 0x08074B50, 0x06064B50, 0x07064B50
FULL16, FULL32, EXTRA64 = 0xFFFF, 0xFFFFFFFF, 0x0001
STREAMED = 0x0808  # sizes follow the data; names are UTF-8
ENCRYPTED = 0x0001

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"

#: Payloads from this many bytes on are told apart by digest.
LEAST_REVISIT = 1000

#: An archive is closed at this many bytes or records; its index is held meanwhile.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 256 << 20, 200_000

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


# --- Files: local paths, or any store that pyarrow knows.


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def create(path: str) -> io.RawIOBase:
    local = _local(path)
    if local is not None:
        return open(local, "wb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_output_stream(name)


class Ranges:
    """A file that is read by (offset, length)."""

    def __init__(self, path: str):
        local = _local(path)
        if local is not None:
            self.file = pa.OSFile(local, "rb")
        else:
            from pyarrow import fs

            store, name = fs.FileSystem.from_uri(path)
            self.file = store.open_input_file(name)
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ValueError(f"range {offset}+{length} is outside of {self.size} bytes")
        return self.file.read_at(length, offset)

    def __enter__(self) -> "Ranges":
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


# --- ZIP.


class ZipWriter:
    """Writes stored members in one pass, without seeking back.

    ``zip64`` True writes the ZIP64 records even where the plain ones suffice.
    """

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.members, self.open = out, zip64, 0, [], None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.open = [raw, self.at, 0, 0]
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, STREAMED, 0, 0, 0x21, 0, 0, 0, len(raw), 0) + raw)

    def write(self, data: bytes) -> int:
        """Returns the data's offset within the member."""
        at = self.open[3]
        self.open[2] = zlib.crc32(data, self.open[2])
        self.open[3] += len(data)
        self._put(data)
        return at

    def end(self) -> None:
        _, _, crc, size = self.open
        wide = size >= FULL32 or self.zip64
        self._put(struct.pack("<IIQQ" if wide else "<IIII", DESCRIPTOR, crc, size, size))
        self.members.append(self.open)
        self.open = None

    def close(self) -> None:
        start = self.at
        for raw, offset, crc, size in self.members:
            wide = self.zip64 or size >= FULL32 or offset >= FULL32
            extra = struct.pack("<HHQQQ", EXTRA64, 24, size, size, offset) if wide else b""
            n, o = (FULL32, FULL32) if wide else (size, offset)
            self._put(
                struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, STREAMED, 0, 0, 0x21, crc, n, n, len(raw), len(extra), 0, 0, 0, 0, o)
                + raw + extra
            )
        size, count = self.at - start, len(self.members)
        if self.zip64 or start >= FULL32 or size >= FULL32 or count >= FULL16:
            end = self.at
            self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, count, count, size, start))
            self._put(struct.pack("<IIQI", LOCATOR64, 0, end, 1))
            count, size, start = FULL16, FULL32, FULL32
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, count, count, size, start, 0))


@dataclass(frozen=True)
class Member:
    """A member as the central directory has it; ``header`` is the local header's offset."""

    name: str
    method: int
    flags: int
    crc: int
    packed: int
    size: int
    header: int


def directory(src: Ranges) -> list[Member]:
    """The members of a ZIP file, from its plain or ZIP64 central directory."""
    tail_at = max(0, src.size - 22 - FULL16)
    tail = src.read(tail_at, src.size - tail_at)
    at = len(tail) - 22
    while at >= 0:  # a comment may hold the signature; its length must fit
        if tail[at : at + 4] == struct.pack("<I", END) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at -= 1
    else:
        raise ValueError("no end of central directory: not a ZIP file, or cut short")
    disk, _, _, count, size, start, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
    if disk not in (0, FULL16):
        raise ValueError("a ZIP file in several parts")
    end = tail_at + at
    if FULL16 in (count,) or FULL32 in (size, start):
        signature, _, end64, _ = struct.unpack("<IIQI", src.read(end - 20, 20)) if end >= 20 else (0, 0, 0, 0)
        if signature == LOCATOR64:
            fields = struct.unpack("<IQHHIIQQQQ", src.read(end64, 56))
            if fields[0] != END64:
                raise ValueError("no ZIP64 end of central directory where its locator points")
            count, size, start = fields[7:]
    raw, out, at = src.read(start, size), [], 0
    for _ in range(count):
        head = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, at)
        if head[0] != CENTRAL:
            raise ValueError("the central directory is damaged")
        flags, method, crc, packed, full, n, m, k, offset = head[3], head[4], *head[7:13], head[16]
        name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        full, packed, offset = _wide(raw[at + 46 + n : at + 46 + n + m], full, packed, offset)
        out.append(Member(name, method, flags, crc, packed, full, offset))
        at += 46 + n + m + k
    return out


def _wide(extra: bytes, *values: int) -> list[int]:
    """The values, those that don't fit 32 bits taken from the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == EXTRA64:
            words = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return [next(words) if v == FULL32 else v for v in values]
        at += 4 + n
    return list(values)


def data_offset(src: Ranges, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method or member.flags & ENCRYPTED:
        raise ValueError(f"{member.name} is compressed or encrypted: no ranges of it can be read")
    head = struct.unpack("<IHHHHHIIIHH", src.read(member.header, 30))
    if head[0] != LOCAL:
        raise ValueError(f"{member.name} has no local header")
    return member.header + 30 + head[9] + head[10]


# --- WARC.


def _record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _line(value: object) -> str:
    """A header's value: control characters would end the line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _record_id(page_id), "WARC-Date": DATE,
        "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-Id": page_id,
        "WARC-Profile": PROFILE if revisit else None, "WARC-Refers-To": _record_id(refers_to) if revisit else None,
        "X-Refers-To-Page-Id": refers_to if revisit else None,
        "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {_line(v)}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers, by lower-case name, and the block of one WARC record."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("a WARC record cut short")
    return headers, rest[:size]


class ArchiveWriter:
    """Records into one archive: the records' member, then the index."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip, self.index = out, ZipWriter(out, zip64), []
        self.zip.begin(RECORDS)

    def add(self, data: bytes, **key) -> None:
        packed = gzip.compress(data, 4, mtime=0)
        self.index.append(json.dumps({"offset": self.zip.write(packed), "length": len(packed), **key}))

    def close(self) -> None:
        self.zip.end()
        self.zip.begin(INDEX)
        self.zip.write("\n".join(self.index).encode())
        self.zip.end()
        self.zip.close()
        self.out.close()


def read_index(src: Ranges) -> tuple[int, list[dict]]:
    """Where the records' member begins, and the entries of the index."""
    members = {m.name: m for m in directory(src)}
    index = members[INDEX]
    lines = src.read(data_offset(src, index), index.size)
    if zlib.crc32(lines) != index.crc:
        raise ValueError("the index is damaged")
    return data_offset(src, members[RECORDS]), [json.loads(x) for x in lines.splitlines()]


def read_records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every record of an archive, each by its own range."""
    with Ranges(path) as src:
        start, entries = read_index(src)
        for entry in entries:
            yield parsed(gzip.decompress(src.read(start + entry["offset"], entry["length"])))


# --- Spark.


def _typed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.filter(F.octet_length("payload") >= LEAST_REVISIT)
    copies = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = durable(copies.filter("n > 1").select(F.col("digest").alias("__digest"), "first"))
    joined = rows.join(hinted(copies, copies.count(), 80), F.col("digest") == F.col("__digest"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", revisit.alias("revisit"), F.col("first").alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    zip64: bool = False, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per row into archives under ``folder``; the manifest (path, records).

    Names are drawn anew by each attempt of a task, and only those of the
    attempt that ended are in the manifest, so a task may fail or run twice.
    """
    typed = _typed(pages, id_col, url_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, path, done = None, "", []
        for batch in batches:
            for page_id, url, payload, digest, revisit, refers_to in zip(*(c for c in batch.columns)):
                if writer is None:
                    path = f"{folder}/{uuid.uuid4().hex}.zip"
                    writer = ArchiveWriter(create(path), zip64)
                page = page_id.as_py()
                writer.add(
                    record(page, url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py(), revisit.as_py()), page=str(page)
                )
                if writer.zip.at >= archive_bytes or len(writer.index) >= ARCHIVE_RECORDS:
                    writer.close()
                    done.append((path, len(writer.index)))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((path, len(writer.index)))
        if done:
            paths, counts = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    return durable(typed.mapInArrow(run, "path string, records long"))


def read_archives(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """Per record page_id, payload_bytes, payload_digest, record_type, refers_to, and url.

    A response's digest is computed from its payload and must be the stored
    one; a revisit's length and digest are those its headers give.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for headers, block in read_records(path):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
                    if headers["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"a damaged payload in {path}")
                    rows.append((headers.get("x-page-id"), size, digest, headers["warc-type"], headers.get("x-refers-to-page-id"), headers.get("warc-target-uri")))
                    if len(rows) == 10_000:
                        yield _batch(rows, names)
                        rows = []
                if rows:
                    yield _batch(rows, names)

    spread = manifest.repartition(max(1, manifest.count()))
    raw = spread.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string")
    return raw.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` into archives in the shared folder and read them back.

    Nulls: null html is an empty payload, a null url leaves its header out, a
    null id stays null and is never referred to unless the copies have no
    other; then all are responses. Rows that repeat the largest id of equal
    payloads are responses, each. Extra columns are ignored; an empty table
    gives an empty result.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    make.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(make)
    id_type = pages.schema[id_col].dataType.simpleString()
    return read_archives(write_archives(pages, folder, id_col, url_col, html_col), id_type).drop("url")
