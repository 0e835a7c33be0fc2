"""WARC records in ZIP packages: written, indexed and range-read without extraction.

A package holds ``archive/data.warc.gz`` (each record a gzip member of its own),
``indexes/index.cdxj`` (for each record its key, offset and length) and
``datapackage.json``, all stored without compression, so that the package's
bytes hold the records' bytes. The reader finds the end record, the ZIP64
locator and directory where there are any, and each member's place; it then
takes the index and reads single records by their ranges.

Packages are rows (name, content) in a table of the shared folder: executors
have no other store that all of them reach. A package closes at about
``PACKAGE_BYTES``, so a task never holds more.

Of records with equal payloads that with the largest page_id is a response and
the others revisit it. Cases: a null html is an empty payload; a row that
repeats the largest page_id with the same payload is a response too; a row with
a null page_id revisits the largest, or is a response where all are null. Null
urls are left out of the record. Very long pages are records like any other.
Other columns are ignored, whatever their names. An empty table gives no rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, few, in_batches, stored, table

PACKAGE_BYTES = 8 << 20
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Signatures of the ZIP format.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _plain(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the payload's headers but not its bytes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {_plain(url)}"] if url else []
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _key(url: str | None) -> str:
    """Host labels reversed, then the path: the order that web indexes use."""
    try:
        parts = urlsplit(_plain(url or ""))
        host = parts.hostname or ""
    except ValueError:
        return _plain(url or "") + ")"
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


class Package:
    """Collects records and closes into one ZIP package."""

    def __init__(self) -> None:
        self.data, self.lines = io.BytesIO(), []

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> None:
        raw, at = gzip.compress(record(page_id, url, payload, refers_to, revisit), 6, mtime=0), self.data.tell()
        self.data.write(raw)
        self.lines.append(f"{_key(url)} 20240101000000 {json.dumps({'id': page_id, 'offset': at, 'length': len(raw), 'filename': 'data.warc.gz'})}")

    def close(self, zip64: bool = False) -> bytes:
        out = io.BytesIO()
        index = "".join(f"{x}\n" for x in sorted(self.lines)).encode("utf-8", "surrogatepass")
        about = json.dumps({"profile": "data-package", "resources": [{"path": p, "bytes": n} for p, n in ((RECORDS, self.data.tell()), (INDEX, len(index)))]})
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, content in ((RECORDS, self.data.getvalue()), (INDEX, index), ("datapackage.json", about.encode())):
                with z.open(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=zip64) as f:
                    f.write(content)
        return out.getvalue()


class Archive:
    """A package read by ranges: ``read(offset, length)`` is all it needs of the store."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size = read, size
        self.members = self._directory()

    def _directory(self) -> dict[str, tuple[int, int, int, int]]:
        """Member name to (method, compressed size, size, local header offset)."""
        base = max(0, self.size - 65_557)
        tail = self.read(base, self.size - base)
        at = tail.rfind(END)
        if at < 0:
            raise ValueError("no ZIP end record")
        count, size, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
            (where,) = struct.unpack("<Q", tail[at - 12 : at - 4])
            end64 = self.read(where, 56)
            if end64[:4] != END64:
                raise ValueError("no ZIP64 end record")
            count, size, start = struct.unpack("<QQQ", end64[32:56])
        table_, i, out = self.read(start, size), 0, {}
        for _ in range(count):
            if table_[i : i + 4] != ENTRY:
                raise ValueError("broken ZIP directory")
            flags, method = struct.unpack("<HH", table_[i + 8 : i + 12])
            packed, whole, n, m, k = struct.unpack("<IIHHH", table_[i + 20 : i + 34])
            (offset,) = struct.unpack("<I", table_[i + 42 : i + 46])
            name = table_[i + 46 : i + 46 + n].decode("utf-8" if flags >> 11 & 1 else "cp437")
            extra, j = table_[i + 46 + n : i + 46 + n + m], 0
            while j + 4 <= len(extra):
                tag, length = struct.unpack("<HH", extra[j : j + 4])
                if tag == 1:
                    wide = list(struct.unpack(f"<{length // 8}Q", extra[j + 4 : j + 4 + length // 8 * 8]))
                    whole = wide.pop(0) if whole == 0xFFFFFFFF else whole
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
                j += 4 + length
            out[name] = (method, packed, whole, offset)
            i += 46 + n + m + k
        return out

    def begin(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        method, _, _, offset = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed and can't be range-read")
        head = self.read(offset, 30)
        if head[:4] != LOCAL:
            raise ValueError("broken ZIP member")
        n, m = struct.unpack("<HH", head[26:30])
        return offset + 30 + n + m

    def index(self) -> list[dict]:
        raw = self.read(self.begin(INDEX), self.members[INDEX][1])
        return [json.loads(x.split(" ", 2)[2]) for x in raw.decode("utf-8", "surrogatepass").splitlines()]

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """Every indexed record's headers and block, each by one range read."""
        begin, size = self.begin(RECORDS), self.members[RECORDS][1]
        for line in self.index():
            if line["offset"] + line["length"] > size:
                raise ValueError("an index range lies beyond its member")
            raw = zlib.decompress(self.read(begin + line["offset"], line["length"]), 31)
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
            block = rest[: int(fields["Content-Length"])]
            if len(block) != int(fields["Content-Length"]):
                raise ValueError("a record is cut short")
            yield fields, block


def read_record(fields: dict[str, str], block: bytes) -> dict:
    """A page's row from its record; a response's payload is held against its digest."""
    number = lambda x: int(x[len("<urn:page:") : -1]) if len(x) > len("<urn:page:>") else None
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or digest(payload) != stated):
        raise ValueError("a payload doesn't match its digest")
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": stated, "record_type": fields["WARC-Type"], "refers_to": None if response else number(fields["WARC-Refers-To"]), "payload": payload if response else None}


@in_batches
def write_packages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """(name, content): the pages' records in packages, in the shared folder.

    The largest page_id of each payload comes from partial maxima, so a payload
    with many copies reaches one task as a row from each task that read it. Only
    payloads that occur twice or more are joined back, by broadcast up to a
    counted number of them; pages are then packed where they are read."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    # Written first, so that a join beyond the broadcast may split the rows of one payload with many copies.
    twice = stored(rows.groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper")).where("n > 1").select("sha", "keeper", F.lit(True).alias("shared")))
    keeper = F.when(F.col("shared"), F.col("keeper")).otherwise(F.col("page_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = Package()

        def closed() -> pa.RecordBatch:
            content = package.close()
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(content).hexdigest()[:32] + ".wacz"]), pa.array([content], pa.binary())], names=["name", "content"])

        for batch in bounded(batches, "html"):
            for page_id, url, html, keeper in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "keeper")), strict=True):
                package.add(page_id, url, html.encode("utf-8", "surrogatepass"), keeper, page_id != keeper)
                if package.data.tell() >= package_bytes:
                    yield closed()
                    package = Package()
        if package.lines:
            yield closed()

    kept = rows.join(few(twice), "sha", "left").select("page_id", "url", "html", keeper.alias("keeper"))
    return stored(kept.mapInArrow(run, "name string, content binary"))


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


@in_batches
def read_packages(packages: DataFrame) -> DataFrame:
    """A row for each record of the packages (name, content), payloads of responses included."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                whole = memoryview(content.as_buffer())
                archive, rows = Archive(lambda at, n, whole=whole: bytes(whole[at : at + n]), len(whole)), []
                for fields, block in archive.records():
                    rows.append(read_record(fields, block))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return packages.select("content").mapInArrow(run, READ)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to packages and read back from them."""
    back = read_packages(write_packages(table(spark, sf_dir, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, (unhex(sha1(html))::BIT)::VARCHAR AS b, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * substr(b, 5*i+1, 1)::INT + 8 * substr(b, 5*i+2, 1)::INT + 4 * substr(b, 5*i+3, 1)::INT
           + 2 * substr(b, 5*i+4, 1)::INT + substr(b, 5*i+5, 1)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d
"""
