"""WARC records in seekable Zstandard bundles: independent frames, an index of records, a seek table at the end."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, filesystem, fresh_dir, sliced, texts_of, with_columns, written

#: Fixed values of the Zstandard seekable format: skippable frames, the seek table's frame and its footer.
SKIP_MAGIC, TABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 29
#: Payloads shorter than this are all written whole.
MIN_REVISIT_BYTES = 0
#: Repeated payloads, up to which their table is broadcast; beyond, the join shuffles.
REPEATS = 20_000
_PLAIN = "!$&'()*+,/:;=?@[]"
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(url: str, payload: bytes, digest: str, refers_to: str | None, key: str, date: str = DATE) -> bytes:
    """A response record, or a revisit of the record refers_to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{key}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower case), block and end of the record at an offset."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    begun = end + 4
    stop = begun + int(head["content-length"])
    return head, data[begun:stop], stop + 4


class BundleWriter:
    """Writes records to frames of about frame_bytes; close() appends the index and the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3) -> None:
        self.out, self.frame_bytes = out, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.held, self.size, self.written = [], 0, 0
        self.add("", b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC 1.1\r\n\r\n\r\n" % (str(uuid.uuid4()).encode(), DATE.encode()))

    def add(self, key: str, data: bytes) -> None:
        if self.size and self.size + len(data) > self.frame_bytes:
            self.flush()
        if key:
            self.index.append((key, len(self.frames), self.size, len(data)))
        self.held.append(data)
        self.size += len(data)

    def flush(self) -> None:
        if self.size:
            packed = self.pack.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> int:
        """Bytes of the whole bundle."""
        self.flush()
        index = self.pack.compress(json.dumps(self.index, separators=(",", ":")).encode())
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        for magic, body in ((SKIP_MAGIC, index), (TABLE_MAGIC, table)):
            self.out.write(struct.pack("<II", magic, len(body)) + body)
            self.written += 8 + len(body)
        self.out.close()
        return self.written


@dataclass
class Bundle:
    """A bundle that is open for random access."""

    file: object
    frames: list[tuple[int, int, int]]  # offset, compressed and plain size
    index: dict[str, tuple[int, int, int]]  # frame, offset in it, length

    @classmethod
    def open(cls, file, size: int) -> Bundle:
        def read(at: int, n: int) -> bytes:
            file.seek(at)
            return file.read(n)

        n, _, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        table, frames, at = read(size - 9 - 8 * n, 8 * n), [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", table, 8 * k)
            frames.append((at, packed, plain))
            at += packed
        magic, length = struct.unpack("<II", read(at, 8))
        if magic != SKIP_MAGIC:
            raise ValueError("no index of records")
        index = json.loads(zstandard.ZstdDecompressor().decompress(read(at + 8, length)))
        return cls(file, frames, {k: (f, o, size) for k, f, o, size in index})

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=plain)

    def read(self, key: str) -> tuple[dict[str, str], bytes]:
        """Headers and block of one record: one frame is read and unpacked."""
        k, at, _ = self.index[key]
        head, block, _ = parse(self.frame(k), at)
        return head, block

    def find(self, page_id: object) -> list[str]:
        """Identifiers of a page's records; None stands for a null page_id."""
        return [k for k in self.index if page_of(k) == (None if page_id is None else str(page_id))]


def key_of(page_id: str | None, row: int) -> str:
    """The identifier of a row's record: its page_id with signs that a header can't hold written as %XX, and the row's place."""
    return f"urn:x-page:{'' if page_id is None else '=' + quote(page_id, safe=_PLAIN)}#{row >> 33}-{row & ((1 << 33) - 1)}"


def page_of(key: str) -> str | None:
    """The page_id in an identifier, without the place of its row; null is told from the empty string."""
    page = key.removeprefix("urn:x-page:").rpartition("#")[0]
    return unquote(page[1:]) if page else None


def open_bundle(uri: str) -> Bundle:
    fs, path = filesystem(uri)
    file = fs.open_input_file(path)
    return Bundle.open(file, file.size())


def write_bundles(pages: DataFrame, uri: str | None = None, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html; other columns are left out) to bundles under uri and
    returns their manifest: uri, bytes, frames, records.

    Null html counts as empty, a null url as "urn:x-url:none". Of rows with equal payloads the one with the smallest page_id
    (null ids last; of repeated rows just one) is a response and the others revisit it. Each row's record has an identifier
    of its own, urn:x-page:=<page_id>#<partition>-<row> (ids of any type; signs that a
    header can't hold as %XX), however often a page_id or null is repeated, and a revisit refers to
    its response by that; Bundle.find gives the identifiers of a page. No rows give no bundles.

    Payloads are compared by SHA-1 and length: a scan with partial sums finds the repeated ones, and a join tells their rows.
    pages must be a stored table, which gives the same row numbers in both scans. Each attempt of a task writes files of its
    own; the manifest, which Spark commits once a task, names those that count."""
    spark = pages.sparkSession
    uri = uri or fresh_dir(spark, "warc")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("urn:x-url:none")).alias("url"), html.alias("html"), F.monotonically_increasing_id().alias("__row"))
    rows = rows.withColumn("__digest", F.unhex(F.sha1("html"))).withColumn("__size", F.octet_length("html"))
    place = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page_id"), F.col("__row").alias("row"))
    repeats = rows.where(F.col("__size") >= min_revisit_bytes).groupBy("__digest", "__size").agg(F.min(place).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    repeats = bounded(written(repeats.select("__digest", "__size", "__first"), "warc-repeats"), REPEATS)
    typed = rows.join(repeats, ["__digest", "__size"], "left").select(
        F.col("page_id").cast("string").alias("page_id"),
        "url",
        "html",
        (F.col("__first").isNotNull() & (F.col("__first.row") != F.col("__row"))).alias("__revisit"),
        F.col("__row"),
        F.col("__first.page_id").cast("string").alias("__to"),
        F.col("__first.row").alias("__to_row"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(uri)
        fs.create_dir(path, recursive=True)
        task, begun, done = TaskContext.get().partitionId(), None, []

        def close() -> None:
            done.append((name, begun.close(), len(begun.frames), len(begun.index)))

        for b in sliced(batches, "html", 1 << 22):
            for payload, page, url, revisit, row, to, to_row in zip(texts_of(b, "html"), *(b.column(c).to_pylist() for c in ("page_id", "url", "__revisit", "__row", "__to", "__to_row")), strict=True):
                if begun and begun.written > bundle_bytes:
                    close()
                    begun = None
                if not begun:
                    name = f"{uri}/{task:06d}-{len(done):03d}-{uuid.uuid4().hex}.warc.zst"
                    begun = BundleWriter(fs.open_output_stream(filesystem(name)[1], compression=None), frame_bytes)
                key = key_of(page, row)
                begun.add(key, record(url.replace("\r", "%0D").replace("\n", "%0A"), payload, payload_digest(payload), key_of(to, to_row) if revisit else None, key))
        if begun:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["uri", "bytes", "frames", "records"])

    fields = [T.StructField("uri", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("bytes", "frames", "records"))]
    return written(with_columns(typed, run, fields), "warc-manifest")


def read_bundles(manifest: DataFrame) -> DataFrame:
    """page_id (string), url, record_type, payload_bytes, payload_digest, refers_to (string) of every record of the bundles.

    Size and digest of a response are those of its payload as read. A revisit has no payload: its size stands in its HTTP
    header and its digest in its WARC header. A page_id that was null is null again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                bundle = open_bundle(uri)
                at: dict[int, list[tuple[int, str]]] = {}
                for key, (k, offset, _) in bundle.index.items():
                    at.setdefault(k, []).append((offset, key))
                for k, found in at.items():
                    data, out = bundle.frame(k), []
                    for offset, key in found:
                        head, block, _ = parse(data, offset)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        if head["warc-record-id"] != f"<{key}>":
                            raise ValueError(f"{uri}: {key} isn't at its offset")
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        size, to = len(payload), None
                        if head["warc-type"] == "revisit":
                            size = int(http.rpartition(b"Content-Length: ")[2])
                            to = page_of(head["warc-refers-to"][1:-1])
                        elif (own := payload_digest(payload)) != digest:
                            raise ValueError(f"{uri}: {key} has the digest {own}, not {digest}")
                        out.append((page_of(key), head["warc-target-uri"], head["warc-type"], size, digest, to))
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=names)

    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    fields = [T.StructField(n, T.LongType() if n == "payload_bytes" else T.StringType()) for n in names]
    return with_columns(manifest.select("uri").repartition(max(1, manifest.count())), run, fields)


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = pages.schema["page_id"].dataType
    back = read_bundles(write_bundles(pages))
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def warc_sql(pages: str = "pages") -> str:
    """The same rows in DuckDB's SQL; base32 by groups of five hexadecimal digits."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    char = lambda shift: f"substr('{alphabet}', ((CAST('0x' || substr(h, 5 * i + 1, 5) AS INTEGER) >> {shift}) & 31) + 1, 1)"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM {pages}),
r AS (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS n,
             first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(8), lambda i: {' || '.join(map(char, (15, 10, 5, 0)))}), '') AS payload_digest,
       CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN first END AS refers_to
FROM r"""
