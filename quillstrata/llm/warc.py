"""WARC archives: one gzip member per record, written and read back sequentially.

The writer gives each task its own files in a shared folder and rolls over at a size limit; only files in the returned manifest, which
Spark commits, count, so files of lost or repeated tasks are ignored. The reader streams a file in blocks: incremental zlib
decompression, content-length framing, and digest verification of block and payload, holding one block at a time.

Of pages with equal payloads of at least ``least`` bytes, the one with the largest key is a response and the others are revisits that
refer to it; smaller payloads are all responses.

Cases: null html is an empty payload; a null key is written as an empty id and never referred to while its payload has a
non-null key (else all of them are responses); rows that share the largest key are all responses; a null url has no target header; control characters in a
url, and all but plain characters in a key, are percent-encoded; an empty table gives an empty manifest. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.llm.common import shared_folder, stored, utf8
from quillstrata.plans.skew import HEAVY_ROWS, lookup

GZIP = 31
READ_BYTES = 1 << 16
# Tasks that read archives: beyond as many files a task reads several, one after another.
READ_TASKS = 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "record_type string, page string, refers_to string, uri string, declared_digest string, "
    "payload_bytes bigint, payload_digest string, verified boolean, payload binary"
)


def _sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _digest_hex(label: str) -> str:
    return base64.b32decode(label.partition(":")[2]).hex()


def record_bytes(page: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record: header, blank line, block, two line ends. A revisit has no payload in its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    header = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{quote(page, safe='')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: {_sha1_label(hashlib.sha1(block).digest())}",
        f"WARC-Payload-Digest: {_sha1_label(bytes.fromhex(digest))}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        header.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        header += [f"WARC-Refers-To: <urn:page:{quote(refers_to, safe='')}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(header).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes, level: int = 6) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return pack.compress(record) + pack.flush()


def write_archives(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    least: int = 1000,
    max_file_bytes: int = 64 << 20,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Write a record per row under ``folder``; returns the manifest (path, records, bytes)."""
    payload = utf8(F.col(html))
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), payload.alias("payload")).select(
        "*", F.sha1("payload").alias("digest"), F.unhex(F.sha2("payload", 256)).alias("content")
    )
    # Who refers to whom is settled on keys and digests; each payload then moves once at most, by its own key.
    named = stored(rows.where(F.octet_length("payload") >= least).select("key", "content"), "payloads")
    first = named.groupBy("content").agg(F.max("key").alias("response"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    revisits = (
        lookup(named, first, ["content"], "key", named.count(), heavy_rows).where(F.col("response").isNotNull() & ~F.col("key").eqNullSafe(F.col("response")))
        .select("key", "content", "response").distinct()
    )
    r, v = rows.alias("r"), stored(revisits, "revisits").alias("v")
    typed = r.join(v, F.expr("r.key <=> v.key and r.content = v.content"), "left").select(
        F.coalesce(F.col("r.key").cast("string"), F.lit("")).alias("page"),
        "r.url", "r.payload", "r.digest", F.col("v.response").cast("string").alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        done, out, name, count, size = [], None, "", 0, 0
        for batch in batches:
            for row in (dict(zip(batch.schema.names, values)) for values in zip(*[_items(c) for c in batch.columns])):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}")
                member = gzip_member(record_bytes(**row))
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= max_file_bytes:
                    out.close()
                    done, out = [*done, (f"{folder}/{name}", count, size)], None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count, size))
        path, records, size = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(path, pa.string()), pa.array(records, pa.int64()), pa.array(size, pa.int64())], ["path", "records", "bytes"]
        )

    return stored(typed.select("page", "url", "payload", "digest", "refers_to").mapInArrow(write, "path string, records bigint, bytes bigint"), "manifest")


def _items(column: pa.Array) -> Iterator:
    """Python values one at a time, so that a batch is never held twice."""
    return (x.as_py() for x in column)


@dataclass
class Record:
    header: dict[str, str]
    http: bytes
    payload: bytes | None
    payload_bytes: int
    payload_sha1: str
    verified: bool


class ArchiveReader:
    """Records of a stream, one gzip member each. Raises ValueError on a broken frame."""

    def __init__(self, stream, keep_payload: bool = False):
        self.stream, self.keep_payload = stream, keep_payload
        self.compressed, self.plain, self.inflate = b"", bytearray(), None

    def _more(self) -> bool:
        """Inflate a little more of the current member; False at its end."""
        while self.inflate is not None and not self.inflate.eof:
            if not self.compressed:
                self.compressed = bytes(self.stream.read(READ_BYTES))
                if not self.compressed:
                    raise ValueError("archive ends inside a record")
            found = self.inflate.decompress(self.compressed, READ_BYTES)
            self.compressed = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if found:
                self.plain += found
                return True
        return False

    def _until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.plain.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.plain)
            if not self._more():
                raise ValueError("record without a complete header")
        head = bytes(self.plain[:at])
        del self.plain[: at + len(mark)]
        return head

    def _take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.plain and not self._more():
                raise ValueError("record shorter than its content length")
            piece = bytes(self.plain[:size])
            del self.plain[: len(piece)]
            size -= len(piece)
            yield piece

    def __iter__(self) -> Iterator[Record]:
        while True:
            if not self.compressed:
                self.compressed = bytes(self.stream.read(READ_BYTES))
            if not self.compressed:
                return
            self.inflate = zlib.decompressobj(GZIP)
            yield self._record()

    def _record(self) -> Record:
        version, *lines = self._until(b"\r\n\r\n").decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:20]}")
        header = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        block, payload = hashlib.sha1(), hashlib.sha1()
        http, body, kept, size = bytearray(), False, [], 0
        for piece in self._take(int(header["content-length"])):
            block.update(piece)
            if not body:
                http += piece
                at = http.find(b"\r\n\r\n")
                if at < 0:
                    continue
                body, piece = True, bytes(http[at + 4 :])
                del http[at + 4 :]
            payload.update(piece)
            size += len(piece)
            if self.keep_payload:
                kept.append(piece)
        if b"".join(self._take(4)) != b"\r\n\r\n" or self._more() or self.plain:
            raise ValueError("record longer than its content length")
        right = header.get("warc-block-digest") in (None, _sha1_label(block.digest()))
        if header["warc-type"] == "response":
            right &= header.get("warc-payload-digest") in (None, _sha1_label(payload.digest()))
        return Record(header, bytes(http), b"".join(kept) if self.keep_payload else None, size, payload.hexdigest(), right)


def read_archives(manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """A row per record of the manifest's files: RECORD_SCHEMA. One task per file; a file has a size limit."""

    def unwrap(label: str | None) -> str | None:
        return None if label is None else unquote(label.removeprefix("<urn:page:").removesuffix(">"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch["path"].to_pylist():
                store, path = pafs.FileSystem.from_uri(uri)
                with store.open_input_stream(path) as stream:
                    rows, held = [], 0
                    for r in ArchiveReader(stream, keep_payload):
                        h, revisit = r.header, r.header["warc-type"] == "revisit"
                        rows.append(
                            (
                                h["warc-type"], unwrap(h["warc-record-id"]), unwrap(h.get("warc-refers-to")), h.get("warc-target-uri"),
                                _digest_hex(h["warc-payload-digest"]), None if revisit else r.payload_bytes,
                                None if revisit else r.payload_sha1, r.verified, None if revisit else r.payload,
                            )
                        )
                        held += len(r.payload or b"") + 500
                        if held > 4 << 20:
                            yield _records(rows)
                            rows, held = [], 0
                    yield _records(rows)

    tasks = max(1, min(manifest.count(), READ_TASKS))
    return manifest.select("path").repartition(tasks).mapInArrow(read, RECORD_SCHEMA)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    names = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Give each revisit the payload size and digest of the response it refers to, verified against its own declared digest."""
    responses = records.where(F.col("record_type") == "response")
    revisits = records.where(F.col("record_type") == "revisit")
    # Rows that share a key may be several responses: the declared digest picks the right one.
    found = responses.select(
        F.col("page").alias("refers_to"), F.col("payload_digest").alias("declared_digest"), F.col("payload_bytes").alias("size")
    ).distinct()
    filled = revisits.join(found, ["refers_to", "declared_digest"], "left").select(
        "record_type", "page", "refers_to", "uri", "declared_digest",
        F.col("size").alias("payload_bytes"),
        F.when(F.col("size").isNotNull(), F.col("declared_digest")).alias("payload_digest"),
        (F.col("verified") & F.col("size").isNotNull()).alias("verified"),
    )
    return responses.drop("payload").unionByName(filled)


def archive_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> DataFrame:
    """Write the pages and read them back: (key, payload_bytes, payload_digest, record_type, refers_to, verified)."""
    spark: SparkSession = pages.sparkSession
    manifest = write_archives(pages, folder or shared_folder(spark, "warc"), key, url, html)
    kind = dict(pages.dtypes)[key]
    records = resolve_revisits(stored(read_archives(manifest).drop("payload"), "records").withColumn("payload", F.lit(None).cast("binary")))
    page = F.when(F.col("page") != "", F.col("page")).cast(kind)
    return records.select(
        page.alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "verified"
    )
