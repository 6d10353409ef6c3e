"""WARC archives as a Python data source: a writer with one gzip member per record, and a reader.

Each member's gzip header has the customary extra field 'sl' with the member's compressed and plain
length, so the reader finds the next record without inflating this one. The reader plans one
partition per archive of bounded size, takes predicates on record type and header fields from Spark,
inflates a record's first kilobytes to parse its headers, and leaves unwanted payloads compressed.
Files count only once the driver has listed them in a manifest, so failed or repeated tasks do no harm.

Archives of other makers are read as well: without a manifest all .warc and .warc.gz files count, members
need no extra field (then what is skipped has to be inflated, but is not kept), and a file may be
plain (then payloads are skipped by seeking).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

from .common import bounded_batches, new_folder

SCHEMA = "record_type string, page_id long, target_uri string, refers_to long, payload_bytes long, payload_digest string, record_id string, payload binary"
NAMES = ["record_type", "page_id", "target_uri", "refers_to", "payload_bytes", "payload_digest", "record_id", "payload"]
KINDS = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
ID = "urn:trackspark:page:"
BREAK = b"\r\n\r\n"
MANIFEST = "_manifest.json"
#: Shortest payload, in bytes, that a revisit record may stand for.
LEAST_REVISIT = 1000
#: Parts that the rows of one payload are dealt to.
SALT = 32


def _filesystem(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])


def member(record: bytes, level: int = 6) -> bytes:
    """The record as one gzip member with the extra field sl."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    extra = struct.pack("<2sHII", b"sl", 8, 12 + 12 + len(body) + 8 & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return struct.pack("<4BIBBH", 0x1F, 0x8B, 8, 4, 0, 0, 255, len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + BREAK
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>"]
    head += [f"WARC-Target-URI: {quote(url, safe=_URL)}"] if url is not None else []
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + BREAK + block + BREAK


#: Printable ASCII stays as it is in a URI; white space, controls and other characters are escaped.
_URL = "".join(map(chr, range(0x21, 0x7F)))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.date = options["path"], options.get("date", "2024-01-01T00:00:00Z")
        self.most = int(options.get("maxfilebytes", 1 << 26))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = _filesystem(self.path)
        fs.create_dir(path, recursive=True)
        out, done, size = None, Written(), 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                        info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Date: {self.date}\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nContent-Type: application/warc-fields\r\nContent-Length: 0".encode()
                        out.write(member(info + BREAK + BREAK))
                    one = member(record(row["page_id"], row["url"], row["payload"], row["digest"], row["record_type"], row["refers_to"], self.date))
                    out.write(one)
                    size += len(one)
                    if size >= self.most:
                        out.close()
                        done.files.append((name, size))
                        out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.files.append((name, size))
        return done

    def commit(self, messages: list) -> None:
        fs, path = _filesystem(self.path)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list) -> None:
        fs, path = _filesystem(self.path)
        for name in [f for m in messages if m for f, _ in m.files]:
            fs.delete_file(f"{path}/{name}")


@dataclass
class Archive(InputPartition):
    name: str


_TESTS = {
    EqualTo: lambda x, v: x == v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: x in v,
    StringStartsWith: lambda x, v: x.startswith(v),
}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.mode, self.tests = options["path"], options.get("payload", "full"), []
        if self.mode not in ("full", "verify", "skip"):
            raise ValueError("payload must be full, verify or skip")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute[0] in NAMES[:-1] and len(f.attribute) == 1:
                self.tests.append((NAMES.index(f.attribute[0]), type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Archive]:
        fs, path = _filesystem(self.path)
        kind = fs.get_file_info(f"{path}/{MANIFEST}").type.name
        if kind == "File":
            with fs.open_input_stream(f"{path}/{MANIFEST}", compression=None) as f:
                return [Archive(name) for name, _ in json.loads(f.read())]
        from pyarrow.fs import FileSelector

        found = fs.get_file_info(FileSelector(path, allow_not_found=True))
        return [Archive(x.base_name) for x in sorted(found, key=lambda x: x.base_name) if x.type.name == "File" and x.base_name.endswith((".warc", ".warc.gz"))]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way to say that there are no partitions
            return
        fs, path = _filesystem(self.path)
        rows, size = [], 0
        with fs.open_input_file(f"{path}/{partition.name}") as f:
            head = f.read(24)
            f.seek(0)
            if head[:2] != b"\x1f\x8b":
                found = self._streamed(io.BufferedReader(f), True)
            elif head[3:4] == b"\x04" and head[12:14] == b"sl":
                found = self._members(io.BufferedReader(f, 1 << 20), partition.name)
            else:
                found = self._streamed(io.BufferedReader(gzip.GzipFile(fileobj=f)), False)
            for row, cost in found:
                if self._wanted(row):
                    rows.append(row)
                    size += cost
                if len(rows) >= 10_000 or size > 1 << 24:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _wanted(self, row: tuple) -> bool:
        return all(row[k] is not None and _TESTS[t](row[k], v) for k, t, v in self.tests)

    def _members(self, f: io.BufferedReader, name: str) -> Iterator[tuple[tuple, int]]:
        """The rows of an archive whose members tell their lengths."""
        while head := f.read(24):
            if head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"sl":
                raise ValueError(f"{name}: a member without the extra field sl after some with it")
            (length,) = struct.unpack("<I", head[16:20])
            yield self._row(f.read(length - 24))

    @staticmethod
    def _head(lines: Iterable[str]) -> tuple[str, tuple]:
        """The type of a record, and its page, URI, page referred to, digest (hexadecimal) and id, from its
        header lines."""
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        number = lambda k: int(x) if (x := fields.get(k, "")[1:-1]).startswith(ID) and (x := x[len(ID) :]).lstrip("-").isdigit() else None
        scheme, _, digest = fields.get("warc-payload-digest", "").partition(":")
        if scheme.lower() != "sha1":
            digest = None
        elif len(digest) == 32:  # the customary base 32
            digest = base64.b32decode(digest.upper()).hex()
        name = fields.get("warc-record-id", "").strip("<>") or None
        return fields.get("warc-type", ""), (number("warc-record-id"), fields.get("warc-target-uri"), number("warc-refers-to"), digest and digest.lower(), name, fields)

    def _streamed(self, f: io.BufferedReader, seekable: bool) -> Iterator[tuple[tuple, int]]:
        """The rows of a plain archive, or one in members of any kind, record by record."""
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record begins with {line[:40]!r}")
            lines = []
            while (line := f.readline()).strip():
                if line[:1] in b" \t" and lines:  # a folded line
                    lines[-1] += " " + line.decode("utf-8", "replace").strip()
                else:
                    lines.append(line.decode("utf-8", "replace"))
            kind, (page, uri, refers, digest, name, fields) = self._head(lines)
            left, told, http = int(fields["content-length"]), None, fields.get("content-type", "").lower().startswith("application/http")
            if http and kind in ("response", "revisit"):
                while left > 0:
                    line = f.readline(left)
                    left -= len(line)
                    field_, _, value = line.partition(b":")
                    if field_.lower() == b"content-length" and value.strip().isdigit():
                        told = int(value)
                    if not line.strip():
                        break
            whole = kind in ("response", "resource", "conversion")
            row = (kind, page, uri, refers, left if whole else told if kind == "revisit" else None, digest, name)
            if self.mode != "skip" and whole and self._wanted(row):
                payload = f.read(left)
                if len(payload) < left:
                    raise ValueError(f"record {name} is cut short")
                if self.mode == "verify" and digest and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"record {name}: the payload is not that of its headers")
                yield (*row, payload if self.mode == "full" else None), left
                continue
            if seekable:
                f.seek(left, io.SEEK_CUR)
            while not seekable and left > 0:
                left -= len(part) if (part := f.read(min(left, 1 << 20))) else left
            yield (*row, None), 0

    def _row(self, packed: bytes) -> tuple[tuple, int]:
        inflate = zlib.decompressobj(-15)
        text = inflate.decompress(packed, 2048)
        while BREAK not in text and not inflate.eof:
            text += inflate.decompress(inflate.unconsumed_tail, 1 << 16)
        head, text = text.split(BREAK, 1)
        kind, (page, uri, refers, digest, name, _) = self._head(head.decode().split("\r\n")[1:])
        if kind == "warcinfo":
            return (kind, None, None, None, None, None, name, None), 0
        while BREAK not in text and not inflate.eof:
            text += inflate.decompress(inflate.unconsumed_tail, 1 << 16)
        http, text = text.split(BREAK, 1)
        bytes_ = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
        row = (kind, page, uri, refers, bytes_, digest, name)
        if self.mode == "skip" or kind == "revisit" or not self._wanted(row):
            return (*row, None), 0
        payload = (text + inflate.decompress(inflate.unconsumed_tail) + inflate.flush())[: -len(BREAK)]
        if len(payload) != bytes_ or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"page {row[1]}: the payload is not that of its headers")
        return (*row, payload if self.mode == "full" else None), len(payload)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)


class WarcDataSource(DataSource):
    """spark.read / df.write .format("warc"); options path, payload (full, verify, skip), maxFileBytes, date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()})


def write_archives(pages: DataFrame, folder: str, max_file_bytes: int = 1 << 26) -> None:
    """Writes a record per row of pages (page_id, url, html) below the new folder.

    Of rows with equal payloads of at least 1000 bytes, the one with the largest page_id is a
    response and the others are revisits that refer to it; all others are responses. Null html is
    an empty payload, a null url has no Target-URI field, other columns are ignored. Repeated rows
    are written as often as they occur; those with the largest page_id all are responses.
    """
    bounded_batches(pages.sparkSession)
    pages.sparkSession.dataSource.register(WarcDataSource)
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    # short payloads get a key of their own, so that a frequent one makes no hot key
    key = F.when(F.octet_length("payload") >= LEAST_REVISIT, F.col("digest")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("key", key)
    last = rows.where(~F.col("key").startswith("#")).groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("key", "last")
    # a page that a third of all rows repeat is dealt to so many tasks, payloads and all
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    last = last.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    revisit = F.coalesce(F.col("last") != F.col("page_id"), F.lit(False))
    rows = rows.join(last, ["key", "salt"], "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to")
    )
    rows.write.format("warc").mode("append").option("path", folder).option("maxFileBytes", max_file_bytes).save()


def read_archives(spark: SparkSession, folder: str, payload: str = "full") -> DataFrame:
    """The records of the archives: record_type, page_id, target_uri, refers_to, payload_bytes,
    payload_digest, record_id, payload (null for revisits and unless payload="full"; "verify" still checks it).

    The folder holds archives of write_archives, or any .warc and .warc.gz files: one member a record or
    one for all, or plain; page_id and refers_to are null there. The payload of a response is what follows
    its HTTP headers, as it stands (transfer and content codings stay); that of resource and
    conversion records is the whole block; payload_bytes of a revisit is what its HTTP headers tell, of
    other records null. Digests other than sha1 are null, base 32 becomes hexadecimal. A record that is
    cut short, or begins with something else than WARC/, is an error.
    Predicates on all columns but payload are pushed into the reader, which Spark does only with
    spark.sql.python.filterPushdown.enabled; it is set for the session. No records give no rows."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("path", folder).option("payload", payload).load()


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages below the shared folder and reads the page records back, payloads verified."""
    folder = new_folder(pages.sparkSession, "warc")
    write_archives(pages, folder)
    return read_archives(pages.sparkSession, folder, "verify").where(F.col("record_type").isin("response", "revisit"))
