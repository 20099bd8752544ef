"""WARC archives as a Python data source: spark.read.format("warc") and df.write.format("warc").

Reading: the driver plans one partition per archive file. A task parses the WARC headers of a record first and
compares them with the pushed predicates on record_type, record_id, target_uri, date, payload_digest and refers_to; the block
of a record that fails is skipped, and with option payload=false no payload is decoded at all.

Writing: each task writes one gzip member per record into a file of its own name and the
driver's commit lists the files that count, so a repeated or lost task leaves no double records.
Folders can be in any store that pyarrow's file systems open.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

from tidemark.functions.stage import maybe_broadcast, stage_dir
from tidemark.llm.common import pick, written

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string, "
    "payload_length bigint, refers_to string, payload binary"
)
# The WARC header of each column that predicates can be checked on before the block is read.
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
MANIFEST = "_committed.json"
FETCHED = "2024-01-31T00:00:00Z"
BATCH_BYTES = 8_000_000
CHUNK = 1 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else fs.FileSystem.from_uri(f"file:///{path.removeprefix('file:').lstrip('/')}")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(row: dict) -> bytes:
    """One record: WARC headers, then an HTTP response whose body a revisit leaves out."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", row["record_id"]),
        ("WARC-Date", row["date"]),
        ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Refers-To", row["refers_to"] if revisit else None),
        ("WARC-Profile", REVISIT if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in head if v is not None)  # a header is one line
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    file: str
    records: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        name, n = f"part-{uuid.uuid4().hex}.warc.gz", 0
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for batch in iterator:
                for i in range(batch.num_rows):  # one row at a time: a batch of payloads is not copied as a whole
                    row = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(packer.compress(record_bytes(row)) + packer.flush())
                    n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        files = sorted(m.file for m in messages if m is not None and m.records)
        with store.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{folder}/{m.file}")


@dataclass
class ArchiveFile(InputPartition):
    file: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.wanted = path, payload, []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                kind, value = type(f).__name__, f.value
                self.wanted.append((f.attribute[0], kind, tuple(value) if kind == "In" else value))
            else:
                yield f

    def partitions(self) -> list[ArchiveFile]:
        from pyarrow import fs

        store, folder = _store(self.path)
        info = store.get_file_info(folder)
        if info.type == fs.FileType.File:
            return [ArchiveFile(folder)]
        names = {f.base_name: f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File}
        if MANIFEST in names:  # written here: only files of the committed tasks
            with store.open_input_stream(names[MANIFEST]) as src:
                return [ArchiveFile(names[n]) for n in json.loads(src.read())]
        return [ArchiveFile(p) for n, p in sorted(names.items()) if n.endswith((".warc", ".warc.gz"))]

    def _passes(self, values: dict) -> bool:
        for column, kind, wanted in self.wanted:
            have = values[column]
            if have is None or not (have == wanted if kind == "EqualTo" else have in wanted if kind == "In" else have.startswith(wanted)):
                return False
        return True

    def read(self, partition: ArchiveFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without archives
            return
        store, _ = _store(self.path)
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        kinds = [pa.int64() if n == "payload_length" else pa.binary() if n == "payload" else pa.string() for n in names]
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

        with store.open_input_file(partition.file) as raw:
            plain = raw.read(2) != b"\x1f\x8b"
            raw.seek(0)
            src = io.BufferedReader(raw if plain else gzip.GzipFile(fileobj=raw), CHUNK)
            while (headers := read_headers(src)) is not None:
                left = int(headers.get("content-length", 0))
                values = {c: headers.get(h) for c, h in HEADERS.items()}
                values["payload_digest"] = (values["payload_digest"] or "").rpartition(":")[2] or None
                if not self._passes(values):
                    _skip(src, left)
                    continue
                row = values | {"payload_length": left, "payload": None}
                if "http" in headers.get("content-type", ""):
                    http, used = read_http(src, left)
                    left -= used
                    row["payload_length"] = int(http.get("content-length", 0)) if values["record_type"] == "revisit" else left
                if self.payload and values["record_type"] != "revisit":
                    row["payload"] = src.read(left)
                else:
                    _skip(src, left)
                rows.append(row)
                size += 500 + len(row["payload"] or b"")
                if size > BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


def _skip(src, left: int) -> None:
    while left > 0:
        got = len(src.read(min(left, CHUNK)))
        if not got:
            return
        left -= got


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    name = None
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and name:  # a folded header
            out[name] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def read_headers(src) -> dict[str, str] | None:
    """Headers of the next record, or None at the end."""
    while True:
        line = src.readline()
        if not line:
            return None
        if line.startswith(b"WARC/"):
            break
    lines = []
    while (line := src.readline()) not in (b"\r\n", b"\n", b""):
        lines.append(line)
    return _fields(lines)


def read_http(src, left: int) -> tuple[dict[str, str], int]:
    """HTTP headers at the start of a block of `left` bytes, and how many bytes they took."""
    lines, used = [], 0
    while used < left:
        line = src.readline(left - used)
        used += len(line)
        if line in (b"\r\n", b"\n", b""):
            break
        lines.append(line)
    return _fields(lines[1:]), used


class Warc(DataSource):
    """Options: path; payload (true by default: false leaves the payload column null and decodes none)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def enable(spark: SparkSession) -> None:
    """Makes format("warc") known to a session and lets predicates reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """WARC records of (page_id, url, html): the writer's columns, one row per page.

    Of equal payloads of at least `min_bytes` bytes the one with the largest page_id is the response (a null id is
    the smallest; rows that repeat the largest id are all responses) and the others revisit it. Only digests
    of payloads that occur repeatedly are joined to the pages; the payloads are not shuffled while those are few.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    base = pick(pages, "page_id", "url", "html").select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    long = base.filter(F.length("payload") >= min_bytes)
    twice = long.groupBy(F.col("digest").alias("same")).agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n"))
    twice = written(twice.filter((F.col("n") > 1) & F.col("head").isNotNull()).drop("n"), "warc-repeated")
    joined = base.join(maybe_broadcast(twice), (F.col("digest") == F.col("same")) & (F.length("payload") >= min_bytes), "left")
    revisit = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return joined.select(
        named(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(FETCHED).alias("date"),
        F.lit(None).cast("string").alias("payload_digest"),  # the writer takes it from the payload
        F.length("payload").cast("bigint").alias("payload_length"),
        F.when(revisit, named(F.col("head"))).alias("refers_to"),
        "payload",
    )


def archived(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> str:
    """Writes the pages as archives and returns their folder; without rows the folder holds no record."""
    spark = pages.sparkSession
    enable(spark)
    path = path or f"{stage_dir(spark)}/tidemark/warc-{uuid.uuid4().hex}"
    records(pages, min_bytes).write.format("warc").mode("append").save(path)
    return path


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    enable(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_of(column: str) -> F.Column:
    return F.regexp_extract(column, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")


def pages_of(found: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, and whether a response's payload has its digest."""
    return found.select(
        page_of("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        page_of("refers_to").alias("refers_to"),
        F.when(F.col("record_type") == "response", F.sha1("payload")).alias("payload_sha1"),
    )
