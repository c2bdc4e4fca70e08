"""WARC archives as a PySpark data source, with payload de-duplication by revisit records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ..plans.lineage import fresh_path, stage
from .common import checked_broadcast

MANIFEST = "_manifest.json"
#: A writer starts a new file beyond this many bytes, so files are even units of reading.
FILE_BYTES = 64 << 20
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"  # fixed, so that equal input gives equal archives

#: Columns of a record; all but the last two come from headers alone.
SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, date string, payload_digest string, "
    "content_length long, payload_length long, headers map<string,string>, payload binary"
)
#: Which header a filter on a column can be decided by.
_HEADER_OF = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "date": "warc-date",
}


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and plain path of a folder given as a path or URI."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: object) -> str:
    """A header value on one line."""
    return " ".join(str(value).splitlines())


def record_bytes(record_id: str, record_type: str, target_uri: str | None, refers_to: str | None, payload: bytes) -> bytes:
    """One WARC record. A revisit keeps the HTTP headers of the full payload and drops its bytes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    head = [
        "WARC/1.0", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if target_uri is not None:
        head.insert(3, f"WARC-Target-URI: {_line(target_uri)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Headers(dict):
    """Header fields by lower-case name."""

    @classmethod
    def parse(cls, lines: list[bytes]) -> _Headers:
        out = cls()
        for line in lines:
            name, _, value = line.partition(b":")
            out[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
        return out


def _head_lines(stream: io.BufferedIOBase) -> list[bytes] | None:
    """Lines up to the blank one; None at the end of the file."""
    lines = []
    while line := stream.readline():
        line = line.rstrip(b"\r\n")
        if line:
            lines.append(line)
        elif lines:
            return lines
    return lines or None


def read_records(stream: io.BufferedIOBase, wanted, with_payload: bool, verify: bool) -> Iterator[tuple]:
    """Records of one archive whose headers pass ``wanted``.

    Headers are parsed first. A record that is not wanted is skipped by its length; of one whose
    payload is not asked for, only the HTTP headers are read.
    """
    while (lines := _head_lines(stream)) is not None:
        headers = _Headers.parse(lines[1:])
        length = int(headers.get("content-length", 0))
        end = stream.tell() + length
        if wanted(headers):
            bare = lambda name: headers[name].strip("<>") if name in headers else None
            http, payload, payload_length = {}, None, length
            if headers.get("content-type", "").startswith("application/http"):
                http = _Headers.parse((_head_lines(stream) or [b""])[1:])
                payload_length = int(http.get("content-length", end - stream.tell()))
            if with_payload or verify:
                payload = stream.read(end - stream.tell())
            stated = headers.get("warc-payload-digest", "").rpartition(":")[2] or None
            if verify and headers.get("warc-type") != "revisit" and stated and stated != digest(payload):
                raise ValueError(f"payload of {bare('warc-record-id')} does not match its digest")
            yield (
                bare("warc-record-id"), headers.get("warc-type"), headers.get("warc-target-uri"), bare("warc-refers-to"), headers.get("warc-date"),
                stated, length, payload_length, {**headers, **{f"http:{k}": v for k, v in http.items()}}, payload if with_payload else None,
            )
        stream.seek(end)


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, options: dict):
        self.path, self.names = path, schema.fieldNames()
        self.with_payload, self.verify = "payload" in self.names, options.get("verify", "false").lower() == "true"
        self.pushdown = options.get("pushdown", "false").lower() == "true"
        self.tests: list[tuple[str, str, tuple]] = [
            (column, kind, tuple(values)) for column, kind, values in json.loads(options.get("only", "[]"))
        ]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """With the option ``pushdown``, take tests that a record's header lines decide; leave the others to Spark.

        Spark keeps what was pushed with the loaded relation, so a second query on the same
        DataFrame would see it too: load the archive anew for each query then.
        """
        if not self.pushdown:
            yield from filters
            return
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in _HEADER_OF:
                yield f
            elif isinstance(f, EqualTo | EqualNullSafe) and isinstance(f.value, str):
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self.tests.append((column, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", (f.value,)))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "present", ()))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """One partition per archive. The manifest names what committed tasks wrote; foreign folders are listed."""
        store, folder = filesystem(self.path)
        info = store.get_file_info(folder)
        if info.type == fs.FileType.File:
            return [_File(folder)]
        if store.get_file_info(f"{folder}/{MANIFEST}").type == fs.FileType.File:
            with store.open_input_stream(f"{folder}/{MANIFEST}") as f:
                return [_File(f"{folder}/{name}") for name in json.loads(f.read())]
        found = store.get_file_info(fs.FileSelector(folder, recursive=True))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith((".warc", ".warc.gz"))]

    def _wanted(self, headers: _Headers) -> bool:
        for column, kind, values in self.tests:
            value = headers.get(_HEADER_OF[column])
            if value is not None and column in ("record_id", "refers_to"):
                value = value.strip("<>")
            if value is None or kind == "in" and value not in values or kind == "starts" and not value.startswith(values):
                return False
        return True

    def read(self, partition: _File | None) -> Iterator[tuple]:
        if partition is None:  # an archive without files
            return
        every = [part.split()[0] for part in SCHEMA.split(", ")]
        pick = [every.index(n) for n in self.names]
        store, _ = filesystem(self.path)
        with store.open_input_file(partition.path) as raw:
            stream = gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
            for record in read_records(stream, self._wanted, self.with_payload, self.verify):
                yield tuple(record[i] for i in pick)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceWriter):
    """Writes (record_id, record_type, target_uri, refers_to, payload) rows.

    Each attempt writes files under names of its own; only the driver's manifest, written after
    all tasks have committed, makes files part of the archive. A lost or repeated attempt leaves
    nothing that a reader sees.
    """

    def __init__(self, path: str, options: dict):
        self.path = path
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.gz = options.get("compression", "none") == "gzip"
        store, folder = filesystem(path)
        store.create_dir(folder, recursive=True)

    def write(self, rows) -> _Written:
        store, folder = filesystem(self.path)
        files, out, size = [], None, 0
        for row in rows:
            if out is None or size > self.file_bytes:
                if out is not None:
                    out.close()
                files.append(f"{uuid.uuid4().hex}.warc{'.gz' if self.gz else ''}")
                out, size = store.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
            data = record_bytes(row["record_id"], row["record_type"], row["target_uri"], row["refers_to"], bytes(row["payload"] or b""))
            data = gzip.compress(data, 1, mtime=0) if self.gz else data  # a member per record
            out.write(data)
            size += len(data)
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        store, folder = filesystem(self.path)
        with store.open_output_stream(f"{folder}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(sorted(name for m in messages if m for name in m.files)).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        store, folder = filesystem(self.path)
        for name in (name for m in messages if m for name in m.files):
            store.delete_file(f"{folder}/{name}")


class WarcDataSource(DataSource):
    """``format("warc")``: read or write a folder of WARC files.

    Options: path; verify=true recomputes payload digests; pushdown=true takes filters on header
    columns from a query (for one query per load); only, header predicates as a JSON list of
    [column, "in" | "starts" | "present", values]; file_bytes and compression (none, gzip) for
    writing. A schema without ``payload`` reads headers only.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], dict(self.options))


def page_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Rows for the WARC writer: of equal payloads the smallest page_id is a response, others revisit it.

    Only digests are grouped; a table of the digests that occur twice is joined to the pages.
    Nulls: a null html is an empty payload; a null page_id never is the response if another page has
    the payload. Payloads under ``least_bytes`` are all responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sha = F.sha1(payload)
    repeated = stage(
        pages.select(sha.alias("sha"), "page_id").groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("sha", "first_id"),
        "payloads",
    )
    joined = pages.select("page_id", "url", payload.alias("payload"), sha.alias("sha")).join(checked_broadcast(repeated), "sha", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.octet_length("payload") >= least_bytes)
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return joined.select(
        name("page_id").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(again, name("first_id")).alias("refers_to"),
        "payload",
    )


def write_pages(pages: DataFrame, path: str | None = None, least_bytes: int = 0, **options: str) -> str:
    """Write a WARC record per page and return the folder (in the shared folder unless given)."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcDataSource)
    path = path or fresh_path(spark, "warc")
    page_records(pages, least_bytes).write.format("warc").mode("append").options(path=path, **options).save()
    return path


def read_archive(
    spark: SparkSession,
    path: str,
    payload: bool = True,
    verify: bool = False,
    record_types: tuple[str, ...] = (),
    uri_prefix: str | None = None,
    pushdown: bool = False,
) -> DataFrame:
    """The records of a folder of archives, restricted by header before any payload is touched.

    ``pushdown`` also takes header predicates from the one query that the result is for.
    """
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Spark requires it of readers that can
    only = [("record_type", "in", record_types)] if record_types else []
    only += [("target_uri", "starts", (uri_prefix,))] if uri_prefix else []
    reader = spark.read.format("warc").options(path=path, verify=str(verify).lower(), pushdown=str(pushdown).lower(), only=json.dumps(only))
    return (reader if payload else reader.schema(SCHEMA.removesuffix(", payload binary"))).load()


def page_archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives and read them back, one row per page.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to (page_id of the
    response). Every response payload is read and checked against its digest; the length of a
    revisited payload comes from the HTTP headers that its record keeps. An empty table gives an
    empty archive and no rows; rows repeated with one id and html are one response and revisits
    only where ids differ. Other columns are ignored.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    records = read_archive(pages.sparkSession, write_pages(pages, least_bytes=least_bytes), payload=False, verify=True)

    def number(column: str):
        part = F.substring(column, len("urn:page:") + 1, 1 << 20)
        return F.when(part != "", part).cast(kind)

    return records.select(
        number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )
