"""WARC archives as a Spark data source, and archiving pages with revisit records.

Reading plans partitions of whole files.  Predicates on the record type and on header columns are
pushed down: the headers of a record are parsed first, and the payload of an unwanted record is
neither decompressed nor read.  Each record is a gzip member of its own, whose header carries the
member's length, so a reader steps over it; archives of other writers, without that length or
uncompressed, are read too.

Writing is safe against lost and repeated tasks: every attempt writes files of its own, and the
commit lists those that count in a manifest, which readers follow.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull,
    StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from civictopics.storage import cut, new_path

SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
    "payload_length long, payload binary"
)
MANIFEST = "_manifest.json"
FILE_BYTES = 1 << 30
PARTITION_BYTES = 1 << 27
BATCH_BYTES = 1 << 24
CHUNK = 1 << 16
SAME_PAYLOAD_FROM = 1000

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
}


# ----------------------------------------------------------------------------- records


def record(row: dict, date: str) -> bytes:
    """One record: WARC headers, and an HTTP response whose body a revisit leaves out."""
    payload = row["payload"] or b""
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if row["record_type"] == "revisit" else http + payload
    digest = row["payload_digest"]
    lines = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", _bracketed(row["record_id"])), ("WARC-Date", date),
        ("WARC-Target-URI", row["target_uri"]), ("WARC-Refers-To", _bracketed(row["refers_to"])),
        ("WARC-Profile", REVISIT_PROFILE if row["record_type"] == "revisit" else None),
        ("WARC-Payload-Digest", digest and "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    # A line break inside a value would end the header.
    head = b"".join(f"{k}: {' '.join(v.splitlines())}\r\n".encode() for k, v in lines if v is not None)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _bracketed(uri: str | None) -> str | None:
    return None if uri is None else f"<{uri}>"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field SL holds the lengths of the member and of its content."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    extra_length = 4 + 16
    total = 10 + 2 + extra_length + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", extra_length)
    extra = b"SL" + struct.pack("<HQQ", 16, total, len(data))
    return head + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def headers(block: bytes) -> dict[str, str]:
    """Header lines by lower-case name; the version line is passed over, continued lines joined."""
    out, name = {}, None
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def columns_of(head: dict[str, str]) -> dict:
    """The header columns of a record."""
    row = {column: head.get(name) for column, name in HEADERS.items()}
    for column in ("record_id", "refers_to"):
        row[column] = row[column] and row[column].strip("<>")
    digest = row["payload_digest"]
    if digest and digest.lower().startswith("sha1:"):
        value = digest[5:]
        row["payload_digest"] = (base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower())
    return row


class _Content:
    """The content of a record, decompressed no further than it is asked for."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks, self.held = chunks, bytearray()

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        self.held += chunk or b""
        return chunk is not None

    def until(self, mark: bytes) -> bytes:
        at = self.held.find(mark)
        while at < 0:
            size = len(self.held)
            if not self._more():
                raise ValueError("a record ends within its headers")
            at = self.held.find(mark, max(0, size - len(mark)))
        taken = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return taken

    def take(self, size: int) -> bytes:
        while len(self.held) < size:
            if not self._more():
                raise ValueError("a record is shorter than its length")
        taken = bytes(self.held[:size])
        del self.held[:size]
        return taken

    def skip(self, size: int) -> None:
        while size > 0:
            if not self.held and not self._more():
                raise ValueError("a record is shorter than its length")
            step = min(size, len(self.held))
            del self.held[:step]
            size -= step

    def at_end(self) -> bool:
        while not self.held:
            if not self._more():
                return True
        return False


def _inflated(file, size: int) -> Iterator[bytes]:
    """A member of known length, piece by piece."""
    unpack, left = zlib.decompressobj(31), size
    while left:
        data = file.read(min(CHUNK, left))
        if not data:
            raise ValueError("a gzip member is cut off")
        left -= len(data)
        while data and not unpack.eof:
            yield unpack.decompress(data, CHUNK)
            data = unpack.unconsumed_tail


def _raw(file) -> Iterator[bytes]:
    """The content of a file of other writers: plain, or gzip members without lengths."""
    start = file.read(2)
    file.seek(0)
    if start != b"\x1f\x8b":
        while data := file.read(CHUNK):
            yield data
        return
    unpack = zlib.decompressobj(31)
    while data := file.read(CHUNK):
        while data:
            yield unpack.decompress(data)
            data = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(31)


def records(file, wanted, with_payload: bool = True) -> Iterator[dict]:
    """Rows of the records of a file whose header columns are ``wanted``."""
    size, at = file.size(), 0
    while at < size:
        file.seek(at)
        head = file.read(32)
        known = len(head) == 32 and head[:4] == b"\x1f\x8b\x08\x04" and head[12:16] == b"SL\x10\x00"
        if not known:
            file.seek(0)
            if at:
                raise ValueError("a file mixes members with and without lengths")
            content = _Content(_raw(file))
            while not content.at_end():
                row = _parsed(content, wanted, with_payload)
                if row is not None:
                    yield row
            return
        length = struct.unpack_from("<Q", head, 16)[0]
        file.seek(at)
        row = _parsed(_Content(_inflated(file, length)), wanted, with_payload, rest=False)
        at += length
        if row is not None:
            yield row


def _parsed(content: _Content, wanted, with_payload: bool, rest: bool = True) -> dict | None:
    """One record.  ``rest``: what follows in ``content`` is needed, so leave it at the next record."""
    head = headers(content.until(b"\r\n\r\n"))
    row, length = columns_of(head), int(head.get("content-length", 0))
    if not wanted(row):
        if rest:
            content.skip(length + 4)
        return None
    http = head.get("content-type", "").startswith("application/http")
    row |= {"payload_length": length, "payload": None}
    if http:
        before = content.until(b"\r\n\r\n")
        length -= len(before) + 4
        stated = headers(before).get("content-length")
        row["payload_length"] = int(stated) if stated is not None else length
    if with_payload and row["record_type"] != "revisit":
        row["payload"] = content.take(length)
        length = 0
    if rest:
        content.skip(length + 4)
    return row


# ------------------------------------------------------------------------- data source


@dataclass
class FilePartition(InputPartition):
    files: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    files: tuple[tuple[str, int], ...]


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path: local, HDFS, S3 and others by its scheme."""
    return pyarrow.fs.FileSystem.from_uri(path)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.schema = options["path"], schema
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.pushed: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            name = getattr(test, "attribute", ("",))
            known = len(name) == 1 and name[0] in HEADERS
            if known and isinstance(test, EqualTo):
                self.pushed.append((name[0], "in", (test.value,)))
            elif known and isinstance(test, In):
                self.pushed.append((name[0], "in", tuple(test.value)))
            elif known and isinstance(test, StringStartsWith):
                self.pushed.append((name[0], "starts", (test.value,)))
            elif known and isinstance(test, IsNotNull):
                self.pushed.append((name[0], "given", ()))
            else:
                yield test

    def wanted(self, row: dict) -> bool:
        for name, kind, values in self.pushed:
            value = row[name]
            if value is None or (kind == "in" and value not in values) or (
                kind == "starts" and not value.startswith(values[0])
            ):
                return False
        return True

    def partitions(self) -> list[FilePartition]:
        """Whole files, small ones together, up to about ``partitionBytes``."""
        store, root = _store(self.path)
        if store.get_file_info(root).type == pyarrow.fs.FileType.File:
            return [FilePartition((root,))]
        listed = store.get_file_info(f"{root}/{MANIFEST}")
        if listed.type == pyarrow.fs.FileType.File:
            with store.open_input_stream(listed.path) as file:
                found = [(f"{root}/{name}", size) for name, size in json.loads(file.read())]
        else:
            infos = store.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
            found = [(i.path, i.size) for i in infos if i.is_file and i.path.endswith((".warc", ".warc.gz"))]
        out, held, size = [], [], 0
        for path, length in sorted(found):
            if held and size + length > self.bytes:
                out.append(FilePartition(tuple(held)))
                held, size = [], 0
            held.append(path)
            size += length
        return [*out, FilePartition(tuple(held))] if held else out

    def read(self, partition: FilePartition | None) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        fields, rows, size = to_arrow_schema(self.schema), [], 0
        for path in partition.files if partition else ():
            with store.open_input_file(path) as file:
                for row in records(file, self.wanted, self.with_payload):
                    rows.append(row)
                    size += 200 + len(row["payload"] or b"")
                    if size >= BATCH_BYTES:
                        yield _batch(rows, fields)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, fields)


def _batch(rows: list[dict], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in fields], schema=fields)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.date = options.get("date", "2000-01-01T00:00:00Z")
        self.level, self.limit = int(options.get("level", 1)), int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        files, file, size, name = [], None, 0, ""
        for batch in iterator:
            for row in batch.to_pylist():
                if file is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    file = store.open_output_stream(f"{root}/{name}", compression=None)
                data = member(record(row, self.date), self.level)
                file.write(data)
                size += len(data)
                if size >= self.limit:
                    file.close()
                    files.append((name, size))
                    file = None
        if file is not None:
            file.close()
            files.append((name, size))
        return Written(tuple(files))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        old = store.get_file_info(f"{root}/{MANIFEST}")
        if not self.overwrite and old.is_file:
            with store.open_input_stream(old.path) as file:
                files = [*map(tuple, json.loads(file.read())), *files]
        with store.open_output_stream(f"{root}/{MANIFEST}", compression=None) as file:
            file.write(json.dumps(sorted(files)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        for message in messages:
            for name, _ in message.files if message is not None else ():
                store.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``.

    Options for reading: ``partitionBytes``, ``payload`` (``false`` leaves it out); for writing:
    ``date``, ``level`` of compression, ``fileBytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filter push-down for Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# ------------------------------------------------------------------------------- pages


def page_records(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 same_from: int = SAME_PAYLOAD_FROM) -> DataFrame:
    """A record for each page, in the columns of the source.

    Of pages with equal payloads of ``same_from`` bytes or more, the one with the largest id is the
    response and the others are revisits of it; shorter ones are all responses.  A null page is
    empty; null ids are smaller than any other and have the record id ``urn:x-page:``; rows that
    repeat the largest id are all responses.  Only payloads that occur more than once are looked
    up; Spark broadcasts or splits that join by its size.
    """
    payload = F.encode(F.coalesce(df[html_col].cast("string"), F.lit("")), "UTF-8")
    pages = df.select(
        df[id_col].cast("long").alias("page_id"), df[url_col].cast("string").alias("target_uri"), payload.alias("payload")
    ).withColumns({"payload_digest": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long"),
                   "check": F.xxhash64("payload")})
    same = ["payload_digest", "payload_length", "check"]
    repeated = cut(
        pages.filter(F.col("payload_length") >= same_from).groupBy(*same)
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1").select(*same, "kept"),
        "warc-repeated",
    )
    urn = lambda column: F.concat(F.lit("urn:x-page:"), F.coalesce(F.col(column).cast("string"), F.lit("")))
    revisit = F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("page_id"))
    return pages.join(repeated, same, "left").select(
        urn("page_id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri", F.when(revisit, urn("kept")).alias("refers_to"), "payload_digest", "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archive(df: DataFrame, path: str) -> None:
    """Write records as WARC files below ``path``, beside those already there."""
    register(df.sparkSession)
    df.write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archived_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page and give, from the archives read back, one row for each of them.

    Two reads, each with its record type pushed down to the source: lengths and digests of
    responses are taken from the payloads read; those of revisits from their headers, without
    decoding any payload.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, "warc")
    write_archive(page_records(df, id_col, url_col, html_col), path)
    responses = read_archive(spark, path).filter(F.col("record_type") == "response")
    revisits = read_archive(spark, path, payload=False).filter(F.col("record_type") == "revisit")
    back = responses.unionByName(revisits)
    page = lambda column: F.nullif(F.substring_index(column, ":", -1), F.lit("")).cast("long")
    return back.select(
        page("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), F.col("payload_digest")).alias("payload_digest"), "record_type",
        page("refers_to").alias("refers_to"),
    )
