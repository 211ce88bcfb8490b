"""WARC archives as a Spark data source: format `loomspan_warc`, to read and to write.

Writing makes a file for each task, a gzip member for each record, under a name of its own; committing lists the files
of the successful tasks in a manifest, so that what lost or repeated attempts left behind is never read. Each member
says in its header how long it is (the `sl` extra field), and the manifest where records begin, every SPLIT bytes.

Reading plans a partition for each such range. Of a record the WARC headers are inflated first; equality and IN on
record_type, record_id, page_id and url are pushed down and tested on them. The payload of a record that fails, or of
any record if payloads aren't asked for, is skipped by its length. Archives of other makers, compressed by record or
plain, are read too: a file a partition, skipping by Content-Length or by inflating without keeping.

Options: payload = `bytes` (the default), `digest` (length and SHA-1 are made from the payload, which is then dropped)
or `none`.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha1

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from loomspan.llm.common import materialize, shared_path, tidy

SPLIT = 16 << 20
MANIFEST = "_manifest.json"
SCHEMA = "record_type string, record_id string, page_id long, url string, date string, refers_to string, declared_digest string, declared_bytes long, payload_bytes long, payload_digest string, payload binary"
_ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_PAGE = "urn:page:"
_PUSHED = {"record_type", "record_id", "page_id", "url"}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:/", "file:///", 1))


def _clean(value: str) -> str:
    """A header's value: no line can end in it."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


def record(kind: str, page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, date: str, payload: bytes) -> bytes:
    """One record, not compressed. A revisit has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    name = f"{_PAGE}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}"
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    lines.append(f"X-Payload-Length: {size}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {_PROFILE}")
        if refers_to is not None:
            lines.append(f"WARC-Refers-To: <{_PAGE}{refers_to}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose header holds its own length and that of what it holds."""
    press = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = press.compress(data) + press.flush()
    extra = b"sl" + struct.pack("<HQQ", 16, 12 + 20 + len(body) + 8, len(data))
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    starts: list[int]
    records: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str) -> None:
        self.path, self.date = path, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, root = _open(self.path)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        at, starts, count, sink = 0, [], 0, None
        for batch in iterator:
            for row in batch.to_pylist():
                if sink is None:
                    where.create_dir(root, recursive=True)
                    sink = where.open_output_stream(f"{root}/{name}", compression=None)
                payload = (row["html"] or "").encode()
                data = member(record(row["record_type"], row["page_id"], row["url"], row["digest"], len(payload), row["refers_to"], self.date, payload))
                if not starts or at - starts[-1] >= SPLIT:
                    starts.append(at)
                sink.write(data)
                at += len(data)
                count += 1
        if sink is not None:
            sink.close()
        return Written(name if count else "", at, starts, count)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, root = _open(self.path)
        where.create_dir(root, recursive=True)
        files = [{"name": m.name, "size": m.size, "starts": m.starts, "records": m.records} for m in messages if m and m.name]
        with where.open_output_stream(f"{root}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps({"files": files}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, root = _open(self.path)
        for m in messages:
            if m and m.name:
                where.delete_file(f"{root}/{m.name}")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class _Tests:
    """Predicates on what the headers say."""

    def __init__(self) -> None:
        self.of: list[tuple[str, frozenset]] = []

    def take(self, column: str, values: Iterable) -> None:
        """A null among the values is equal to nothing."""
        self.of.append((column, frozenset(v for v in values if v is not None)))

    def __call__(self, row: dict) -> bool:
        return all(row[c] in values for c, values in self.of)


def _number(text: str | None) -> int | None:
    """A header's number; foreign files may hold anything."""
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,18}", text) else None


def _hexadecimal(digest: str) -> str:
    """A SHA-1 in hexadecimal, from that or from base 32 of either case; what is neither stays, in lower case."""
    if len(digest) == 32:
        try:
            return base64.b32decode(digest, casefold=True).hex()
        except ValueError:
            pass
    return digest.lower()


def _headers(block: bytes) -> dict:
    out: dict = {}
    for line in block.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        out[key.strip().lower()] = value.strip().decode("utf-8", "replace")
    refers = out.get(b"warc-refers-to", "").strip("<>") or None
    digest = out.get(b"warc-payload-digest", "")
    if digest.startswith("sha1:"):
        digest = _hexadecimal(digest[5:])
    return {
        "record_type": out.get(b"warc-type"), "record_id": out.get(b"warc-record-id", "").strip("<>") or None, "page_id": _number(out.get(b"x-page-id")), "url": out.get(b"warc-target-uri"), "date": out.get(b"warc-date"),
        "refers_to": refers, "declared_digest": digest or None, "declared_bytes": _number(out.get(b"x-payload-length")), "length": max(0, _number(out.get(b"content-length")) or 0), "http": "application/http" in out.get(b"content-type", ""),
    }


class _Source:
    """Bytes of a file from a position on, with a look ahead."""

    def __init__(self, file, start: int, end: int) -> None:
        self.file, self.at, self.end, self.held = file, start, end, bytearray()
        file.seek(start)

    def peek(self, start: int, end: int) -> bytes:
        """Bytes start to end, counted from the position; fewer at the end of the file."""
        while len(self.held) < end and (more := self.file.read(max(end - len(self.held), 1 << 16))):
            self.held += more
        return bytes(self.held[start:end])

    def skip(self, n: int) -> None:
        self.at += n
        if n <= len(self.held):
            del self.held[:n]
        else:
            self.held.clear()
            self.file.seek(self.at)


def _gzipped(src: _Source, wanted, keep: bool) -> Iterator[tuple[dict, bytes | None]]:
    while src.at < src.end and len(head := src.peek(0, 12)) >= 10:
        length = None
        if head[3] & 4:
            size = struct.unpack("<H", head[10:12])[0]
            extra = src.peek(12, 12 + size)
            if extra[:2] == b"sl" and size >= 20:
                length = struct.unpack("<Q", extra[4:12])[0]
        inflate = zlib.decompressobj(31)
        fed, data = 0, b""
        while b"\r\n\r\n" not in data and not inflate.eof:
            part = src.peek(fed, fed + 2048)
            if not part:
                break
            fed += len(part)
            data += inflate.decompress(part)
        cut = data.find(b"\r\n\r\n") + 4
        row = _headers(data[: cut - 4])
        good = wanted(row)
        body = None
        if good and keep or length is None:
            rest = data[cut:]
            rest = bytearray(rest)
            while not inflate.eof:
                part = src.peek(fed, max(length or 0, fed + (1 << 16)))
                if not part:
                    break
                fed += len(part)
                more = inflate.decompress(part)
                if good and keep:
                    rest += more
            length = length if length is not None else fed - len(inflate.unused_data)
            body = bytes(rest[: row["length"]])
        src.skip(length)
        if good:
            yield row, body if keep else None


def _plain(src: _Source, wanted, keep: bool) -> Iterator[tuple[dict, bytes | None]]:
    while src.at < src.end:
        n = 2048
        while b"\r\n\r\n" not in (head := src.peek(0, n)) and len(head) == n:
            n *= 2
        cut = head.find(b"\r\n\r\n") + 4
        if cut < 4:
            return
        row = _headers(head[: cut - 4].lstrip())
        good = wanted(row)
        body = src.peek(cut, cut + row["length"]) if good and keep else None
        src.skip(cut + row["length"] + 4)
        if good:
            yield row, body


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: str) -> None:
        self.path, self.payload, self.tests = path, payload, _Tests()

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in _PUSHED:
                self.tests.take(f.attribute[0], [f.value] if isinstance(f, EqualTo) else f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        where, root = _open(self.path)
        if where.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
            with where.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
                files = json.loads(f.read())["files"]
            out = [Range(f"{root}/{x['name']}", a, b) for x in files for a, b in zip(x["starts"], [*x["starts"][1:], x["size"]], strict=True)]
        else:
            info = where.get_file_info(root)
            found = [info] if info.type == pafs.FileType.File else where.get_file_info(pafs.FileSelector(root))
            out = [Range(x.path, 0, x.size) for x in found if x.path.endswith((".warc", ".warc.gz")) and x.size]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        where, _ = _open(self.path)
        keep = self.payload != "none"
        rows: list[dict] = []
        held = 0
        with where.open_input_file(partition.path) as file:
            src = _Source(file, partition.start, partition.end)
            gz = src.peek(0, 2) == b"\x1f\x8b"
            for row, body in (_gzipped if gz else _plain)(src, self.tests, keep):
                made = None
                if body is not None and row["record_type"] != "revisit":
                    made = body[body.find(b"\r\n\r\n") + 4 :] if row["http"] and b"\r\n\r\n" in body else body
                row |= {"payload_bytes": len(made) if made is not None else None, "payload_digest": sha1(made).hexdigest() if made is not None else None, "payload": made if self.payload == "bytes" else None}
                rows.append(row)
                held += len(row["payload"] or b"") + 500
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomspan_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "bytes"))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], self.options.get("date", "2024-01-01T00:00:00Z"))


def write(pages: DataFrame, path: str, least: int = 1000) -> None:
    """pages: page_id, url, html. A record for each row. Of equal payloads of `least` bytes or more the one with the largest
    page_id is a response and the others revisit it; rows that repeat that page_id are responses too. A null html is an
    empty payload; a null page_id is never referred to, and revisits any other row of its payload that has one."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"))
    groups = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("many"))
    groups = materialize(groups.where("many > 1 and top is not null").select(F.col("digest").alias("d"), F.col("size").alias("s"), "top"), "payloads")
    both = rows.join(groups, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    out = both.select("page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("top")).alias("refers_to"))
    out.sparkSession.dataSource.register(WarcDataSource)
    out.write.format("loomspan_warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: str = "bytes") -> DataFrame:
    """The records below path."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("loomspan_warc").option("payload", payload).load(path)


@tidy
def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes the archives to a folder in the shared one, which goes when they are read back: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url. Of responses, length and digest are those of the payload as read; of revisits, as their headers say."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write(pages, path, least)
    refers = F.regexp_extract("refers_to", rf"^{_PAGE}(-?\d+)$", 1)
    return read(spark, path, "digest").select(
        "page_id", F.coalesce("payload_bytes", "declared_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "declared_digest").alias("payload_digest"),
        "record_type", F.when(refers != "", refers).try_cast("long").alias("refers_to"), "url",
    )
