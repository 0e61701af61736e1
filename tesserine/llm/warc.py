"""WARC as a Python data source.

Writing: a task writes one archive, a gzip member for each record; the member's extra field says how long its compressed
head and body are, so a reader can step over a body without inflating it. Reading: files are cut into partitions by the
record offsets noted beside each archive, record-type and header predicates are pushed down, a record's headers are parsed
before anything else, and payloads are inflated only for records and columns that are wanted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import scratch, stored

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes bigint, refers_to string, payload binary, intact boolean"
WRITE_SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes bigint, refers_to string, payload string"
#: Bytes of archive that a partition reads, about.
SPLIT = 8 << 20
#: A payload of more than this part of all pages is hot.
HOT = 1 / 1000
KINDS = {"record_id": pa.string(), "record_type": pa.string(), "target_uri": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "refers_to": pa.string(), "payload": pa.binary(), "intact": pa.bool_()}
DATE = "2000-01-01T00:00:00Z"
PUSHED = {"record_type", "target_uri", "payload_digest", "record_id", "refers_to"}


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system that a path or URI names; local paths and file: URIs need no scheme's library."""
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pyarrow.fs.LocalFileSystem(), path
    return pyarrow.fs.FileSystem.from_uri(path)


def member(head: bytes, body: bytes) -> bytes:
    """A gzip member of head + body; extra field `WL`: the compressed lengths of both parts (one stream, flushed between)."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    first = z.compress(head) + z.flush(zlib.Z_FULL_FLUSH)
    rest = z.compress(body) + z.flush()
    extra = b"WL" + struct.pack("<HQQ", 16, len(first), len(rest))
    top = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra
    return top + first + rest + struct.pack("<II", zlib.crc32(head + body), (len(head) + len(body)) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(r: dict) -> bytes:
    """One record: a response with its payload in an HTTP message, or a revisit with the HTTP headers alone."""
    payload = (r["payload"] or "").encode("utf-8", "replace")
    revisit = r["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: <{_clean(r['record_id'])}>", f"WARC-Date: {DATE}"]
    if r["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_clean(r['target_uri'])}")
    lines.append(f"WARC-Payload-Digest: sha1:{r['payload_digest']}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_clean(r['refers_to'])}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else len(payload))}"]
    head = "\r\n".join(lines).encode() + b"\r\n\r\n" + http
    return member(head, b"\r\n\r\n" if revisit else payload + b"\r\n\r\n")


@dataclass
class Written(WriterCommitMessage):
    name: str | None = None
    records: int = 0


class WarcWriter(DataSourceArrowWriter):
    """Each task writes an archive under a name of its own; only archives of the manifest that commit() writes are read."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, base = filesystem(self.path)
        name, n, at, marks = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0, [0]
        out = None
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                raw = record(r)
                if at - marks[-1] >= SPLIT:
                    marks.append(at)
                out.write(raw)
                at += len(raw)
                n += 1
        if out is None:
            return Written(None, 0)
        out.close()
        with fs.open_output_stream(f"{base}/{name}.marks") as f:
            f.write(json.dumps([*marks, at]).encode())
        return Written(name, n)

    def commit(self, messages: list) -> None:
        fs, base = filesystem(self.path)
        fs.create_dir(base, recursive=True)
        names = [m.name for m in messages if m is not None and m.name]
        with fs.open_output_stream(f"{base}/manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages: list) -> None:
        fs, base = filesystem(self.path)
        for m in messages:
            if m is not None and m.name:
                for x in (m.name, f"{m.name}.marks"):
                    if fs.get_file_info(f"{base}/{x}").type != pyarrow.fs.FileType.NotFound:
                        fs.delete_file(f"{base}/{x}")


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int | None
    value: object = field(default=None, init=False)


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        if k:
            out[k.strip().lower()] = v.strip()
    return out


class Inflated:
    """The bytes of a gzip file of any members, forwards, never more than a piece beyond what was asked for."""

    def __init__(self, f):
        self.f, self.z, self.raw, self.out = f, zlib.decompressobj(31), b"", bytearray()

    def _more(self) -> bool:
        if self.z.eof:
            self.raw, self.z = self.z.unused_data or self.raw, zlib.decompressobj(31)
        if not self.raw:
            self.raw = self.f.read(1 << 16)
        if not self.raw:
            return False
        self.out += self.z.decompress(self.raw, 1 << 20)
        self.raw = b"" if self.z.eof else self.z.unconsumed_tail
        return True

    def read(self, n: int) -> bytes:
        while len(self.out) < n and self._more():
            pass
        got = bytes(self.out[:n])
        del self.out[:n]
        return got

    def skip(self, n: int) -> None:
        while n > 0:
            got = min(n, len(self.out))
            del self.out[:got]
            n -= got
            if n and not self.out and not self._more():
                return


class Plain:
    def __init__(self, f):
        self.f = f

    def read(self, n: int) -> bytes:
        return self.f.read(n)

    def skip(self, n: int) -> None:
        self.f.seek(self.f.tell() + n)


def _until_blank(stream, most: int) -> tuple[bytes, bytes]:
    """What is before the first blank line, and what was read after it; all (up to `most` bytes) if there is none."""
    got = b""
    while len(got) < most:
        piece = stream.read(min(8192, most - len(got)))
        got += piece
        at = got.find(b"\r\n\r\n", max(0, len(got) - len(piece) - 3))
        if at >= 0:
            return got[:at], got[at + 4 :]
        if not piece:
            break
    return got, b""


def records(stream, wants) -> Iterator[tuple[dict, dict, bytes | None, int]]:
    """As members(), of a stream of records that follow each other. A record's headers are read first; the block of one
    that is not wanted is passed over, of one that is wanted without its payload only the HTTP headers are read."""
    ahead = b""
    while True:
        while len(ahead := ahead.lstrip(b"\r\n")) < 5 and (piece := stream.read(64)):
            ahead += piece
        if not ahead.startswith(b"WARC/"):
            return
        if b"\r\n\r\n" not in ahead:
            head, rest = _until_blank(_Ahead(ahead, stream), 1 << 24)
        else:
            head, _, rest = ahead.partition(b"\r\n\r\n")
        said = _headers(head)
        length = said.get("content-length", "").strip()
        if not length.isdecimal():  # where such a record ends is not known; the next one begins after a line's end
            ahead = _next_record(_Ahead(rest, stream))
            continue
        size = int(length)
        block = _Ahead(rest, stream)
        level, used, http = wants(said), 0, {}
        if level:
            top = b""
            kind = said.get("content-type")
            if said.get("warc-type") in ("response", "request", "revisit") if kind is None else kind.lower().startswith("application/http"):
                top, body = _until_blank(block, size)
                http, used = _headers(top), min(size, len(top) + 4)
                block.ahead = body + block.ahead
            yield said, http, block.read(size - used) if level == 2 else None, size - used
            if level == 2:
                used = size
        block.skip(size - used)
        ahead = block.ahead


def _next_record(block: _Ahead) -> bytes:
    """What follows up to the next record's first bytes, or nothing if no record follows."""
    got = b"\n"
    while (at := got.find(b"\nWARC/")) < 0:
        piece = block.read(8192)
        if not piece:
            return b""
        got = got[-5:] + piece
    block.ahead = got[at + 1 :] + block.ahead
    return block.read(len(got) - at - 1)


class _Ahead:
    """A stream with some bytes put back before it."""

    def __init__(self, ahead: bytes, stream):
        self.ahead, self.stream = ahead, stream

    def read(self, n: int) -> bytes:
        got, self.ahead = self.ahead[:n], self.ahead[n:]
        return got + self.stream.read(n - len(got)) if len(got) < n else got

    def skip(self, n: int) -> None:
        got = min(n, len(self.ahead))
        self.ahead = self.ahead[got:]
        if n > got:
            self.stream.skip(n - got)


def members(f, start: int, end: int | None, wants) -> Iterator[tuple[dict, dict, bytes | None, int]]:
    """(WARC headers, HTTP headers, payload or None, payload bytes) of the records that begin in [start, end).

    wants(headers) says 0 to pass over a record, 1 for its headers, 2 for its payload too. Bodies of members with the `WL`
    field are stepped over without being inflated; archives of others, plain or gzip, are read as one stream.
    """
    f.seek(start)
    at = start
    while end is None or at < end:
        top = f.read(12)
        if len(top) < 12:
            return
        extra = f.read(struct.unpack("<H", top[10:12])[0]) if top[:4] == b"\x1f\x8b\x08\x04" else b""
        if extra[:2] != b"WL":
            f.seek(at)
            yield from records(Inflated(f) if top[:2] == b"\x1f\x8b" else Plain(f), wants)
            return
        first, rest = struct.unpack("<QQ", extra[4:20])
        z = zlib.decompressobj(-15)
        head = z.decompress(f.read(first))
        at += 12 + len(extra) + first + rest + 8
        said = _headers(head.partition(b"\r\n\r\n")[0])
        level = wants(said)
        body = z.decompress(f.read(rest)) if level == 2 else b""
        f.seek(at)
        if level:
            http = head.partition(b"\r\n\r\n")[2]
            length = int(said["content-length"]) - len(http)
            yield said, _headers(http.partition(b"\r\n\r\n")[0]), body[:length] if level == 2 else None, length


def _bare(x: str | None) -> str | None:
    return x.strip("<>") if x is not None else None


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, types: list[str] | None, columns: list[str] | None = None):
        self.path, self.columns, self.filters = path, columns or list(KINDS), []
        self.payload = payload and not {"payload", "intact"}.isdisjoint(self.columns)
        if types is not None:
            self.filters.append(("record_type", "in", types))

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in PUSHED and isinstance(f, EqualTo):
                self.filters.append((column, "in", [f.value]))
            elif column in PUSHED and isinstance(f, In):
                self.filters.append((column, "in", list(f.value)))
            elif column in PUSHED and isinstance(f, StringStartsWith):
                self.filters.append((column, "starts", f.value))
            elif column in PUSHED and isinstance(f, IsNotNull):
                self.filters.append((column, "known", None))
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        fs, base = filesystem(self.path)
        info = fs.get_file_info(base)
        if info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == pyarrow.fs.FileType.File:
            return [Stretch(base, 0, None)]
        there = {x.base_name: x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(base)) if x.is_file}
        lists = [n for n in there if n.startswith("manifest-")]
        names = [x for n in lists for x in json.loads(fs.open_input_file(there[n]).read())] if lists else [n for n in there if n.endswith((".warc", ".warc.gz"))]
        out = []
        for n in sorted(names):
            marks = json.loads(fs.open_input_file(f"{there[n]}.marks").read()) if f"{n}.marks" in there else [0, None]
            out += [Stretch(there[n], a, b) for a, b in zip(marks, marks[1:], strict=False)]
        return out or [Stretch("", 0, 0)]

    def _wants(self, said: dict) -> int:
        own = {"record_type": said.get("warc-type"), "target_uri": said.get("warc-target-uri"), "payload_digest": (said.get("warc-payload-digest") or "").removeprefix("sha1:") or None, "record_id": _bare(said.get("warc-record-id")), "refers_to": _bare(said.get("warc-refers-to"))}
        for column, kind, value in self.filters:
            x = own[column]
            if x is None or kind == "in" and x not in value or kind == "starts" and not x.startswith(value):
                return 0
        return 2 if self.payload and own["record_type"] != "revisit" else 1

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = filesystem(self.path)
        rows, size = [], 0
        with fs.open_input_file(part.path) as f:
            for said, http, body, length in members(f, part.start, part.end, self._wants):
                digest = (said.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                revisit = said.get("warc-type") == "revisit"
                n = int(http.get("content-length", "")) if revisit and http.get("content-length", "").isdigit() else None if revisit else length
                intact = None if body is None or digest is None else len(body) == n and base64.b32encode(hashlib.sha1(body).digest()).decode() == digest
                row = (_bare(said.get("warc-record-id")), said.get("warc-type"), said.get("warc-target-uri"), digest, n, _bare(said.get("warc-refers-to")), body, intact)
                rows.append(row)
                size += len(body or b"")
                if len(rows) >= 2000 or size >= 8 << 20:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = dict(zip(KINDS, zip(*rows, strict=True), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], KINDS[c]) for c in self.columns], names=self.columns)


class WarcSource(DataSource):
    """spark.read.format("warc").option("payload", "false").option("types", "response,revisit").load(path)

    Reads a file or a folder, of own archives or of others (.warc, .warc.gz). With a schema of some of the columns the
    others are not made; payloads are read only for the columns payload and intact. intact is null where the payload was
    not read or the record names no digest.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        types = self.options.get("types")
        return WarcReader(self.options["path"], str(self.options.get("payload", "true")).lower() != "false", types.split(",") if types else None, [c for c in schema.names])

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes format("warc") known to the session and lets Spark push predicates down to Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes a record for each page (page_id, url, html) to `path`.

    Of pages with equal payloads (the html in UTF-8; null is empty) of at least least_bytes bytes the one with the largest
    page_id is a response (a null page_id is the least; rows that repeat the largest one are all responses), the others
    are revisits that refer to it; smaller ones are all responses. Only digests and ids are grouped, and only digests of several
    pages are joined with payloads; those of over HOT of all pages (fewer than 1 / HOT) are sent to the tasks, so a payload
    that most pages share is not shuffled.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), html.alias("payload"))
    own = own.withColumn("sha1", F.sha1(F.encode("payload", "utf-8"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    keep = stored(own.groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "digests")
    line = F.lit(pages.count() * HOT)
    hot, rare = keep.where(F.col("n") > line).drop("n"), keep.where(F.col("n") <= line).drop("n")
    near = own.join(F.broadcast(hot), "sha1")
    far = own.join(F.broadcast(hot.select("sha1")), "sha1", "left_anti").join(rare.withColumn("shared", F.lit(True)), "sha1", "left")
    far = far.withColumn("first", F.when(F.col("shared"), F.col("first")).otherwise(F.col("page_id"))).drop("shared")
    both = near.unionByName(far)
    again = (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    base32 = _base32(F.col("sha1"))
    out = both.select(
        F.coalesce(name(F.col("page_id")), F.concat(F.lit("urn:uuid:"), F.uuid())).alias("record_id"),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), "target_uri", base32.alias("payload_digest"), "payload_bytes",
        F.when(again, name(F.col("first"))).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )
    register(pages.sparkSession)
    out.write.format("warc").mode("append").save(path)


def _base32(hexed):
    """Upper-case base32 of 40 hex digits: 20 bits, which are five digits, make four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for i in range(8):
        n = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(n, shift).bitwiseAND(31) + 1
            parts.append(F.substring(F.lit(letters), at, F.lit(1)))
    return F.concat(*parts)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Of each record that archive() wrote: page_id, payload_bytes, payload_digest, record_type, refers_to, intact."""
    register(spark)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    rows = spark.read.format("warc").load(path)
    return rows.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), F.coalesce("intact", F.lit(True)).alias("intact"))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages to a new archive in the shared folder and reads it back.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, intact. A null html is an empty
    payload, a null url no target; a null page_id stays null and is only the response where all equal payloads' are null;
    rows that repeat the largest page_id of a payload are all responses; an empty table gives no row.
    """
    path = scratch(pages.sparkSession, "warc")
    archive(pages, path, least_bytes)
    return digests(pages.sparkSession, path)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS s FROM p),
d AS (SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY s) AS first,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((('0x' || substr(s, CAST(5 * (i // 4) + 1 AS BIGINT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, TRUE AS intact FROM d"""
