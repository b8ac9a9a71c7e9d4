"""WARC archives as a Spark data source, written in Python.

Writing: every task writes gzip-per-record archives of at most `file_bytes`, under names that no other
attempt takes; the commit names the finished files in a manifest, so files of lost or repeated attempts
are never read, and appended commits add up. Records follow WARC 1.1: an archive begins with a warcinfo
record; every record has an id, a date and a length; responses and revisits are HTTP messages whose entity
is the payload, which the reader returns without the HTTP head; digests are labelled; a revisit names its
profile and the id, URI and date of its response. Two headers of our own (X-Page-Id, X-Refers-To-Page-Id)
carry page ids, one (X-Payload-Length) the length of the full payload. Each gzip member carries its own length (extra field SL), which lets a reader seek past
a record. Reading: one partition a file. Predicates on header columns are pushed into the source; a
record's header block is decompressed first, and where it fails them, or where the payload was not
asked for (option payload=false), the payload is neither decompressed nor copied.

Defined results: a null payload is an empty one; a null id leaves its header out and comes back null; a null
URI is written as urn:page:<id>; repeated rows of a page are records of one id; a record that is cut off, also
in an archive without compression, raises EOFError;
among equal payloads of at least `min_bytes` bytes the largest id is the response (all rows of that id,
if it repeats; all rows, if every id is null) and the others are revisits; an empty table gives archives
without records; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .common import materialise, shared_path
from .files import commit, listed, new_name, remove, store

FORMAT = "skylark_warc"
#: Column and header of the fields that a record's header block carries.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "refers_to_uri": "WARC-Refers-To-Target-URI",
    "refers_to_date": "WARC-Refers-To-Date",
    "profile": "WARC-Profile",
    "payload_bytes": "X-Payload-Length",
    "page_id": "X-Page-Id",
    "refers_to_page": "X-Refers-To-Page-Id",
}
_NUMBERS = {"payload_bytes", "page_id", "refers_to_page", "offset"}
SCHEMA = ", ".join(f"{c} {'long' if c in _NUMBERS else 'string'}" for c in HEADERS) + ", payload binary, file string, offset long"
_ARROW = pa.schema([(c, pa.int64() if c in _NUMBERS else pa.string()) for c in HEADERS] + [("payload", pa.binary()),
    ("file", pa.string()), ("offset", pa.int64())])
_SUFFIX = (".warc.gz", ".warc")
HTTP = "application/http"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns of record ids, which stand in angle brackets in an archive.
_IDS = {"record_id", "refers_to"}
CHUNK = 1 << 16
BATCH_BYTES = 8 << 20


def member(header: bytes, payload: bytes, level: int = 6) -> bytes:
    """One record as a gzip member whose extra field SL holds the member's length."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    # the header block is flushed on its own, so that a reader can stop after it
    body = c.compress(header) + c.flush(zlib.Z_SYNC_FLUSH) + c.compress(payload + b"\r\n\r\n") + c.flush()
    crc, size = zlib.crc32(payload + b"\r\n\r\n", zlib.crc32(header)), (len(header) + len(payload) + 4) & 0xFFFFFFFF
    total = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 12) + b"SL" + struct.pack("<HQ", 8,
        total) + body + struct.pack("<LL", crc, size)


def header_block(fields: dict[str, object], length: int) -> bytes:
    lines = ["WARC/1.1"]
    for column, name in HEADERS.items():
        if (v := fields.get(column)) is not None:
            value = " ".join(str(v).split())
            lines.append(f"{name}: <{value}>" if column in _IDS else f"{name}: {value}")
    lines.append(f"Content-Length: {length}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace")


def http_message(payload: bytes, length: int | None) -> bytes:
    """A response message; its Content-Length is that of the full payload."""
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (len(payload)
        if length is None else length) + payload


def info_record(name: str, date: str, level: int) -> bytes:
    """The warcinfo record at the head of an archive."""
    body = b"software: skylark\r\nformat: WARC File Format 1.1\r\n"
    fields = {"record_type": "warcinfo", "record_id": uuid.uuid4().urn, "date": date, "content_type": "application/warc-fields"}
    head = header_block(fields, len(body)).replace(b"Content-Length:", f"WARC-Filename: {name}\r\nContent-Length:".encode(), 1)
    return member(head, body, level)


def parse_header(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, sep, value = line.partition(":")
        if sep:
            out[name.strip().lower()] = value.strip()
    return out


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.level, self.most = options["path"], int(options.get("level", 6)), int(options.get("file_bytes", 128 << 20))
        self.date = options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        s, top = store(self.path)
        s.create_dir(top, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            names = [n for n in batch.schema.names if n in HEADERS]
            columns = {n: batch.column(n) for n in names}
            payloads = batch.column("payload")
            for i in range(batch.num_rows):
                if out is None:
                    name = new_name(".warc.gz")
                    out, size = s.open_output_stream(f"{top}/{name}", compression=None), 0
                    out.write(first := info_record(name, self.date, self.level))
                    size = len(first)
                payload = payloads[i].as_py() or b""
                fields = {n: c[i].as_py() for n, c in columns.items()}
                fields["record_id"] = fields.get("record_id") or uuid.uuid4().urn
                fields["date"] = fields.get("date") or self.date
                fields["record_type"] = fields.get("record_type") or "resource"
                if fields.get("refers_to"):
                    fields["refers_to_date"] = fields.get("refers_to_date") or self.date
                if (fields.get("content_type") or "").startswith(HTTP):
                    payload = http_message(payload, fields.get("payload_bytes"))
                data = member(header_block(fields, len(payload)), payload, self.level)
                out.write(data)
                size += len(data)
                if size >= self.most:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages) -> None:
        commit(self.path, [f for m in messages if m is not None for f in m.files])

    def abort(self, messages) -> None:
        remove(self.path, [f[0] for m in messages if m is not None for f in m.files])


@dataclass
class WarcFile(InputPartition):
    path: str
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.wanted: list[tuple[str, set[str]]] = []

    def pushFilters(self, filters):
        """Equality and IN on header columns hold in the source; Spark keeps the others."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in HEADERS:
                values = f.value if isinstance(f, In) else [f.value]
                held = {str(v) for v in values if v is not None}
                self.wanted.append((HEADERS[column].lower(), {f"<{v}>" for v in held} if column in _IDS else held))
            else:
                yield f

    def partitions(self):
        return [WarcFile(p, n) for p, n in listed(self.path, _SUFFIX)]

    def read(self, partition: WarcFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one partition where partitions() has none
            return
        s, _ = store(self.path)
        rows, held = [], 0
        with s.open_input_file(partition.path) as f:
            records = gz_records if partition.path.endswith(".gz") else plain_records
            for offset, header, payload in records(f, partition.size, self._keep, self.payload):
                row = {c: header.get(h.lower()) for c, h in HEADERS.items()}
                row |= {c: int(row[c]) if row[c] is not None else None for c in _NUMBERS & row.keys()}
                row |= {c: row[c].strip("<>") if row[c] is not None else None for c in _IDS}
                if payload and (row["content_type"] or "").startswith(HTTP):
                    payload = payload.partition(b"\r\n\r\n")[2]
                rows.append(row | {"payload": payload, "file": partition.path, "offset": offset})
                held += len(payload or b"") + 200
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    def _keep(self, header: dict[str, str]) -> bool:
        return all(header.get(name) in values for name, values in self.wanted)


def gz_records(f, size: int, keep, payload: bool):
    """(offset, header, payload or None) of the wanted records of a gzip-per-record archive."""
    at = 0
    while at < size:
        f.seek(at)
        head = f.read(24)
        length = struct.unpack("<Q", head[16:24])[0] if head[3:4] == b"\x04" and head[12:14] == b"SL" else None
        f.seek(at)
        d, out, used = zlib.decompressobj(31), b"", 0
        while b"\r\n\r\n" not in out and not d.eof:
            used += len(data := f.read(min(CHUNK, 4096 if length else CHUNK)))
            if not data:
                raise EOFError(f"the record at {at} is cut off")
            # at most a little more than the header block is decompressed here
            out += d.decompress(data, 8192)
            while b"\r\n\r\n" not in out and d.unconsumed_tail:
                out += d.decompress(d.unconsumed_tail, 8192)
        block, _, rest = out.partition(b"\r\n\r\n")
        header = parse_header(block)
        n = int(header.get("content-length", 0))
        wanted = keep(header)
        if wanted and payload or length is None:
            parts = [rest, d.decompress(d.unconsumed_tail)]
            while not d.eof:
                used += len(data := f.read(length - used if length and used < length else CHUNK))
                if not data:
                    raise EOFError(f"the record at {at} is cut off")
                parts.append(d.decompress(data))
                if not (wanted and payload):
                    parts.clear()
            if wanted:
                body = b"".join(parts)[:n] if payload else None
                if payload and len(body) != n:
                    raise EOFError(f"the record at {at} has {len(body)} of {n} bytes")
                yield at, header, body
            at = at + length if length else at + used - len(d.unused_data)
        else:
            if wanted:
                yield at, header, None
            at += length


def plain_records(f, size: int, keep, payload: bool):
    """The same of an archive that is not compressed; unwanted payloads are seeked over."""
    at = 0
    while at < size:
        f.seek(at)
        out = b""
        while b"\r\n\r\n" not in out:
            if not (data := f.read(4096)):
                raise EOFError(f"the record at {at} is cut off")
            out += data
        block, _, _ = out.partition(b"\r\n\r\n")
        header = parse_header(block.lstrip(b"\r\n"))
        n, start = int(header.get("content-length", 0)), at + len(block) + 4
        if keep(header):
            f.seek(start)
            body = f.read(n) if payload else None
            if payload and len(body) != n:
                raise EOFError(f"the record at {at} has {len(body)} of {n} bytes")
            yield at, header, body
        at = start + n + 4
        if at > size:
            raise EOFError(f"the last record ends at {at}, the archive at {size}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of an archive folder. Filters on header columns run inside the source."""
    register(spark)
    return spark.read.format(FORMAT).option("payload", str(payload).lower()).load(path)


def write_warc(records: DataFrame, path: str, level: int = 6) -> None:
    """Write records; columns of HEADERS and payload count, others are ignored."""
    register(records.sparkSession)
    cols = [c for c in (*HEADERS, "payload") if c in records.columns]
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")  # one of all tasks, so that revisits can name it
    records.select(*cols).write.format(FORMAT).option("level", level).option("date", date).mode("append").save(path)


def plan_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_bytes: int = 1000) -> DataFrame:
    """Records of the pages, each marked as response or revisit by its payload."""
    body = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    p = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("target_uri"), body.alias("payload"),
        F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"),
    )
    large = p.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
    groups = large.agg(F.max(F.struct("page_id", "target_uri")).alias("first"), F.count(F.lit(1)).alias("n")).where(
        "n > 1 AND first.page_id IS NOT NULL")
    # written first, so that Spark knows its size when it chooses the join; payloads are not shuffled to meet a small table
    groups = materialise(groups.select("payload_digest", F.col("first.page_id").alias("first"), F.col("first.target_uri").alias(
        "first_uri")), "warc-groups")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    of = lambda c: F.when(again, c)
    return p.join(groups, "payload_digest", "left").select(
        "page_id", _uri(F.col("target_uri"), F.col("page_id")).alias("target_uri"), "payload_bytes", F.concat(F.lit("sha1:"),
            "payload_digest").alias("payload_digest"),
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(F.col("page_id").eqNullSafe(F.col("first")), _urn(F.col("page_id"))).alias("record_id"),
        of(_urn(F.col("first"))).alias("refers_to"), of(_uri(F.col("first_uri"), F.col("first"))).alias("refers_to_uri"),
        of(F.col("first")).alias("refers_to_page"), of(F.lit(SAME_PAYLOAD)).alias("profile"),
        F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), F.lit(f"{HTTP}; msgtype=response").alias("content_type"),
    )


def _uri(url: Column, page_id: Column) -> Column:
    return F.coalesce(url, F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit(""))))


def _urn(page_id: Column) -> Column:
    """The record id of a page that others refer to; other records draw theirs as they are written."""
    h = F.md5(F.concat(F.lit("page "), page_id.cast("string")))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(F.lit("8"),
        F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Write every page, read the archives back: responses with their payloads, revisits by headers alone."""
    path = shared_path(spark, "warc")
    write_warc(plan_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    responses = read_warc(spark, path).where("record_type = 'response'").select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
            "record_type", F.lit(None).cast("long").alias("refers_to")
    )
    revisits = read_warc(spark, path, payload=False).where("record_type = 'revisit'").select(
        "page_id", "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", F.col(
            "refers_to_page").alias("refers_to")
    )
    return responses.unionByName(revisits)


OP7_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, max(page_id) AS first, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY 1
), j AS (
  SELECT p.*, g.first, g.n > 1 AND g.first IS NOT NULL AND p.page_id IS DISTINCT FROM g.first AS again
  FROM p LEFT JOIN g USING (payload_digest)
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN coalesce(again, false) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN coalesce(again, false) THEN first END AS refers_to
FROM j
"""
