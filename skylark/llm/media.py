"""Media columns: payloads as members of archives, read through a Spark data source.

The writer puts each payload, losslessly as an 8-bit greyscale PNG of 192 columns, into zip archives
(members stored as they are), at most `file_bytes` each; a manifest names the committed archives. The
reader plans byte ranges over the archive folder from sizes alone: a task opens its archive's directory,
takes the members that begin in its range, and streams their bytes as Arrow batches of bounded size. A
member that cannot be read, or whose checksum fails, is read again from its own offset, three times
over a newly opened file; if it still fails its row carries `error` and no media, and the rest go on. An
archive whose directory cannot be read gives one row with `error`, and neither key nor offset.

Defined results: a null text is an empty one; an empty payload becomes one row of 192 blanks; null keys
come back null; repeated rows are separate members; an empty table gives no archives and no rows; other
columns are ignored. Equal texts have equal stored forms.
"""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import shared_path
from .files import commit, listed, new_name, remove, store

FORMAT = "skylark_media"
WIDTH = 192
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_READ = pa.schema([("key", pa.string()), ("media", pa.binary()), ("archive", pa.string()), ("offset", pa.int64()), ("error", pa.string())])
BATCH_BYTES = 8 << 20
TRIES = 3


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">L", len(body)) + kind + body + struct.pack(">L", zlib.crc32(body, zlib.crc32(kind)))


def pad(data: bytes, multiple: int = WIDTH) -> bytes:
    """data followed by blanks up to a positive multiple."""
    return data.ljust(max(1, -(-len(data) // multiple)) * multiple, b" ")


def encode_png(payload: bytes, n_bytes: int, level: int = 4) -> bytes:
    """An 8-bit greyscale image of WIDTH columns; the unpadded length is kept as text."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((rows.shape[0], WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    return (
        _SIGNATURE + _chunk(b"IHDR", struct.pack(">LLBBBBB", WIDTH, rows.shape[0], 8, 0, 0, 0, 0)) + _chunk(b"tEXt",
            b"length\0%d" % n_bytes)
        + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")
    )


def decode_png(media: bytes) -> tuple[np.ndarray, int | None]:
    """Samples (rows, columns) of an 8-bit greyscale PNG of any filter, and the length kept as text."""
    if not media.startswith(_SIGNATURE):
        raise ValueError("not a PNG")
    at, data, size, length = 8, [], None, None
    while at < len(media):
        n = struct.unpack_from(">L", media, at)[0]
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">L", media, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">LLBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"tEXt" and body.startswith(b"length\0"):
            length = int(body[7:])
        at += 12 + n
    width, height = size[:2]
    if size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit greyscale without interlace")
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if not raw[:, 0].any():
        return raw[:, 1:], length
    out, up = np.zeros((height, width), np.uint8), np.zeros(width, np.int64)
    for y in range(height):
        line, kind = raw[y, 1:].astype(np.int64), raw[y, 0]
        if kind == 1:
            line = np.cumsum(line) & 255
        elif kind == 2:
            line = (line + up) & 255
        elif kind in (3, 4):
            left = corner = 0
            for x in range(width):
                a, b, c = left, int(up[x]), corner
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
                corner, left = b, (int(line[x]) + guess) & 255
                line[x] = left
        out[y], up = line, line
    return out, length


@dataclass
class Written(WriterCommitMessage):
    files: list


class MediaWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("file_bytes", 128 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        s, top = store(self.path)
        s.create_dir(top, recursive=True)
        files, out, seen = [], None, 0

        def close() -> None:
            out[0].close()
            out[1].close()
            files.append((name, s.get_file_info([f"{top}/{name}"])[0].size))

        for batch in iterator:
            keys, media = batch.column("key"), batch.column("media")
            for i in range(batch.num_rows):
                if out is None:
                    name = new_name(".zip")
                    raw = s.open_output_stream(f"{top}/{name}", compression=None)
                    out, size = (zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED), raw), 0
                key, body = keys[i].as_py(), media[i].as_py() or b""
                out[0].writestr(zipfile.ZipInfo(f"{seen:x}/{'null' if key is None else f'={key}'}.png"), body)
                seen, size = seen + 1, size + len(body)
                if size >= self.most:
                    close()
                    out = None
        if out is not None:
            close()
        return Written(files)

    def commit(self, messages) -> None:
        commit(self.path, [f for m in messages if m is not None for f in m.files])

    def abort(self, messages) -> None:
        remove(self.path, [f[0] for m in messages if m is not None for f in m.files])


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class Reopened:
    """A file that is opened anew after a failed read."""

    def __init__(self, files, path: str):
        self.files, self.path, self.f = files, path, None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.f is not None:
            self.f.close()
            self.f = None

    def tried(self, read):
        """(read(file), None), or (None, the error of the last of TRIES)."""
        error = None
        for _ in range(TRIES):
            try:
                if self.f is None:
                    self.f = self.files.open_input_file(self.path)
                return read(self.f), None
            except (OSError, ValueError, struct.error, zipfile.BadZipFile, NotImplementedError) as e:
                error = f"{type(e).__name__}: {e}"
                self.__exit__()
        return None, error


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range_bytes = options["path"], int(options.get("range_bytes", 32 << 20))

    def partitions(self):
        return [
            ByteRange(p, at, min(n, at + self.range_bytes)) for p, n in listed(self.path, (".zip",)) for at in range(0, n, self.range_bytes)
        ]

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one partition where partitions() has none
            return
        s, _ = store(self.path)
        rows, held = [], 0
        with Reopened(s, partition.path) as archive:
            members, error = archive.tried(lambda f: zipfile.ZipFile(f).infolist())
            if error and not partition.start:
                rows.append({"key": None, "media": None, "archive": partition.path, "offset": None, "error": error})
            for m in members or []:
                if not partition.start <= m.header_offset < partition.end:
                    continue
                media, error = archive.tried(lambda f, m=m: self.member(f, m))
                name = m.filename.partition("/")[2].removesuffix(".png")
                key = name[1:] if name.startswith("=") else None if name == "null" else name
                rows.append({"key": key, "media": media, "archive": partition.path, "offset": m.header_offset, "error": error})
                held += len(media or b"") + 100
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    @staticmethod
    def member(f, m: zipfile.ZipInfo) -> bytes:
        """The bytes of one stored member, by its offset."""
        f.seek(m.header_offset)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member begins here")
        name, extra = struct.unpack("<HH", head[26:30])
        f.seek(m.header_offset + 30 + name + extra)
        body = f.read(m.file_size)
        if len(body) != m.file_size or zlib.crc32(body) != m.CRC:
            raise ValueError("the member's checksum differs")
        return body


class MediaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "key string, media binary, archive string, offset long, error string"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return MediaWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaSource)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        media = [encode_png(pad(data := (x.as_py() or "").encode("utf-8", "surrogatepass")), len(data)) for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(media, pa.binary())], ["key", "media"])


def write_media(docs: DataFrame, path: str, key_col: str = "doc_id", text_col: str = "text") -> None:
    """Store the text of every row as one member."""
    register(docs.sparkSession)
    docs.select(F.col(key_col).cast("string").alias("key"), F.col(text_col).alias("text")).mapInArrow(_stored,
        "key string, media binary").write.format(FORMAT).mode("append").save(path)


def read_media(spark: SparkSession, path: str, range_bytes: int = 32 << 20) -> DataFrame:
    """key, media, archive, offset and error of every member below path."""
    register(spark)
    return spark.read.format(FORMAT).option("range_bytes", range_bytes).load(path)


def feature(samples: np.ndarray) -> str:
    """Shape, mean and deviation in thousandths, and an 8 x 8 average hash of the image."""
    h, w = samples.shape
    x = samples.astype(np.float64)
    rows = np.add.reduceat(x, np.arange(8) * h // 8, axis=0) if h >= 8 else np.repeat(x, -(-8 // h), axis=0)[:8]
    cells = rows.reshape(8, 8, w // 8).mean(axis=2) / (np.maximum(1, np.diff(np.append(np.arange(8) * h // 8, h)))[:, None]
        if h >= 8 else 1)
    bits = int("".join("1" if v else "0" for v in (cells > cells.mean()).ravel()), 2)
    return f"{w}x{h} mean={round(x.mean() * 1000)} sd={round(x.std() * 1000)} ahash={bits:016x}"


_DIGEST = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), (
        "tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string()),
])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for key, media, error in zip(b.column(0), b.column(1), b.column(2), strict=True):
            row = {"doc_id": None if key.as_py() is None else int(key.as_py()), "error": error.as_py()}
            if (m := media.as_py()) is not None:
                samples, n = decode_png(m)
                payload = samples.tobytes()
                row |= {
                    "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
                        "tail_crc32": zlib.crc32(payload[-16:]),
                    "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest(), "feature": feature(samples),
                }
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=_DIGEST)


def digests(media: DataFrame) -> DataFrame:
    """Lengths, digests and features of stored members, from the bytes read back."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return media.select("key", "media", "error").mapInArrow(_digest, schema)


def op2_media(spark, sf_dir: str) -> DataFrame:
    """Store every document, read the archives back and describe what was stored."""
    path = shared_path(spark, "media")
    write_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return digests(read_media(spark, path))
