"""Media and WARC archives: exact round trips, pushed-down predicates, damaged members."""

import glob
import hashlib
import io
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from skylark.llm import media, warc

from .conftest import odd_rows

PAGES = [(1, "u1", "<p>" + "a" * 2000), (2, "u2", "<p>" + "a" * 2000), (3, None, "b"), (4, "u\r\n4", "b"), (5, "u5", None), (None,
    "u6", "<p>" + "a" * 2000), (7, "u7", "é" * 600), (7, "u7", "é" * 600), (8, "u8", "c" * 999), (9, "u9", "c" * 999), (10, "u",
    "d" * 200_000)]


@pytest.fixture(scope="module")
def pages_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame([(*p, "x", "y") for p in PAGES],
        "page_id long, url string, html string, payload string, first string").repartition(2).write.parquet(f"{d}/pages.parquet")
    return d


def test_warc_query(spark, pages_dir, sf_dir):
    for d, pattern in ((pages_dir, "pages.parquet/*.parquet"), (sf_dir, "pages.parquet")):
        c = duckdb.connect()
        c.sql(f"CREATE VIEW pages AS SELECT page_id, url, html FROM '{d}/{pattern}'")
        want = c.sql(warc.OP7_SQL)
        got = warc.op7_warc(spark, d).select(*want.columns).collect()
        assert Counter(map(tuple, got)) == Counter(want.fetchall())
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.op7_warc(spark, pages_dir).collect())
    assert kinds[1, "revisit", 2] == kinds[None, "revisit", 2] == kinds[2, "response", None] == 1
    assert kinds[7, "response", None] == 2 and kinds[8, "response", None] == 1


def test_warc_round_trip_and_pushdown(spark, pages_dir, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(warc.plan_revisits(spark.read.parquet(f"{pages_dir}/pages.parquet")), path)
    back = warc.read_warc(spark, path)
    bodies = {r.page_id: bytes(r.payload) for r in back.where("record_type = 'response'").collect()}
    assert bodies == {i: (h or "").encode() for i, _, h in PAGES if i not in (1, None)}
    heads = warc.read_warc(spark, path, payload=False).where("page_id = 10").collect()
    assert [(r.payload, r.payload_bytes) for r in heads] == [(None, 200_000)]
    reader = warc.WarcReader({"path": path, "payload": "false"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("page_id",), 1)]))
    assert len(left) == 1 and reader.wanted == [("warc-type", {"revisit"})]


def test_archives_follow_the_standard(spark, pages_dir, tmp_path):
    """Required fields, unique ids, references, HTTP entities; two commits add up."""
    import gzip
    import re

    path = str(tmp_path / "w")
    pages = spark.read.parquet(f"{pages_dir}/pages.parquet")
    warc.write_warc(warc.plan_revisits(pages), path)
    seen = {}
    for name in glob.glob(f"{path}/*.warc.gz"):
        data, first = gzip.open(name).read(), True
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            f = dict(x.split(": ", 1) for x in lines[1:])
            body, data = rest[: int(f["Content-Length"])], rest[int(f["Content-Length"]) :]
            assert data[:4] == b"\r\n\r\n"
            data = data[4:]
            assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", f["WARC-Record-ID"])
            assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", f["WARC-Date"])
            assert (f["WARC-Type"] == "warcinfo") == first
            first = False
            if f["WARC-Type"] == "warcinfo":
                assert f["Content-Type"] == "application/warc-fields" and f["WARC-Filename"] == name.rpartition("/")[2]
                continue
            assert f["WARC-Target-URI"] and f["Content-Type"] == "application/http; msgtype=response"
            assert f["WARC-Record-ID"] not in seen or f["X-Page-Id"] == "7"  # the repeated row
            seen[f["WARC-Record-ID"]] = f
            entity = body.partition(b"\r\n\r\n")[2]
            assert body.startswith(b"HTTP/1.1 200 OK\r\n")
            if f["WARC-Type"] == "response":
                assert f["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(entity).hexdigest() and "WARC-Profile" not in f
            else:
                assert entity == b"" and f["WARC-Profile"] == warc.SAME_PAYLOAD
    assert len(seen) == len(PAGES) - 1
    revisits = [f for f in seen.values() if f["WARC-Type"] == "revisit"]
    assert revisits
    for f in revisits:
        to = seen[f["WARC-Refers-To"]]
        assert to["WARC-Type"] == "response" and to["WARC-Payload-Digest"] == f["WARC-Payload-Digest"] and to["X-Page-Id"] == f["X-Refers-To-Page-Id"]
        assert f["WARC-Refers-To-Target-URI"] == to["WARC-Target-URI"] and f["WARC-Refers-To-Date"] == to["WARC-Date"]
    warc.write_warc(warc.plan_revisits(pages.where("page_id = 10")), path)
    again = warc.read_warc(spark, path).where("record_type <> 'warcinfo'")
    assert again.count() == len(PAGES) + 1 and again.where("page_id = 10").count() == 2
    wanted = again.where(f"record_id = '{revisits[0]['WARC-Record-ID'].strip('<>')}'").collect()
    assert [r.record_type for r in wanted] == ["revisit"]


class Counting(io.BytesIO):
    total = 0

    def read(self, n=-1):
        data = super().read(n)
        self.total += len(data)
        return data


def test_unwanted_payloads_are_not_read(tmp_path):
    body = np.random.default_rng(0).integers(0, 256, 500_000, dtype=np.uint8).tobytes()
    data = b"".join(warc.member(warc.header_block({"record_type": "response" if i else "revisit", "page_id": i}, len(body)),
        body) for i in range(4))
    f = Counting(data)
    got = [h["x-page-id"] for _, h, _ in warc.gz_records(f, len(data), lambda h: h["warc-type"] == "revisit", True)]
    assert got == ["0"] and f.total < 600_000
    import gzip

    plain = gzip.decompress(data)
    assert [(h["x-page-id"], b == body) for _, h, b in warc.plain_records(io.BytesIO(plain), len(plain), lambda h: True,
        True)] == [(str(i), True) for i in range(4)]
    other = gzip.compress(plain[: len(plain) // 4]) + gzip.compress(plain[len(plain) // 4 : len(plain) // 2])  # members without a length
    assert [b == body for *_, b in warc.gz_records(io.BytesIO(other), len(other), lambda h: True, True)] == [True, True]
    for cut in (len(plain) - 2000, len(plain) - 2, len(plain) // 4 + 20):
        for payload in (True, False):
            with pytest.raises(EOFError):
                list(warc.plain_records(io.BytesIO(plain[:cut]), cut, lambda h: True, payload))
    with pytest.raises(EOFError):
        list(warc.gz_records(io.BytesIO(data[:-2000]), len(data) - 2000, lambda h: True, True))


def test_media_query(spark, odd_dir, empty_dir):
    got = media.op2_media(spark, odd_dir).collect()
    want = Counter()
    for r in odd_rows():
        t = (r[1] or "").encode()
        p = t.ljust(max(1, -(-len(t) // 192)) * 192, b" ")
        want[r[0], len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert all(r.error is None and r.media_bytes > 0 for r in got)
    same = {}
    for r in got:
        assert same.setdefault(r.payload_sha256 + str(r.n_bytes), (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert media.op2_media(spark, empty_dir).count() == 0


def test_a_damaged_member_fails_alone(spark, odd, tmp_path):
    path = str(tmp_path / "m")
    media.write_media(odd.where("text IS NOT NULL").limit(30).coalesce(1), path)
    (archive,) = glob.glob(f"{path}/*.zip")
    rows = media.read_media(spark, path).collect()
    bad = rows[7]
    with open(archive, "r+b") as f:
        f.seek(bad.offset + 60)
        f.write(b"\xff\x00\xff\x00")
    again = {r.offset: r for r in media.read_media(spark, path, range_bytes=3000).collect()}
    assert len(again) == len(rows)
    assert again[bad.offset].media is None and "checksum" in again[bad.offset].error
    assert all(again[r.offset].media == r.media for r in rows if r.offset != bad.offset)
    out = media.digests(media.read_media(spark, path)).where("error IS NOT NULL").collect()
    assert len(out) == 1 and out[0].payload_sha256 is None


def test_a_damaged_directory_is_a_row_and_commits_add_up(spark, odd, tmp_path):
    path = str(tmp_path / "m")
    some = odd.where("text IS NOT NULL").limit(20).coalesce(1)
    media.write_media(some, path)
    (archive,) = glob.glob(f"{path}/*.zip")
    media.write_media(some, path)
    assert media.read_media(spark, path).count() == 40
    with open(archive, "r+b") as f:
        f.seek(-22, 2)
        f.write(b"\0" * 22)
    rows = media.read_media(spark, path, range_bytes=3000).collect()
    bad = [r for r in rows if r.error]
    assert len(rows) == 21 and len(bad) == 1 and "BadZipFile" in bad[0].error and bad[0].key is None and bad[0].media is None


def test_a_null_key_is_not_an_empty_one(spark, tmp_path):
    path = str(tmp_path / "m")
    media.write_media(spark.createDataFrame([(None, "a"), ("", "b"), ("null", "c"), ("x/y.png", "d")], "doc_id string, text string"), path)
    assert {r.key for r in media.read_media(spark, path).collect()} == {None, "", "null", "x/y.png"}


def test_a_member_is_read_again(tmp_path, monkeypatch):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(3):
            z.writestr(f"{i}/k{i}.png", bytes([i]) * 100)
    tries = []
    whole = media.MediaReader.member

    def flaky(f, m):
        tries.append(m.filename)
        if m.filename.startswith("1/") and tries.count(m.filename) < 3:
            raise OSError("lost")
        return whole(f, m)

    monkeypatch.setattr(media.MediaReader, "member", staticmethod(flaky))
    reader = media.MediaReader({"path": str(tmp_path)})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["media"] for r in rows] == [bytes([i]) * 100 for i in range(3)]
    assert Counter(tries) == {"0/k0.png": 1, "1/k1.png": 3, "2/k2.png": 1}


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    import struct

    rng = np.random.default_rng(kind)
    image = rng.integers(0, 256, (5, 192), dtype=np.uint8)
    raw, up = [], np.zeros(192, np.int64)
    for line in image.astype(np.int64):
        left, corner = np.append(0, line[:-1]), np.append(0, up[:-1])
        p = left + up - corner
        order = np.stack([np.abs(p - left), np.abs(p - up), np.abs(p - corner)])
        paeth = np.choose(order.argmin(axis=0), [left, up, corner])
        guess = [0, left, up, (left + up) // 2, paeth][kind]
        raw.append(bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes())
        up = line
    png = media._SIGNATURE + media._chunk(b"IHDR", struct.pack(">LLBBBBB", 192, 5, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT",
        zlib.compress(b"".join(raw))) + media._chunk(b"IEND", b"")
    got, _ = media.decode_png(png)
    assert (got == image).all()
