"""Best-two-fit packing of token sequences.

Tokens: every text is encoded whole by a public tokenizer file. Where all characters of a text are
printable ASCII, blanks or Latin-1 letters, the tokenizer's normaliser reduces to lower-casing and its
pattern to fixed classes, so the text is split here and each different word is encoded once a worker;
any other text goes to the tokenizer as it is. Both give the same ids.

Packing: only lengths matter, and there are at most `capacity` of them, so the algorithm runs on the
driver over the histogram of lengths, never over documents. A bin is filled greedily, longest first;
then its shortest piece is replaced by the two unpacked pieces that together fill the widened gap
best, if that is tighter. Replacing early can cost a bin later, so the packing is done twice, once replacing
wherever it is tighter and once only where the bin is then full, and the one with fewer bins counts. The bin is repeated as often as the counts allow, which uses up at least one
length, so there are at most `capacity` different bins whatever the number of documents. Each bin and
length owns a run of ranks, and each piece finds its place by its rank within its length. The ranks
are counted in salted blocks, the more the more pieces have the length, so no length is a hot key.

Defined results: a null or empty text is its end token alone; null ids and repeated rows are packed as
others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, materialise

#: At most so many runs between blanks are kept encoded in a worker.
CACHE_WORDS = 1_000_000
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_PLAIN = re.compile(r"[\t\n\r -~\xa1-\xff]*")
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\s0-9\xb2\xb3\xb9\xbc-\xbe{_LETTER}]+")


class Encoder:
    """Ids of texts as packed little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer, models, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        suffix = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: the same merges behind no normaliser, for words that are already split
        self.words = Tokenizer(models.BPE(model["vocab"], merges, end_of_word_suffix=suffix, cache_capacity=0))
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [t.content.casefold() for t in self.whole.get_added_tokens_decoder().values()]
        self.runs = Runs(self.words)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.runs) > CACHE_WORDS:
            self.runs = Runs(self.words)
        get, out = self.runs.__getitem__, []
        for t in texts:
            low = t.lower()
            if _PLAIN.fullmatch(t) and not any(s in low for s in self.special):
                out.append(b"".join(map(get, low.split())))
            else:
                out.append(np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
        return out


class Runs(dict):
    """Ids of runs between blanks, by run; a run not met before is split and encoded."""

    def __init__(self, words):
        self.encode, self.parts = words.encode, {}

    def __missing__(self, run: str) -> bytes:
        found = []
        for p in _SPLIT.findall(run):
            if (ids := self.parts.get(p)) is None:
                ids = self.parts[p] = array("I", self.encode(p, add_special_tokens=False).ids).tobytes()
            found.append(ids)
        self[run] = out = found[0] if len(found) == 1 else b"".join(found)
        return out


def encoder(path: str) -> Encoder:
    return held(f"encoder {path}", lambda: Encoder(path))


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32",
    pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; with ids also its token ids."""
    end = np.array([end_id], "<u4").tobytes()
    width = capacity * 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for first in range(0, len(texts), 64):
                rows: list[tuple] = []
                for key, raw in zip(keys[first : first + 64], enc.encode([t or "" for t in texts[first : first + 64]]), strict=True):
                    raw += end
                    for n, at in enumerate(range(0, len(raw), width)):
                        part = raw[at : at + width]
                        row = (key, n, at // 4, len(part) // 4, zlib.crc32(part))
                        rows.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if ids else row)
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*_PIECES.types, pa.list_(pa.int32())], strict=False)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*_PIECES.names, "ids"][: len(arrays)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, schema)


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) of the bins that hold counts[n] pieces of each length n."""
    return min((best_two_fit(counts, capacity, full) for full in (False, True)), key=lambda bins: sum(t for t, _ in bins))


def best_two_fit(counts: dict[int, int], capacity: int, full: bool = False) -> list[tuple[int, list[int]]]:
    """Bins by best-two-fit; with `full` a piece is replaced only where that fills the bin."""
    have = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        have[n] = c
    bins: list[tuple[int, list[int]]] = []
    lengths = [n for n in range(capacity, 0, -1) if have[n]]
    used = np.zeros(capacity + 1, np.int64)
    while lengths:
        used[:] = 0
        kinds = np.array(lengths[::-1])  # ascending
        gap, items = capacity, []
        while gap:
            fit = kinds[: np.searchsorted(kinds, gap, "right")]
            fit = fit[have[fit] > used[fit]]
            if not fit.size:
                break
            n = int(fit[-1])
            k = int(min(have[n] - used[n], gap // n))
            items += [n] * k
            used[n] += k
            gap -= n * k
        if gap and items:
            n = items[-1]
            room = gap + n
            left = have - used  # the replaced piece itself is not one of the two
            small = kinds[(kinds < room) & (left[kinds] > 0)]
            best: tuple[int, int, int] | None = None
            if small.size:
                # for each first piece the longest second that still fits
                at = np.searchsorted(small, room - small, "right") - 1
                a, b = small[at >= 0], small[at[at >= 0]]
                same = (a == b) & (left[a] < 2)
                at2 = at[at >= 0] - same
                a, at2 = a[at2 >= 0], at2[at2 >= 0]
                if a.size:
                    b = small[at2]
                    i = int(np.argmax(a + b))
                    if a[i] + b[i] > n and (not full or a[i] + b[i] == room):
                        best = int(a[i]), int(b[i]), int(a[i] + b[i])
            if best:
                items.pop()
                used[n] -= 1
                items += [max(best[:2]), min(best[:2])]
                used[best[0]] += 1
                used[best[1]] += 1
        held = np.flatnonzero(used)
        times = int((have[held] // used[held]).min())
        have[held] -= times * used[held]
        bins.append((times, items))
        lengths = [n for n in lengths if have[n]]
    return bins


class Places:
    """Where the piece of a given length and rank goes."""

    def __init__(self, bins: list[tuple[int, list[int]]]):
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        sequence = 0
        for times, items in bins:
            offset, i = 0, 0
            while i < len(items):
                n, j = items[i], i
                while j < len(items) and items[j] == n:
                    j += 1
                k = j - i
                first = taken.get(n, 0)
                runs.setdefault(n, []).append((first, k, sequence, offset))
                taken[n] = first + k * times
                offset += n * k
                i = j
            sequence += times
        self.total = sequence
        self.runs = {n: [np.array(c, np.int64) for c in zip(*r, strict=True)] for n, r in runs.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(length.size, np.int64), np.empty(length.size, np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            first, k, seq, off = self.runs[int(n)]
            run = np.searchsorted(first, rank[at], "right") - 1
            inside = rank[at] - first[run]
            sequence[at] = seq[run] + inside // k[run]
            offset[at] = off[run] + inside % k[run] * n
        return sequence, offset


def pack(parts: DataFrame, capacity: int = 2048, block_rows: int = 500) -> DataFrame:
    """parts (doc_id, piece, start, length, ...) with sequence_id and offset. parts is read twice."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = Places(pack_lengths(counts, capacity))
    spark = parts.sparkSession
    salts = spark.createDataFrame([(n, max(1, c // block_rows)) for n, c in counts.items()], "length long, salts long")
    salted = parts.join(F.broadcast(salts), "length")  # at most `capacity` rows
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")).cast("int")).drop("salts")
    ranked = salted.selectExpr("*", "row_number() OVER (PARTITION BY length, salt ORDER BY doc_id, piece, ids_crc32) AS nth")
    starts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).selectExpr("length", "salt",
        "sum(n) OVER (PARTITION BY length ORDER BY salt) - n AS first")
    rows = ranked.join(starts, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("nth") - 1).drop("salt", "nth", "first")
    sent = spark.sparkContext.broadcast(places)  # at most about `capacity` x 60 runs
    names = [c for c in rows.columns if c not in ("rank",)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, off = sent.value.find(b.column("length").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(seq), pa.array(off)], names=[*names,
                "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema
        if f.name in names) + ", sequence_id long, offset long"
    return rows.mapInArrow(place, schema)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    parts = materialise(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path()), "pack-pieces")
    return pack(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
