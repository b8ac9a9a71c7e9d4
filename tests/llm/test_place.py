"""Mixing, sharding and packing against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylark.llm import mixing, packing, sharding

from .conftest import crc, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fair_targets(sizes):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, free = {}, set(names)
    while True:
        left = sum(sizes.values()) - sum(out.values())
        level = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if w[s] * level > 3 * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in free}
        out |= {s: 3 * sizes[s] for s in over}
        free -= over


def test_mix_meets_targets(odd):
    rows = mixing.mix(odd).collect()
    want = odd_rows()
    assert Counter((r.doc_id, r.size, r.source) for r in rows) == Counter((r[0], len(WORD.findall(r[1] or "")), r[3]) for r in want)
    sizes = defaultdict(int)
    for r in want:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    target = fair_targets(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r.target == pytest.approx(target[r.source])
        share = r.target / r.source_size if r.source_size else 0
        assert r.size == 0 or int(share) <= r.copies <= int(share) + 1 <= 4
        taken[r.source] += r.copies * r.size
    longest = {s: max(r.size for r in rows if r.source == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in sizes)


@pytest.mark.parametrize("d", ["sf0.001", "sf0.01"])
def test_every_source_meets_its_target(spark, d):
    docs = spark.read.parquet(f"/root/testdata/{d}/documents.parquet")
    for seed in (17, 18):
        got = mixing.mix(docs, seed=seed).groupBy("source", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"),
            F.expr("percentile(size, 0.2)").alias("short")).collect()
        assert len(got) == docs.select("source").distinct().count()
        assert all(abs(r.taken - r.target) <= max(0.02 * r.target, r.short) for r in got), [(r.source, r.taken, r.target) for r in got]


def test_equal_rows_are_dealt_by_number(spark):
    """5,000 equal rows and 3,000 of one key that differ, all without id and source."""
    rows = [(None, None, "a b c")] * 5000 + [(None, None, f"x y{i} z")for i in range(3000)] + [(i, "s", "a b c d e") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    mixed = Counter((r.doc_id, r.size, r.copies) for r in mixing.mix(docs, weights=(1, 3)).collect())
    copies = [(c, n) for (i, _, c), n in mixed.items() if i is None]
    assert sum(n for _, n in copies) == 8000 and max(c for c, _ in copies) - min(c for c, _ in copies) <= 1
    got = Counter(r.text for r in mixing.mix_documents(docs, weights=(1, 3)).where("doc_id IS NULL").collect())
    assert sum(got.values()) == sum(c * n for c, n in copies)
    low, high = sum(c * n for c, n in copies) // 8000, -(-sum(c * n for c, n in copies) // 8000)
    assert all(low <= c <= high for t, c in got.items() if t != "a b c") and low * 5000 <= got["a b c"] <= high * 5000


def test_mix_agrees_on_reruns_and_keeps_expectations(spark, odd):
    key = lambda df: Counter(map(tuple, df.select("doc_id", "source", "size", "copies").collect()))
    assert key(mixing.mix(odd, chunk=8)) == key(mixing.mix(odd.repartition(7), chunk=8))
    even = spark.createDataFrame([(i, f"s{i % 2}", " ".join(["w"] * (1 + i % 7))) for i in range(600)],
        "doc_id long, source string, text string")
    share = np.mean([[r.copies for r in mixing.mix(even, weights=(3, 1), seed=k, chunk=16).where("source = 's1'").orderBy(
        "doc_id").collect()] for k in range(3)])
    assert 0.4 < share < 0.6


def test_mixed_documents_repeat_rows(odd):
    got = Counter(r.doc_id for r in mixing.mix_documents(odd).select("doc_id").collect())
    want = Counter()
    for r in mixing.mix(odd).collect():
        assert r.size or not r.copies
        want[r.doc_id] += r.copies
    assert got == +want
    assert mixing.mix_documents(odd).columns == odd.columns


def test_shards_are_even_and_gapless(spark, odd):
    rows = sharding.shard(odd, 4, block_rows=10).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, crc((r[1] or "").encode())) for r in odd_rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(
        F.repeat(F.lit("ab"), (F.col("id") % 50).cast("int"))).alias("text"))
    sums = sharding.shard(many).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    mean = sum(r.b for r in sums) / 16
    assert len(sums) == 16 and all(abs(r.b - mean) < 2e-4 * mean + 60 for r in sums)  # a row has up to 60 bytes


def test_equal_rows_are_divided(spark):
    same = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    rows = sharding.shard(same, 8, block_rows=100).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert sorted(map(len, by.values())) == [500] * 8 and all(sorted(s) == list(range(500)) for s in by.values())


@pytest.fixture(scope="module")
def tokenizer():
    pytest.importorskip("public_tokenizers")
    return packing.tokenizer_path()


def test_tokens_equal_the_tokenizers(tokenizer):
    import random

    rng = random.Random(2)
    enc = packing.Encoder(tokenizer)
    chars = [chr(c) for c in range(256)] + ["'s", "'RE", "<|endoftext|>", "<|STARTOFTEXT|>", "İ", "ſ", "́", "中", "…", " "]
    texts = ["".join(rng.choices(chars, k=rng.randint(0, 30))) for _ in range(3000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)]
    assert got == [e.ids for e in enc.whole.encode_batch(texts, add_special_tokens=False)]


def test_pieces_and_places(odd, tokenizer):
    parts = packing.pieces(odd, tokenizer, ids=True)
    rows = packing.pack(parts, block_rows=20).collect()
    enc = packing.Encoder(tokenizer)
    want = Counter()
    for r in odd_rows():
        ids = [*enc.whole.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[r[0], n, at, len(part), crc(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert all(crc(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    valid(rows)


def valid(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 2048
    return len(by)


def slow_two_fit(counts, capacity):
    """Best-two-fit one bin at a time, over all pairs; equal neighbouring bins are one entry."""
    have, bins = Counter(counts), []
    while +have:
        have = +have
        gap, items, left = capacity, [], Counter(have)
        while fit := [n for n in left if left[n] and n <= gap]:
            items.append(max(fit))
            left[items[-1]] -= 1
            gap -= items[-1]
        n = items[-1]
        pairs = [(a, b) for a in left for b in left if left[a] and left[b] and (a != b or left[a] > 1) and a + b <= gap + n]
        if gap and pairs and (best := max(pairs, key=lambda p: (sum(p), -p[0]))) and sum(best) > n:
            items = [*items[:-1], max(best), min(best)]
        used = Counter(items)
        times = min(have[k] // used[k] for k in used)
        for k in used:
            have[k] -= times * used[k]
        bins.append((times, items))
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_bins_hold_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 120))
    counts = {int(n): int(rng.integers(1, 40)) for n in rng.choice(np.arange(1, capacity + 1),
        size=int(rng.integers(1, capacity)), replace=False)}
    bins = packing.pack_lengths(counts, capacity)
    held = Counter()
    for times, items in bins:
        assert sum(items) <= capacity and times > 0
        for n in items:
            held[n] += times
    assert held == counts
    every = packing.best_two_fit(counts, capacity)
    assert every == slow_two_fit(counts, capacity)
    free = []  # first fit decreasing, one piece at a time
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        for i, gap in enumerate(free):
            if gap >= n:
                free[i] -= n
                break
        else:
            free.append(capacity - n)
    assert sum(t for t, _ in bins) <= len(free)
    places = packing.Places(bins)
    seen = set()
    for n, c in counts.items():
        seq, off = places.find(np.full(c, n), np.arange(c))
        for s, o in zip(seq.tolist(), off.tolist(), strict=True):
            for x in range(o, o + n):
                assert (s, x) not in seen
                seen.add((s, x))
    assert places.total == sum(t for t, _ in bins)


def test_empty_tables(spark, empty_dir, tokenizer):
    for q in (mixing.op1_mix, sharding.op9_shard, packing.op8_packing):
        assert q(spark, empty_dir).count() == 0
