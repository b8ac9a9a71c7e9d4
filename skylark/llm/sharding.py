"""Sharding by histogram sort: exact byte counts below probed key boundaries, refined until every
splitter meets its tolerance, then one exchange.

The sort key is (text key, id, row number), 64-bit integers. Equal texts are therefore neighbours, and a group
of equal texts is divided only where a boundary must run through it, at last between rows that are equal, so
that no hot group can make a shard too large. Each round counts, over all rows, the bytes that lie in the
1,024 cells of the intervals that still hold a splitter; 16 shards keep at most 15 such intervals, so a round
sends at most 15 x 1,024 sums to the driver, whatever the input holds. Shards are ranges of the key; a slot
numbers the rows of a shard by hashed block and key within the block, not by key alone.

Defined results: a null text has no bytes and size 1; null ids sort as the smallest id; repeated rows
are separate rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

BITS = 10
_MIN = -(2**63)


def _size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def splitters(rows: DataFrame, keys: Sequence[str], size: str, shards: int, tolerance: float) -> list[tuple[int, ...]]:
    """The shards - 1 boundaries, tuples of keys: a row belongs to shard i when i boundaries are not above it.

    Every boundary leaves a sum of sizes below it within tolerance x total / shards of its target, or is
    exact to one tuple. A key is refined after those before it are fixed."""
    total = rows.agg(F.sum(size)).first()[0]
    if not total:
        return []
    slack = tolerance * total / shards
    targets = [total * i / shards for i in range(1, shards)]
    last = len(keys) - 1
    edge = lambda fixed, at: (*fixed, at, *[_MIN] * (last - len(fixed)))
    # state of a target: the fixed keys, low end of the next one's interval, remaining bits, bytes below
    open_: dict[int, tuple[tuple[int, ...], int, int, int]] = {i: ((), _MIN, 64, 0) for i in range(len(targets))}
    done: dict[int, tuple[int, ...]] = {}
    while open_:
        cells = sorted({(fixed, low, bits) for fixed, low, bits, _ in open_.values()})
        step = []
        for number, (fixed, low, bits) in enumerate(cells):
            col, inside = F.col(keys[len(fixed)]), F.lit(True)
            for name, value in zip(keys, fixed, strict=False):
                inside &= F.col(name) == F.lit(value)
            left = bits - min(BITS, bits)
            if bits < 64:
                inside &= col.between(F.lit(low), F.lit(low + (1 << bits) - 1))
            # unsigned distance from low, its upper bits
            cell = F.shiftrightunsigned(col - F.lit(low) if bits < 64 else col.bitwiseXOR(F.lit(_MIN)), left).cast("int")
            step.append(F.when(inside, F.struct(F.lit(number).alias("n"), cell.alias("cell"))))
        found = rows.select(F.explode(F.filter(F.array(*step), lambda x: x.isNotNull())).alias("at"), F.col(size).alias("size"))
        sums: dict[int, list[tuple[int, int]]] = {}
        for r in found.groupBy("at.n", "at.cell").agg(F.sum("size").alias("bytes")).collect():
            sums.setdefault(r["n"], []).append((r["cell"], r["bytes"]))
        following = {}
        for i, (fixed, low, bits, run) in open_.items():
            left, target = bits - min(BITS, bits), targets[i]
            for cell, n in sorted(sums[cells.index((fixed, low, bits))]):
                if run + n >= target:
                    start = low + (cell << left)
                    after = start + (1 << left)
                    if abs(run - target) <= slack:
                        done[i] = edge(fixed, start)
                    elif abs(run + n - target) <= slack and after < 2**63:
                        done[i] = edge(fixed, after)
                    elif left:
                        following[i] = (fixed, start, left, run)
                    elif len(fixed) < last:
                        following[i] = ((*fixed, start), _MIN, 64, run)  # one key holds the boundary: go on by the next
                    else:
                        done[i] = edge(fixed, start if target - run <= run + n - target or after >= 2**63 else after)
                    break
                run += n
        open_ = following
    return sorted(done.values())


def shard(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 1e-4, block_rows: int = 50_000
) -> DataFrame:
    """Place every row: returns id, size (UTF-8 bytes + 1), text_crc32, shard and slot.

    slot numbers the rows of a shard without gaps. It is counted in blocks of about block_rows rows,
    whose counts are summed up first, so no task holds a whole shard."""
    body = F.col(text_col).cast("binary")
    rows = materialise(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            _size(F.col(text_col)).alias("size"),
            F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(F.coalesce(body, F.lit(b""))).alias("key"),
        ).withColumn("tie", F.coalesce("doc_id", F.lit(_MIN))).withColumn("row", F.monotonically_increasing_id()),
        "shard-rows",
    )
    keys = ("key", "tie", "row")
    edges = splitters(rows, keys, "size", shards, tolerance)
    place = F.lit(0)
    for e in edges:
        place += (F.struct(*keys) >= F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, e, strict=True)])).cast("int")
    blocks = max(1, rows.count() // (shards * block_rows))
    # the one exchange: blocks of a shard, even in a group of equal rows
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    placed = rows.withColumn("shard", place.cast("int")).withColumn("block", block)
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.selectExpr("shard", "block", "sum(n) OVER (PARTITION BY shard ORDER BY block) - n AS start")
    ranked = placed.selectExpr("*", "row_number() OVER (PARTITION BY shard, block ORDER BY key, tie, row) AS nth")
    return ranked.join(F.broadcast(starts) if blocks * shards <= 100_000 else starts, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot")
    )


def op9_shard(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law `bytes`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
