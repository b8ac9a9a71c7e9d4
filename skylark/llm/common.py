"""What the operators of this subpackage share: tables in the shared folder, word patterns, and
vectorised word hashes."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Removes the blanks around a word character as Java's regular expressions see them.
HAS_WORD = r"[^\x20\x09-\x0D]"

_DIRS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one under /tmp on a
    local master; on a cluster it raises ValueError, since executors would write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        base = sc.getCheckpointDir()
        if not base:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir(f"/tmp/checkpoints/{sc.applicationId}")
            base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/skylark-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. It is deleted when the driver ends."""
    top = shared_dir(spark)
    if top not in _DIRS:
        _DIRS.add(top)
        atexit.register(_remove, spark, top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is None:
        return
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the gateway may have gone first
        return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again.

    Unlike a cached block, the table survives the loss of every executor."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- what a worker keeps between its tasks

_HELD: dict[str, Any] = {}


def held(key: str, build: Callable[[], Any]) -> Any:
    """The object of this key, built once a worker. A worker keeps one at a time."""
    if key not in _HELD:
        let_go()
        _HELD[key] = build()
    return _HELD[key]


def let_go() -> None:
    """Drop what an earlier stage left in this worker, since Spark gives the same workers to all stages."""
    _HELD.clear()


# --- vectorised word hashes

_RNG = np.random.default_rng(20240229)
_COEF = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) | np.uint64(1)
_STEPS = np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | bytes | None, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of every word of the text, in order; fold lower-cases A-Z first.

    Multilinear over bytes with fixed random coefficients (two words of up to 256 bytes collide with
    probability below 2^-56); the bytes beyond 256 of a word enter block by block through mix()."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else (text or b"")
    b = np.frombuffer(raw, dtype=np.uint8)
    if not b.size:
        return np.empty(0, np.uint64)
    solid = ~_BLANK[b]
    edge = np.diff(solid.view(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    if not starts.size:
        return np.empty(0, np.uint64)
    if fold:
        b = _FOLD[b]
    at = np.flatnonzero(solid)
    ends = np.flatnonzero(edge == -1)
    if ends.size < starts.size:
        ends = np.append(ends, b.size)
    lens = ends - starts
    first = np.repeat(starts, lens)
    pos = at - first
    cut = np.concatenate(([0], np.cumsum(lens)[:-1]))
    val = b[at].astype(np.uint64) + np.uint64(1)
    if lens.max() <= 256:
        h = np.add.reduceat(val * _COEF[pos], cut)
    else:
        block = (pos >> 8).astype(np.uint64)
        h = np.add.reduceat(mix(val * _COEF[pos & 255] + block * _STEP) * (block > 0) + val * _COEF[pos & 255] * (block == 0), cut)
    return mix(h + lens.astype(np.uint64) * _STEP)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words; fewer words make one shingle of all, none make none."""
    k = words.size
    if not k:
        return words
    n = min(n, k)
    h = np.zeros(k - n + 1, np.uint64)
    for i in range(n):
        h += mix(words[i : k - n + 1 + i] + _STEPS[i]) * _COEF[i]
    return mix(h + np.uint64(n))

