"""Near-duplicate removal by min-max hashing.

Every function of a document's shingle hashes keeps its minimum and its maximum, two unbiased values for
one evaluation. A band is `rows` such values; documents that share a band's value are candidates. With 50
bands of 8 values a pair at a similarity of 0.85 is missed with probability 1.2e-7, with bands of 6 a pair
at 0.80 with 2.5e-7.

Copies are one node: documents with equal shingle sets (two 64-bit keys). A bucket links its nodes to its
smallest one, so no group is expanded into pairs; the components of these links are clusters of candidates.
A cluster of at most `block` nodes is compared at once. A larger one may be a chain of candidates unlike each
other, so there each bucket is compared on its own, buckets with the same nodes once: every two linked
documents share a bucket, and the work follows the size of buckets, not that of chains. A bucket of more than
`block` nodes or `block_bytes` bytes of text is divided into blocks, of which every two meet in one task, so
that no link is lost and no task holds more than two blocks. Texts are compared on their full sets, common
shingles counted as a matrix product. A task returns a spanning forest of the links it confirms, and the
components of these are the result.

Defined results: without words a set is empty and the document is alone; a null text has no words; null
ids come last in a component (its id is null only if all are); repeated rows and equal texts are one
class; an empty table gives an empty result; other columns are kept by keep_documents() and ignored by
link().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _STEP, let_go, materialise, mix, shingle_hashes, word_hashes
from .components import components

BANDS = 50
_NONE = -(2**63)


def shingles(text: str | None, n: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(word_hashes(text), n))


class Signer:
    """Band values of a shingle set."""

    def __init__(self, rows: int, bands: int = BANDS, seed: int = 11):
        rng = np.random.default_rng(seed)
        count = bands * rows // 2
        self.a = (rng.integers(0, 2**63, count, dtype=np.uint64) << np.uint64(1) | np.uint64(1))[:, None]
        self.b = rng.integers(0, 2**63, count, dtype=np.uint64)[:, None]
        self.fold = rng.integers(0, 2**63, (1, rows), dtype=np.uint64) | np.uint64(1)
        self.bands, self.rows = bands, rows

    def __call__(self, s: np.ndarray) -> np.ndarray:
        low, high = np.empty(self.a.size, np.uint64), np.empty(self.a.size, np.uint64)
        for first in range(0, s.size, 4096):
            part = s[first : first + 4096]
            for k in range(0, self.a.size, 20):
                h = (part ^ self.b[k : k + 20]) * self.a[k : k + 20]
                lo, hi = h.min(axis=1), h.max(axis=1)
                if first:
                    lo, hi = np.minimum(lo, low[k : k + 20]), np.maximum(hi, high[k : k + 20])
                low[k : k + 20], high[k : k + 20] = lo, hi
        values = np.concatenate([low.reshape(self.bands, -1), high.reshape(self.bands, -1)], axis=1)
        return mix((mix(values) * self.fold).sum(axis=1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64) * _STEP)


def signatures(docs: DataFrame, words: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n, two set keys and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        sign = Signer(rows)
        for b in batches:
            n, k1, k2, bands = [], [], [], []
            for t in b.column(2):
                s = shingles(t.as_py(), words)
                n.append(s.size)
                k1.append(int(mix(s + _STEP).sum(dtype=np.uint64).view(np.int64)) if s.size else 0)
                k2.append(int(mix(s ^ _STEP).sum(dtype=np.uint64).view(np.int64)) if s.size else 0)
                bands.append(sign(s).view(np.int64) if s.size else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(k1, pa.int64()),
                pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_key", "n", "k1", "k2", "bands"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _key(text), text.alias("text")).mapInArrow(run,
        "doc_id long, text_key long, n long, k1 long, k2 long, bands array<long>")


def _key(text):
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key")


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def confirm(texts: DataFrame, words: int, percent: int, block: int, block_bytes: int) -> DataFrame:
    """Links (u, v) between nodes of the groups of texts (node, grp, text)."""
    sizes = texts.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("text")).alias("bytes"))
    parts = F.ceil(F.greatest(F.col("m") / block, F.col("bytes") / block_bytes)).cast("int")
    large = sizes.select("grp", parts.alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("part", q).alias("i"),
        F.greatest("part", q).alias("j")))
    placed = texts.join(large, "grp", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", part)
    groups = placed.select("node", "text", "grp", F.explode(meet).alias("at"))
    groups = groups.select(F.xxhash64("grp", "at.i", "at.j").alias("g"), "node", "text")

    def links(keys: list[int], bodies: list[str]) -> list[tuple[int, int]]:
        nodes = dict(zip(keys, bodies, strict=True))  # a repeated row is the same node
        if len(nodes) < 2:
            return []
        keys = sorted(nodes)
        sets = [shingles(nodes[k], words) for k in keys]
        size = np.array([s.size for s in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        _, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = df > 1  # a shingle of one set adds to no intersection
        column = np.cumsum(shared) - 1
        keep = shared[at]
        owner, column = owner[keep], column[at[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        width = max(1024, (1 << 22) // len(sets))
        for first in range(0, int(shared.sum()), width):
            lo, hi = np.searchsorted(column, [first, first + width])
            m = np.zeros((len(sets), width), np.float32)
            m[owner[lo:hi], column[lo:hi] - first] = 1
            common += m @ m.T
        joint = common.astype(np.int64)
        linked = 100 * joint >= percent * (size[:, None] + size[None, :] - joint)
        np.fill_diagonal(linked, True)
        label = np.arange(len(sets))
        while True:
            new = np.where(linked, label[None, :], len(sets)).min(axis=1)
            new = new[new]
            if (new == label).all():
                break
            label = new
        return [(keys[i], keys[int(r)]) for i, r in enumerate(label) if i != r]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        group, keys, bodies, out = None, [], [], []
        for b in batches:
            for g, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if g != group:
                    out += links(keys, bodies)
                    group, keys, bodies = g, [], []
                keys.append(k)
                bodies.append(t)
        out += links(keys, bodies)
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())],
            names=["u", "v"])

    # a number of partitions of its own, since the work of a row is not its size
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.repartition(tasks, "g").sortWithinPartitions("g").mapInArrow(run, "u long, v long")


def _groups(keys: DataFrame, block: int) -> DataFrame:
    """node and grp of what is compared together; keys are (node, band)."""
    buckets = keys.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot <> last").select(
        "band", "pivot")
    shared = materialise(keys.join(buckets, "band"), "minhash-shared")
    found = components(shared.where("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")))
    members = found.select("node", F.col("root").alias("cluster"))
    members = members.unionByName(members.select(F.col("cluster").alias("node"), "cluster").distinct())
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"))
    members = members.join(sizes, "cluster")
    small = members.where(F.col("m") <= block).select("node", F.xxhash64(F.lit(0), "cluster").alias("grp"))
    chained = materialise(shared.join(members.where(F.col("m") > block).select("node"), "node", "left_semi"), "minhash-chained")
    # buckets with the same nodes have the same number and sums; one of them is compared
    total = [F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(20,0)")) for i in (0, 1)]
    distinct = chained.groupBy("band").agg(F.count(F.lit(1)).alias("m"), total[0].alias("a"), total[1].alias("b"))
    distinct = distinct.groupBy("m", "a", "b").agg(F.min("band").alias("band"))
    large = chained.join(distinct.select("band"), "band").select("node", F.xxhash64(F.lit(1), "band").alias("grp"))
    return small.unionByName(large)


def classes(
    docs: DataFrame, words: int = 3, percent: int = 85, rows: int = 8, block: int = 256, block_bytes: int = 16 << 20
) -> tuple[DataFrame, DataFrame]:
    """The signature table of all rows, and root, component id and first (doc_id, text_key) of every node."""
    rows_ = materialise(signatures(docs, words, rows), "minhash-rows")
    plain = rows_.where("n > 0")
    # the smallest id of a set, nulls last, with the key of one of its texts
    ident = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    sets = plain.groupBy("k1", "k2").agg(F.min(ident).alias("first"), F.first("bands").alias("bands"))
    # a node's number is drawn once, as the table is written
    sets = materialise(sets.withColumn("node", F.monotonically_increasing_id()), "minhash-sets")
    groups = materialise(_groups(sets.select("node", F.explode("bands").alias("band")), block), "minhash-groups")
    picked = groups.select("node").distinct().join(sets.select("node", F.col("first.doc_id").alias("want_id"),
        F.col("first.text_key").alias("want_key")), "node")
    text = F.col("text").cast("string")
    bodies = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(text), text.alias("text"))
    found = bodies.join(picked, (F.col("text_key") == F.col("want_key")) & _same("doc_id", "want_id")).select("node", "text")
    texts = groups.join(found.dropDuplicates(["node"]), "node")
    linked = components(confirm(texts, words, percent, block, block_bytes))
    nodes = sets.select("k1", "k2", "node", "first").join(linked, "node", "left").select("k1", "k2", F.coalesce("root",
        "node").alias("root"), "first")
    least = nodes.groupBy("root").agg(F.min("first").alias("least"))
    return rows_, nodes.join(least, "root").select("k1", "k2", "root", F.col("least.doc_id").alias("component_id"), F.col(
        "least.text_key").alias("least_key"))


def link(docs: DataFrame, words: int = 3, percent: int = 85, rows: int = 8, block: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows_, nodes = classes(docs, words, percent, rows, block)
    joined = rows_.select("doc_id", "n", "k1", "k2").join(nodes.select("k1", "k2", "component_id", F.lit(True).alias("hit")),
        ["k1", "k2"], "left")
    component = F.when(F.col("hit"), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col(
        "doc_id").eqNullSafe(F.col("component_id")))


def keep_documents(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = 6, block: int = 256) -> DataFrame:
    """One row of each class, that with the smallest id, with all its columns; rows without words stay."""
    rows_, nodes = classes(docs, words, percent, rows, block)
    kept = nodes.select("component_id", "least_key").distinct()
    packed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), _key(F.col("text").cast("string")),
        F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("some"))
    chosen = packed.join(kept, (F.col("text_key") == F.col("least_key")) & _same("id", "component_id"), "left_semi").where("some")
    if not rows_.where("n > 0").groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        chosen = chosen.dropDuplicates(["id", "text_key"])  # only repeated rows need it
    return chosen.select("doc.*").unionByName(packed.where("some IS NULL OR NOT some").select("doc.*"))


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT u, v FROM pairs JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * c >= 85 * (nu.n + nv.n - c)
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v
), least AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w
 JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""
