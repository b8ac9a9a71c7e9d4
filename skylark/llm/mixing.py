"""Mixing sources to target weights by pivotal dependent rounding.

A source's target share of all words gives each of its documents the same fractional number of copies.
The whole copies are certain. The fractions are rounded by pairs: words are moved at random from one
document of a pair to the other until one of the two has none or all of its fraction, and the other goes
on to the next pair. Each move keeps the pair's words and every document's expectation, so a source
misses its target by less than one document.

The pairs form a reduction tree: level 0 folds the documents of a source in chunks of about `chunk`, each
of which leaves one fractional document; level 1 folds those, and so on, log(rows) / log(chunk) levels.
A chunk is folded from its longest document to its shortest, so what is left open is mostly short.
Chunks are dealt by a hash within the source, so a hot source only has more chunks. All of it is
DataFrame and SQL functions.

A document that is long against its source's fractional words would find no partners and be rounded alone.
So of each source the documents with more than `alone` of those words, the `heads` longest at most, are
decided first, from the longest on: taken with the present fraction where both outcomes leave the rest a
fraction of 0 to 1, else by the outcome that does (or misses by less), and the rest gets the fraction that
meets the target. Where both outcomes are open this keeps every document's expectation.

Defined results: a null text has no words; a document or source without words takes none; a null source
is a source of its own and comes last; null ids and repeated rows are documents like others; an empty
table gives an empty result; other columns are ignored. The random numbers are hashes of the documents
and the seed, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, word_count

_UNIT = "struct<ns:bigint,h:bigint,doc_id:bigint,n:bigint,sure:bigint,size:bigint,q:double>"

#: Folds sorted units; the state is the one open unit and the decided ones.
_FOLD = f"""
aggregate(
  units,
  named_struct('open', cast(null AS {_UNIT}), 'done', cast(array() AS array<struct<doc_id:bigint,n:bigint,sure:bigint,size:bigint,extra:int>>)),
  (acc, b) -> CASE WHEN acc.open IS NULL THEN named_struct('open', b, 'done', acc.done) ELSE
    transform(
      array(named_struct(
        'up', least(acc.open.size * (1 - acc.open.q), b.size * b.q),
        'down', least(acc.open.size * acc.open.q, b.size * (1 - b.q)),
        'r', shiftrightunsigned(xxhash64(acc.open.h, acc.open.doc_id, b.h, b.doc_id, b.n, {{seed}}), 11) / 9007199254740992D)),
      v -> CASE
        WHEN v.r * (v.up + v.down) < v.down THEN
          CASE WHEN acc.open.size * (1 - acc.open.q) <= b.size * b.q
            THEN named_struct('open', named_struct('ns', b.ns, 'h', b.h, 'doc_id', b.doc_id, 'n', b.n, 'sure', b.sure, 'size', b.size, 'q', greatest(0D, b.q - v.up / b.size)),
                              'done', array_append(acc.done, named_struct('doc_id', acc.open.doc_id, 'n', acc.open.n, 'sure', acc.open.sure, 'size', acc.open.size, 'extra', 1)))
            ELSE named_struct('open', named_struct('ns', acc.open.ns, 'h', acc.open.h, 'doc_id', acc.open.doc_id, 'n', acc.open.n, 'sure', acc.open.sure, 'size', acc.open.size, 'q', least(1D, acc.open.q + v.up / acc.open.size)),
                              'done', array_append(acc.done, named_struct('doc_id', b.doc_id, 'n', b.n, 'sure', b.sure, 'size', b.size, 'extra', 0)))
          END
        ELSE
          CASE WHEN acc.open.size * acc.open.q <= b.size * (1 - b.q)
            THEN named_struct('open', named_struct('ns', b.ns, 'h', b.h, 'doc_id', b.doc_id, 'n', b.n, 'sure', b.sure, 'size', b.size, 'q', least(1D, b.q + v.down / b.size)),
                              'done', array_append(acc.done, named_struct('doc_id', acc.open.doc_id, 'n', acc.open.n, 'sure', acc.open.sure, 'size', acc.open.size, 'extra', 0)))
            ELSE named_struct('open', named_struct('ns', acc.open.ns, 'h', acc.open.h, 'doc_id', acc.open.doc_id, 'n', acc.open.n, 'sure', acc.open.sure, 'size', acc.open.size, 'q', greatest(0D, acc.open.q - v.down / acc.open.size)),
                              'done', array_append(acc.done, named_struct('doc_id', b.doc_id, 'n', b.n, 'sure', b.sure, 'size', b.size, 'extra', 1)))
          END
      END)[0]
  END)
"""


#: Decides the longest documents of a source one by one: words still to be taken (t) and still open (r).
_HEADS = """
aggregate(
  heads,
  named_struct('t', t, 'r', r, 'done', cast(array() AS array<struct<doc_id:bigint,n:bigint,size:bigint,extra:int>>)),
  (acc, b) -> transform(
    array(CASE
      WHEN acc.t >= b.size AND acc.t <= acc.r - b.size
        THEN shiftrightunsigned(xxhash64(b.h, b.doc_id, {seed}), 11) / 9007199254740992D * acc.r < acc.t
      WHEN acc.t <= acc.r - b.size THEN false
      WHEN acc.t >= b.size THEN true
      ELSE b.size - acc.t < acc.t - (acc.r - b.size) END),
    take -> named_struct(
      't', greatest(0D, acc.t - if(take, b.size, 0)), 'r', acc.r - b.size,
      'done', array_append(acc.done, named_struct('doc_id', b.doc_id, 'n', b.n, 'size', b.size, 'extra', if(take, 1, 0)))))[0])
"""


def targets(units: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """source, source_size, rows and target of each source of units (source, size, n).

    The weights repeat over the sources by code point, null last. Where a target would exceed cap times
    its source, the excess goes to the other sources by weight, until none is above."""
    nth = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1  # one row a source
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), nth % len(weights) + 1)
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    sources = materialise(sums.withColumn("weight", w).withColumn("most", F.col("source_size") * float(cap)), "mix-sources")
    total, level, capped = sources.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        full = F.col("most") <= F.lit(level) * F.col("weight")
        got = sources.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
            F.count_if(full)).first()
        if got[2] == capped or not got[1]:
            break
        capped, level = got[2], (total - got[0]) / got[1]
    return sources.select("source", "source_size", "rows", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def _each(df: DataFrame, count: str, number: str) -> DataFrame:
    """df with every row `count` times, numbered from 1; in two steps, so that no array grows with the count beyond count / 1024."""
    some = df.where(F.col(count) > 0).withColumn("hi", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / 1024))))
    low = F.sequence(F.lit(1).cast("long"), F.least(F.lit(1024).cast("long"), F.col(count) - F.col("hi") * 1024))
    return some.withColumn("lo", F.explode(low)).withColumn(number, F.col("hi") * 1024 + F.col("lo")).drop("hi", "lo")


def _decided_first(units: DataFrame, sources: DataFrame, alone: float, heads: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Decisions on the documents that dominate their source, and the fraction of each source's others."""
    single = units.where("n = 1 AND size > 0").join(sources.where("q > 0"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    sums = single.groupBy("source", "q").agg(F.sum("size").alias("r"))
    long = single.where(F.col("size") > F.col("q") * F.col("source_size") * alone)
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("size"), "h", "doc_id"))
    long = long.select("source", "size", "doc_id", "n", "h", place.alias("place")).where(F.col("place") <= heads)
    lists = long.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("place", "h", "doc_id", "n", "size"))).alias("heads"))
    each = sums.withColumnRenamed("source", "of").join(lists, F.col("of").eqNullSafe(F.col("source")))
    each = each.select("of", "heads", F.col("r").cast("double").alias("r"), (F.col("q") * F.col("r")).alias("t"))
    each = materialise(each.select("of", F.expr(_HEADS.format(seed=seed)).alias("s")), "mix-heads")
    done = each.select("of", F.explode("s.done").alias("d")).select("of", "d.*")
    return done, each.select("of", F.when(F.col("s.r") > 0, F.least(F.lit(1.0), F.col("s.t") / F.col("s.r"))).otherwise(0.0).alias("rest"))


def mix_units(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 17, chunk: int = 64, alone: float = 0.02,
        heads: int = 64,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """doc_id, source, size, n, source_size, target, base and extra: the n equal rows have n x base + extra copies."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(
        F.col(text_col)).alias("size"))
    units = materialise(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64(
        "doc_id", "size", F.lit(seed))), "mix-units")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = targets(units, weights, cap).withColumn("base", F.floor(share).cast("int")).withColumn("q", share - F.floor(
        share)).withColumnRenamed("source", "of")
    sources = materialise(sources, "mix-targets")
    most = sources.agg(F.max("rows")).first()[0] or 0
    first, rest = _decided_first(units, sources, alone, heads, seed)
    # equal rows are one unit: n x q copies, of which the fraction is open
    told = first.select(F.col("of").alias("s1"), F.col("doc_id").alias("d1"), F.col("size").alias("z1"), F.col("extra").alias("told"))
    same = F.col("source").eqNullSafe(F.col("s1")) & F.col("doc_id").eqNullSafe(F.col("d1")) & (F.col("size") == F.col("z1"))
    plan = (
        units.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        .join(rest, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").join(told, same, "left").drop("s1", "d1", "z1")
    )
    q = F.when(F.col("n") == 1, F.coalesce("rest", "q")).otherwise(F.col("q"))
    sure = F.when(F.col("size") > 0, F.coalesce("told", F.floor(F.col("n") * q))).otherwise(0)
    plan = plan.withColumn("sure", sure.cast("long")).withColumn("q", F.when(F.col("told").isNull() & (F.col("size") > 0),
        F.col("n") * q - F.col("sure")).otherwise(0.0))
    attributes = ["source", "source_size", "target", "rows", "base"]
    out = [plan.where("q <= 0").select("doc_id", "n", "sure", "size", *attributes, F.lit(0).alias("extra"))]
    unit = F.struct((-F.col("size")).alias("ns"), "h", "doc_id", "n", "sure", "size", "q")
    level = plan.where("q > 0").select(*attributes, unit.alias("unit"))
    width = chunk
    while True:
        last = most <= width
        dealt = F.pmod(F.xxhash64("unit.h", "unit.doc_id", F.lit(width)), F.ceil(F.col("rows") / F.lit(width)).cast(
            "long")) if not last else F.lit(0).cast("long")
        lists = level.groupBy(*attributes, dealt.alias("chunk")).agg(F.sort_array(F.collect_list("unit")).alias("units"))
        folded = materialise(lists.select(*attributes, F.expr(_FOLD.format(seed=seed)).alias("s")).select(*attributes, "s.open",
            "s.done"), "mix-level")
        out.append(folded.select(*attributes, F.explode("done").alias("d")).select("d.doc_id", "d.n", "d.sure", "d.size",
            *attributes, "d.extra"))
        level = folded.select(*attributes, F.col("open").alias("unit"))
        if last:
            break
        width *= chunk
    # what is left is one document of each source, rounded by its own fraction
    drawn = (F.shiftrightunsigned(F.xxhash64("unit.h", F.lit(seed + 1)), 11) / F.lit(2.0**53) < F.col("unit.q")).cast("int")
    out.append(level.select("unit.doc_id", "unit.n", "unit.sure", "unit.size", *attributes, drawn.alias("extra")))
    mixed = out[0]
    for more in out[1:]:
        mixed = mixed.unionByName(more)
    extra = (F.col("sure") + F.col("extra")).alias("extra")
    return mixed.select("doc_id", "source", "size", "n", "source_size", "target", F.when(F.col("size") > 0,
        F.col("base")).otherwise(0).alias("base"), extra)


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every row."""
    copies = (F.col("base") + (F.col("i") <= F.col("extra")).cast("int")).cast("long").alias("copies")
    return _each(mix_units(docs, **options), "n", "i").select("doc_id", "source", "size", "source_size", "target", copies)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns.

    Rows of equal id, source and size are dealt copies in the order of a hash, in blocks of about 10,000, so
    that no group of them is ranked in one task; equal rows are one, as often as all of them are taken."""
    units = mix_units(docs, **options).withColumn("copies", F.col("n") * F.col("base") + F.col("extra")).where("copies > 0")
    names, keys = ("m0", "m1", "m2"), ("k0", "k1", "k2")
    taken = units.select(*[F.col(c).alias(m) for c, m in zip(("doc_id", "source", "size"), names, strict=True)], "copies", "n")
    key = [F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text"))]
    row = docs.select(F.struct("*").alias("doc"), *[c.alias(k) for c, k in zip(key, keys, strict=True)])
    joined = row.join(taken, [F.col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, names, strict=True)]).drop(*names)
    alone = joined.where("n = 1").select("doc", "copies")
    equal = joined.where("n > 1").withColumn("h", F.xxhash64("doc")).groupBy(*keys, "n", "copies", "h").agg(F.first("doc").alias(
        "doc"), F.count(F.lit(1)).alias("c"))
    equal = equal.withColumn("salt", F.pmod("h", F.ceil(F.col("n") / 10_000).cast("long")))
    blocks = equal.groupBy(*keys, "salt").agg(F.sum("c").alias("s"))
    blocks = blocks.withColumn("before", F.sum("s").over(Window.partitionBy(*keys).orderBy("salt")) - F.col("s"))
    blocks = blocks.select(*[F.col(k).alias(m) for k, m in zip(keys, names, strict=True)], F.col("salt").alias("in"), "before")
    same = [F.col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, names, strict=True)]
    inside = F.sum("c").over(Window.partitionBy(*keys, "salt").orderBy("h")) - F.col("c")
    placed = equal.withColumn("inside", inside).join(blocks, [*same, F.col("salt") == F.col("in")]).withColumn("first", F.col(
        "before") + F.col("inside"))
    whole, rest = F.floor(F.col("copies") / F.col("n")), F.col("copies") % F.col("n")
    more = F.greatest(F.lit(0), F.least(F.col("first") + F.col("c"), rest) - F.least(F.col("first"), rest))
    many = placed.select("doc", (whole * F.col("c") + more).alias("copies"))
    return _each(alone.unionByName(many), "copies", "i").select("doc.*")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents in words."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (
        F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
