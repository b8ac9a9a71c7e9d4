"""Text matching over a postings table: every query of a batch is a row, so one plan answers them all."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylark.functions.text import allowed_typos, attribute_weights, tokenize


def postings(docs: DataFrame, id_col: str, attributes: Sequence[str], analyser=tokenize) -> DataFrame:
    """object_id, path, attr_rank, token, pos of every searchable text."""
    texts = F.array(*[F.struct(F.lit(a).alias("path"), F.lit(i).alias("attr_rank"), F.col(a).cast("string").alias("text")) for i,
        a in enumerate(attributes)])
    rows = docs.select(F.col(id_col).alias("object_id"), F.explode(texts).alias("t")).where("t.text IS NOT NULL")
    rows = rows.select("object_id", "t.path", "t.attr_rank", F.posexplode(analyser(F.col("t.text"))).alias("n", "k"))
    kind = dict(rows.dtypes)["k"]
    return rows.select("object_id", "path", "attr_rank", F.col("k.token").alias("token"), F.col("k.pos").alias(
        "pos")) if kind.startswith("struct") else rows.select("object_id", "path", "attr_rank", F.col("k").alias("token"), F.col(
        "n").alias("pos"))


def vocabulary(post: DataFrame) -> DataFrame:
    """token and the number of objects that have it."""
    return post.groupBy("token").agg(F.count_distinct("object_id").alias("n"))


def parse_queries(queries: DataFrame, mode: str = "prefixLast") -> DataFrame:
    """query_id, qpos, token, prefix, n of each word of queries (query_id, text).

    A last word is a prefix in the mode prefixLast unless a blank follows it; all are in prefixAll."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = queries.select("query_id", F.col("text").rlike(r"\s$").alias("ended"), words.alias("w")).select("query_id", "ended",
        F.size("w").alias("n"), F.posexplode("w").alias("qpos", "token"))
    prefix = {"prefixAll": F.lit(True), "prefixNone": F.lit(False), "prefixLast": (F.col("qpos") == F.col("n") - 1) & ~F.col("ended")}[mode]
    return rows.select("query_id", "qpos", "token", prefix.alias("prefix"), "n")


def match(post: DataFrame, words: DataFrame, weights: dict[str, float] | None = None, vocab: DataFrame | None = None) -> DataFrame:
    """query_id, object_id, score of the objects that have every word of a query; words as of parse_queries.

    Words meet the vocabulary first: whole words by equality, prefixes by equality of their first two
    characters and then by a comparison, so no join is without a key and postings are read only for terms
    that a query needs. vocab is a stored vocabulary; without it, it is derived from the postings."""
    v = vocab.select("token") if vocab is not None else post.select("token").distinct()
    whole = words.where("NOT prefix").join(v.withColumnRenamed("token", "term"), F.col("token") == F.col("term"))
    # one-letter prefixes meet by one character, longer ones by two
    lead = words.where("prefix").withColumn("k", F.substring("token", 1, 2))
    terms = v.select(F.col("token").alias("term")).withColumn("k", F.explode(
        F.array_distinct(F.array(F.substring("term", 1, 1), F.substring("term", 1, 2)))))
    begun = lead.join(terms, "k").where(F.startswith("term", "token")).drop("k")
    needed = whole.select("query_id", "qpos", "n", "term").unionByName(begun.select("query_id", "qpos", "n", "term"))
    weight = F.lit(1.0)
    for path, w in (weights or {}).items():
        weight = F.when(F.col("path") == path, w).otherwise(weight)
    # dealt once by query and object, which serves both aggregations
    found = post.join(needed, post["token"] == needed["term"]).repartition("query_id", "object_id")
    hits = found.groupBy("query_id", "object_id", "n", "qpos").agg(F.max(weight).alias("w"))
    return hits.groupBy("query_id", "object_id", "n").agg(F.count(F.lit(1)).alias("found"), F.sum("w").alias("score")).where(
        "found = n").select("query_id", "object_id", "score")


def osa_distance(a: str, b: str, most: int) -> int:
    """Edits between two words where a swap of neighbours is one; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


@F.pandas_udf(T.IntegerType())
def _osa(pairs: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b, d in pairs:
        yield pd.Series([osa_distance(x, y, z) for x, y, z in zip(a, b, d, strict=True)], dtype="int32")


def deletions(word: Column, most: int) -> Column:
    """A word and what is left of it after up to `most` (1 or 2) deletions."""
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1),
        F.substring(w, i + 1, F.lit(1 << 20))))
    one = F.when(F.char_length(word) > 0, cut(word)).otherwise(F.array().cast("array<string>"))
    out = F.array_union(F.array(word), one)
    return F.array_union(out, F.flatten(F.transform(F.filter(one, lambda w: F.char_length(w) > 0), cut))) if most > 1 else out


def fuzzy_terms(words: DataFrame, vocab: DataFrame, typos: Column | None = None) -> DataFrame:
    """(word, term, typos): terms within the typos that a word may have.

    Candidates share a deletion neighbour, an equality join over the vocabulary; only they are verified."""
    w = words.select(F.lower("token").alias("word")).distinct().withColumn("d", allowed_typos(F.col("word")) if typos is None else typos)
    near = w.select("word", "d", F.explode(F.when(F.col("d") == 2, deletions(F.col("word"), 2)).when(F.col("d") == 1,
        deletions(F.col("word"), 1)).otherwise(F.array("word"))).alias("k"))
    reach = vocab.select(F.col("token").alias("term")).distinct().select("term", F.explode(deletions(F.col("term"), 2)).alias("k"))
    pairs = near.join(reach, "k").select("word", "term", "d").distinct()
    return pairs.withColumn("typos", _osa("word", "term", "d")).where("typos <= d").select("word", "term", "typos")


def typo_tolerance(hits: DataFrame, mode: str = "true") -> DataFrame:
    """hits (query_id, typos, ...) as the mode keeps them: all, none with typos, fewest, or the two fewest."""
    if mode == "true":
        return hits
    if mode == "false":
        return hits.where("typos = 0")
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy("typos"))
    return hits.withColumn("r", rank).where(F.col("r") <= (1 if mode == "min" else 2)).drop("r")


def expand_synonyms(words: DataFrame, synonyms: DataFrame) -> DataFrame:
    """words with their alternatives: (query_id, qpos, token, typo_cost). synonyms: (type, input, words).

    Types: synonym (all words of the row stand for each other), oneWaySynonym (input to words) and
    altCorrection1/2 (input to words, at the cost of 1 or 2 typos)."""
    both = synonyms.where("type = 'synonym'").select(F.explode("words").alias("from"), "words").select("from", F.explode(
        "words").alias("to"), F.lit(0).alias("typo_cost")).where("`from` <> `to`")
    one = synonyms.where("type <> 'synonym'").select(F.col("input").alias("from"), F.explode("words").alias("to"), F.when(
        F.col("type") == "altCorrection1", 1).when(F.col("type") == "altCorrection2", 2).otherwise(0).alias("typo_cost"))
    edges = both.unionByName(one)
    base = words.select("query_id", "qpos", "token", F.lit(0).alias("typo_cost"))
    more = words.join(edges, F.col("token") == F.col("from")).select("query_id", "qpos", F.col("to").alias("token"), edges["typo_cost"])
    return base.unionByName(more).groupBy("query_id", "qpos", "token").agg(F.min("typo_cost").alias("typo_cost"))


def place_placeholders(post: DataFrame, synonyms: DataFrame) -> DataFrame:
    """postings with the placeholder tokens' replacements: an index-side expansion (placeholder, replacements)."""
    s = synonyms.select(F.lower("placeholder").alias("token"), F.explode("replacements").alias("to"))
    return post.unionByName(post.join(s, "token").select("object_id", "path", "attr_rank", F.lower("to").alias("token"), "pos"))


def exact_phrase(post: DataFrame, phrase: Sequence[str]) -> DataFrame:
    """object_id of objects with the words side by side in one attribute: their positions less their places meet."""
    places = F.lit(None).cast("array<int>")
    want = {}
    for i, w in enumerate(phrase):
        want.setdefault(w.lower(), []).append(i)
    for w, at in want.items():
        places = F.when(F.col("token") == w, F.array(*map(F.lit, at))).otherwise(places)
    hit = post.where(F.col("token").isin(list(want))).select("object_id", "path", "pos", F.explode(places).alias("i"))
    return hit.groupBy("object_id", "path", (F.col("pos") - F.col("i")).alias("at")).agg(F.count_distinct("i").alias("n")).where(
        F.col("n") == len(phrase)).select("object_id").distinct()


def exclude_words(hits: DataFrame, post: DataFrame, words: Sequence[str]) -> DataFrame:
    return hits.join(post.where(F.col("token").isin([w.lower() for w in words])).select("object_id").distinct(), "object_id", "left_anti")


def relax(words: DataFrame, how: str, most: int = 5) -> DataFrame:
    """Words with a column `round`: round 0 is the whole query; later rounds drop words (lastWords, firstWords) or make all optional."""
    if how == "none":
        return words.withColumn("round", F.lit(0))
    if how == "allOptional":
        return words.withColumn("round", F.explode(F.array(F.lit(0), F.lit(1))))
    rounds = words.withColumn("round", F.explode(F.sequence(F.lit(0), F.least(F.lit(most), F.col("n") - 1))))
    left = F.col("n") - F.col("round")
    keep = F.col("qpos") < left if how == "lastWords" else F.col("qpos") >= F.col("round")
    return rounds.where(keep).withColumn("n", left)


def cosine_neighbours(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
    block: int = 1024) -> DataFrame:
    """query_id, vec_id, similarity, rank: exact cosine of a stated query set against all rows.

    Blocks of about `block` queries meet blocks of rows in tasks, each pair of blocks once, as a matrix product;
    a task keeps the k best of each of its queries, so neither set needs to fit a task or the driver. A vector
    without length has no neighbours."""
    spark = vectors.sparkSession
    count = max(1, -(-queries.count() // block))
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = max(1, cells // count)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.lit(False).alias("asks"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(width)).cast("int")).withColumn("grp", F.explode(
        F.sequence(F.lit(0), F.lit(count - 1))))
    asks = queries.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.lit(True).alias("asks"))
    asks = asks.withColumn("grp", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(count)).cast("int")).withColumn("part", F.explode(
        F.sequence(F.lit(0), F.lit(width - 1))))
    both = rows.unionByName(asks).where("v IS NOT NULL").repartition(cells, "grp", "part").sortWithinPartitions("grp", "part",
        F.desc("asks"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, units, kept = None, None, None, None

        def unit(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            m = np.array(b.column("v").to_pylist(), np.float64).reshape(b.num_rows, -1)
            n = np.sqrt((m * m).sum(axis=1, keepdims=True))
            return np.array(b.column("id").to_pylist()), np.where(n > 0, m / np.where(n > 0, n, 1), np.nan)

        def flush() -> Iterator[pa.RecordBatch]:
            if kept:
                found = [(a, i, s) for a, best_ in kept.items() for s, i in best_]
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c,
                    t in enumerate((id_type, id_type, pa.float64()))], names=["query_id", "id", "similarity"])

        id_type = None
        for b in batches:
            id_type = b.schema.field("id").type
            keys = np.stack([b.column("grp").to_numpy(), b.column("part").to_numpy(), ~b.column("asks").to_numpy(
                zero_copy_only=False)], axis=1)
            edges = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for lo, hi in zip([0, *edges], [*edges, b.num_rows], strict=True):
                cell, rows_ = tuple(keys[lo][:2]), bool(keys[lo][2])
                if cell != at:
                    yield from flush()
                    at, ids, units, kept = cell, [], [], {}
                i, u = unit(b.slice(lo, hi - lo))
                if not rows_:
                    ids.append(i)
                    units.append(u)
                    continue
                if not ids:
                    continue
                ids, units = [np.concatenate(ids)], [np.concatenate(units)]
                near = np.round(units[0] @ u.T, 6)
                for q, a in enumerate(ids[0].tolist()):
                    s = near[q]
                    ok = np.flatnonzero((i != a) & ~np.isnan(s))
                    if ok.size > k:
                        cut = np.partition(s[ok], ok.size - k)[ok.size - k]
                        ok = ok[s[ok] >= cut]
                    kept[a] = sorted([*kept.get(a, []), *zip(s[ok].tolist(), i[ok].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
        yield from flush()

    found = both.mapInArrow(best, f"query_id {kind}, id {kind}, similarity double").withColumnRenamed("id", id_col)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def weights_table(spark, searchable: Sequence[str], override=None) -> DataFrame:
    return spark.createDataFrame([(a, i, w) for i, (a, w) in enumerate(attribute_weights(searchable, override).items())],
        "attribute string, attr_rank int, weight double")


def text_leaves(schema: T.StructType, skip: Sequence[str] = ()) -> list[tuple[str, Column]]:
    """(dotted path, text) of all strings of nested documents; the texts of an array are joined by blanks."""
    out: list[tuple[str, Column]] = []

    def walk(kind: T.DataType, path: str, get) -> None:
        if isinstance(kind, T.StringType):
            out.append((path, get))
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}", get[f.name])
        elif isinstance(kind, T.ArrayType):
            probe: list[tuple[str, list[str]]] = []

            def names(k: T.DataType, at: list[str]) -> None:
                if isinstance(k, T.StringType):
                    probe.append((".".join([path, *at]), at))
                elif isinstance(k, T.StructType):
                    for f in k.fields:
                        names(f.dataType, [*at, f.name])

            names(kind.elementType, [])
            for p, at in probe:
                out.append((p, F.array_join(F.transform(get, _member(at)), " ")))

    for f in schema.fields:
        if f.name not in skip:
            walk(f.dataType, f.name, F.col(f"`{f.name}`"))
    return out


def _member(at: list[str]):
    def get(x: Column) -> Column:
        for name in at:
            x = x[name]
        return x

    return get


def nested_texts(docs: DataFrame, id_col: str = "object_id") -> DataFrame:
    """object_id, path and text of every text of nested documents, for postings by path."""
    leaves = [F.struct(F.lit(p).alias("path"), c.alias("text")) for p, c in text_leaves(docs.schema, [id_col])]
    return docs.select(F.col(id_col).alias("object_id"), F.explode(F.array(*leaves)).alias("t")).select("object_id", "t.*").where(
        "text IS NOT NULL")
