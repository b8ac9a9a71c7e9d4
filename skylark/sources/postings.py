"""A stored inverted index: postings, terms and deletion neighbours as Parquet tables.

Postings and terms lie in folders by a hash of a token's first two characters and are sorted by token within
them, so a word or a prefix of two characters or more reads one folder, and of that the row groups whose range
holds it. A term's deletion neighbours (of terms of 2 to MOST_FUZZY characters; longer ones are compared as they
are) lie in folders by hash. A hot token is dealt over many files, since ranges end in the object's id.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylark.operators import matching

LEADS = 64
MOST_FUZZY = 20


def lead(token: Column) -> Column:
    """The folder of a token."""
    return F.pmod(F.xxhash64(F.substring(token, 1, 2)), F.lit(LEADS)).cast("int")


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(LEADS)).cast("int")


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def terms_of(post: DataFrame) -> DataFrame:
    """token, its postings and the first attribute (by rank) that has it."""
    return post.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("attr_rank").alias("first_rank"))


def neighbours(word: str, most: int) -> set[str]:
    """A word and what is left of it after up to `most` deletions."""
    return {"".join(c for i, c in enumerate(word) if i not in gone) for k in range(most + 1) for gone in combinations(range(len(word)), k)}


class Postings:
    """Postings (object_id, path, attr_rank, token, pos) and their vocabulary, derived at each use."""

    def __init__(self, post: DataFrame):
        self.post = post

    def read(self, words: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
        """The postings of words and of tokens that begin with a prefix."""
        return self.post.where(self._wanted(words, prefixes))

    @staticmethod
    def _wanted(words: Sequence[str], prefixes: Sequence[str]) -> Column:
        whole = [F.col("token").isin(sorted(set(words)))] if words else []
        return _any([*whole, *[F.startswith(F.col("token"), F.lit(p)) for p in prefixes]])

    def known(self, words: Sequence[str]) -> dict[str, int]:
        """Of the words those that are tokens, with the rank of the first attribute that has them."""
        rows = terms_of(self.read(words, [])).collect() if words else []
        return {r["token"]: r["first_rank"] for r in rows}

    def similar(self, typos: dict[str, int]) -> dict[str, dict[str, int]]:
        """For each word the tokens within its number of typos, with their distance; the word itself left out."""
        out: dict[str, dict[str, int]] = {}
        for word, term in self._candidates({w: d for w, d in typos.items() if d}):
            if 0 < (n := matching.osa_distance(word, term, typos[word])) <= typos[word]:
                out.setdefault(word, {})[term] = n
        return out

    def _candidates(self, typos: dict[str, int]) -> set[tuple[str, str]]:
        tokens = self.post.select("token").distinct()
        return {(w, r[0]) for w, d in typos.items() for r in self._near(tokens, w, d).collect()}

    @staticmethod
    def _near(tokens: DataFrame, word: str, most: int) -> DataFrame:
        """Tokens that may be within `most` typos; a swap counts twice for levenshtein."""
        close = F.char_length("token").between(len(word) - most, len(word) + most)
        return tokens.where(close & (F.levenshtein(F.col("token"), F.lit(word), 2 * most) >= 0)).select("token")


class StoredPostings(Postings):
    """Postings that were written by build()."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        super().__init__(spark.read.parquet(f"{path}/postings"))
        self.terms, self.deletions = spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/deletions")

    @staticmethod
    def build(docs: DataFrame, id_col: str, attributes: Sequence[str], path: str, placeholders: DataFrame | None = None) -> StoredPostings:
        """Tokenise the documents once and write the three tables."""
        spark = docs.sparkSession
        post = matching.postings(docs, id_col, attributes)
        if placeholders is not None:
            post = matching.place_placeholders(post, placeholders)

        def write(rows: DataFrame, name: str, *order: str) -> None:
            rows.repartitionByRange("lead", *order).sortWithinPartitions("lead", *order).write.partitionBy("lead").parquet(f"{path}/{name}")

        write(post.withColumn("lead", lead(F.col("token"))), "postings", "token", "object_id")
        write(terms_of(spark.read.parquet(f"{path}/postings")).withColumn("lead", lead(F.col("token"))), "terms", "token")
        short = spark.read.parquet(f"{path}/terms").where(F.char_length("token").between(2, MOST_FUZZY))
        keys = short.select("token", F.explode(F.array_distinct(matching.deletions(F.col("token"), 2))).alias("key"))
        write(keys.withColumn("lead", _place(F.col("key"))), "deletions", "key", "token")
        return StoredPostings(spark, path)

    @staticmethod
    def _folders(words: Sequence[str], prefixes: Sequence[str]) -> Column:
        """The folders to read; a prefix of one character may be in any."""
        if any(len(p) < 2 for p in prefixes):
            return F.lit(True)
        return _any(F.col("lead") == lead(F.lit(x)) for x in sorted({x[:2] for x in [*words, *prefixes]}))

    def read(self, words: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
        return self.post.where(self._folders(words, prefixes)).where(self._wanted(words, prefixes)).drop("lead")

    def known(self, words: Sequence[str]) -> dict[str, int]:
        if not words:
            return {}
        rows = self.terms.where(self._folders(words, [])).where(F.col("token").isin(sorted(set(words))))
        return {r["token"]: r["first_rank"] for r in rows.select("token", "first_rank").collect()}

    def _candidates(self, typos: dict[str, int]) -> set[tuple[str, str]]:
        of: dict[str, set[str]] = {}
        for w, d in typos.items():
            if len(w) <= MOST_FUZZY + d:
                for k in neighbours(w, d):
                    of.setdefault(k, set()).add(w)
        out = set()
        if of:
            keys = self.spark.createDataFrame([(k,) for k in of], "key string")
            rows = self.deletions.join(F.broadcast(keys), "key") if len(of) > 400 else self.deletions.where(F.col("key").isin(sorted(of)))
            if len(of) <= 32:
                rows = rows.where(_any(F.col("lead") == _place(F.lit(k)) for k in of))
            out = {(w, r["token"]) for r in rows.select("key", "token").collect() for w in of[r["key"]]}
        long = self.terms.where(F.char_length("token") > MOST_FUZZY)
        return out | {(w, r[0]) for w, d in typos.items() if len(w) + d > MOST_FUZZY for r in self._near(long, w, d).collect()}
