"""A training corpus from `documents`: toxic documents go, documents that fail the quality rules go, one
document of each near-duplicate group stays, sources are mixed to their target weights, and what is left
is packed into sequences of 2048 tokens.

Each stage reads what its predecessor wrote and works on all of it. Null texts have no words, so they fail
the quality rules; documents without id or source go through as others; repeated rows are one
near-duplicate group; an empty table gives an empty result at every stage; additional columns of the
documents are kept until the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skylark.llm import minhash, mixing, packing, rules, toxicity
from skylark.llm.common import materialise
from skylark.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below 0.5, learned from the labels outside the held-out fold."""
    ship(spark)
    return toxicity.keep_documents(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and keep enough of their lines."""
    return rules.keep_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8 or more."""
    ship(spark)
    return minhash.keep_documents(docs, words=5, percent=80, rows=6)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    ship(spark)
    return packing.pack(materialise(packing.pieces(docs, packing.tokenizer_path()), "pack-pieces"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashed draws, tokens and nearest neighbours are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
