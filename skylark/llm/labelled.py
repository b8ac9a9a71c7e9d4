"""A bounded sample of labelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

_SPAN = 1 << 30


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls on the fold; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_rows(labels: DataFrame, label_col: str, folds: int, fold: int, id_col: str = "doc_id") -> DataFrame:
    """doc_id and label (0 or 1) of the rows that may be learned from; a repeated id counts once, by its largest label."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    return rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold)).groupBy(
        "doc_id").agg(F.max("label").alias("label"))


def sample(
    docs: DataFrame, rows: DataFrame, per_class: int, class_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, label and text of a sample of each label, and all labels' counts.

    Of each label about `per_class` ids are drawn by a hash, whatever the input, and of those, in the order of
    the hash, as many as have `class_bytes` of text together (one at least). An id with several texts has one,
    the smallest in order. The sample is written as a table; only its ids and sizes come to the driver."""
    total = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0)
    for y, n in total.items():
        share = F.when(F.col("label") == y, F.lit(int(_SPAN * min(1.0, per_class / n)))).otherwise(share)
    few = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(_SPAN)) < share)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    drawn = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    drawn = materialise(drawn, "sample")
    sizes = drawn.select("label", "doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).collect()
    used, gone = dict.fromkeys(total, 0), []
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if used[r["label"]] and used[r["label"]] + r["n"] > class_bytes:
            gone.append(r["doc_id"])
        else:
            used[r["label"]] += r["n"] + 1
    return (drawn.where(~F.col("doc_id").isin(gone)) if gone else drawn), total
