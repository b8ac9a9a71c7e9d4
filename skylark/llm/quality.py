"""A quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

Features of a text, each hashed to one of 2^bits slots: its words and pairs of neighbouring words (A-Z
lower-cased), the shapes of its words and of pairs (a run of letters, digits or one symbol counts as one),
and pairs of equal neighbours. A feature's value is 1 + log of its count, and a text's vector has length
1. Words are hashed over the text's bytes at once, and a score is one sparse dot product.

The weights are trained on a sample of about 2 x `per_class` labelled rows, drawn by class by a hash of
the id, of at most `class_bytes` of text a class, and weighted back to the classes' true shares. Features are
computed by all executors; the sample's vectors, which are bounded in rows and bytes, are read by one task,
that runs the updates and returns the weights other than zero.

Defined results: a null or empty text has no features, its score is that of the bias; null ids are scored
like others; repeated rows get equal scores; without both labels every score is 0.5 or the label's share;
an empty table gives an empty result; other columns are ignored. Labels, lang, source and doc_id are no
inputs of a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BLANK, mix, word_hashes
from .labelled import held_out, sample, training_rows

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x61:0x7B] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[0x30:0x3A] = ord("0")
_SHAPE[_BLANK] = 0x20
_PAIR, _KIND = np.uint64(0x9E3779B97F4A7C15), [np.uint64(k * 0x1000193) for k in range(1, 6)]


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text."""
    words = word_hashes(text)
    if not words.size:
        return np.empty(0, np.int64), np.empty(0)
    shape = _SHAPE[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    shapes = word_hashes(shape[np.diff(shape, prepend=np.uint8(0)) != 0].tobytes(), fold=False)
    parts = [mix(words + _KIND[0]), mix(shapes + _KIND[1])]
    if words.size > 1:
        parts.append(mix(words[:-1] * _PAIR + words[1:] + _KIND[2]))
        parts.append(mix(shapes[:-1] * _PAIR + shapes[1:] + _KIND[3]))
        parts.append(np.full(int((words[1:] == words[:-1]).sum()), _KIND[4], np.uint64))
    slots, n = np.unique((np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    value = 1 + np.log(n)
    return slots, value / np.linalg.norm(value)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], weight: dict[int, float], bits: int, epochs: int = 4,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """FTRL-proximal over (slots, values, label) in the given order; the last weight is the bias."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        za, na = z[at], n[at]
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2))

    bias = 1 << bits
    for _ in range(epochs):
        for slots, values, y in rows:
            at, x = np.append(slots, bias), np.append(values, 1.0)
            w = weights(at)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x)))))
            g = (p - y) * x * weight[y]
            na = n[at]
            z[at] += g - (np.sqrt(na + g * g) - np.sqrt(na)) / alpha * w
            n[at] = na + g * g
    return weights(slice(None))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 3, fold: int = 1, per_class: int = 2048,
    bits: int = 18) -> np.ndarray:
    """Weights learned from the labels outside the fold."""
    texts, total = sample(docs, training_rows(labels, label_col, folds, fold), per_class)
    if len(total) < 2:
        share = 0.5 if not total else min(0.99, max(0.01, float(next(iter(total)))))
        w = np.zeros((1 << bits) + 1)
        w[-1] = math.log(share / (1 - share))
        return w
    taken = {y: min(n, per_class) for y, n in total.items()}
    scale = sum(taken.values()) / sum(total.values())
    weight = {y: total[y] / taken[y] * scale for y in total}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t, bits) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([s.astype(np.int32) for s, _ in found], pa.list_(pa.int32())), pa.array(
                    [v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))], names=["doc_id", "label", "slots", "vals"]
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(d, s, v, y) for b in batches for d, y, s, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(),
            [np.array(x.values, np.int64) for x in b.column(2)], [np.array(x.values, np.float64) for x in b.column(3)], strict=True)]
        rows.sort(key=lambda r: (int(mix(np.array([r[0]], np.int64).view(np.uint64))[0]), r[0]))
        w = train([(s, v, y) for _, s, v, y in rows], weight, bits)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at])], names=["slot", "w"])

    model = texts.select("doc_id", "label", "text").mapInArrow(vectors,
        "doc_id long, label int, slots array<int>, vals array<float>").repartition(1).mapInArrow(learn, "slot int, w double").toPandas()
    w = np.zeros((1 << bits) + 1)
    w[model["slot"].to_numpy()] = model["w"].to_numpy()
    return w


def score(docs: DataFrame, w: np.ndarray, folds: int = 3, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    bits = (w.size - 1).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(w.astype(np.float32))  # 2^bits weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for b in batches:
            margin = np.empty(b.num_rows)
            for i, t in enumerate(b.column(2)):
                slots, values = features(t.as_py(), bits)
                margin[i] = v[slots] @ values + v[-1]
            p = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    key = F.col(id_col).cast("long")
    return docs.select(key.alias("doc_id"), held_out(key, folds, fold).alias("held_out"), F.col(text_col).cast(
        "string")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """The quality of all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))
