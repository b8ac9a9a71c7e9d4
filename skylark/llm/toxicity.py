"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, over a block-max inverted index.

Terms are words and beginnings of words (4 to 6 letters) that the labelled sample ties to the label: the
log-likelihood ratio is at least `strength`, and of the texts with the term at least half are toxic when
classes have their true shares. A term's idf counts all documents. Examples are sorted by their heaviest
term and indexed in blocks; each term keeps its postings and its largest weight in each block. A search
visits blocks by falling upper bound and stops when the next bound is below the k-th similarity, so it
is exact. The k nearest vote with their similarity, classes weighted to their true shares, and a prior
that stands for `pull` votes. A text without any term is compared as a whole with the examples without any
term: its near copies among them vote likewise, with their similarity; without one it gets the toxic share
of such examples. Evidence: the nearest examples with similarity and label.

The examples are a sample of about 2 x `per_class` labelled rows, of whose near copies (5-word shingles,
similarity 0.8 or more by the 128 smallest hashes) one stays, as copies would tie the words of one text to
its label; the index is bounded by the sample and goes to every executor. Each text is read whole by an Aho-Corasick automaton of the terms.

Defined results: a null or empty text has no terms; null ids are scored like others; repeated rows get
equal scores; without both labels all texts get the toxic share; an empty table
gives an empty result; other columns are kept by keep_documents() and ignored by score(). Labels, lang,
source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let_go, materialise, mix, shingle_hashes, word_hashes
from .labelled import held_out, sample, training_rows

_WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6)
SKETCH = 128


def terms_of(text: str) -> set[str]:
    """A text's words, and their beginnings marked by a star."""
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) > n}


def _g2(a: Column, b: Column, na: int, nb: int) -> Column:
    """Log-likelihood ratio of a in na against b in nb."""
    out = F.lit(0.0)
    for k, n in ((a, na), (b, nb)):
        e = (a + b) * n / (na + nb)
        f = n - e
        out += F.when(k > 0, k * F.log(k / e)).otherwise(0.0) + F.when((F.lit(n) > k) & (f > 0), (n - k) * F.log(
            (n - k) / f)).otherwise(0.0)
    return 2 * out


@dataclass
class Finder:
    """Counts of the terms in a text."""

    terms: list[str]
    automaton: object = field(default=None, init=False, repr=False, compare=False)

    def __getstate__(self):
        return {"terms": self.terms, "automaton": None}

    def __call__(self, text: str | None) -> dict[int, int]:
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for i, t in enumerate(self.terms):
                key = t.rstrip("*")
                self.automaton.add_word(key, [*self.automaton.get(key, []), (i, len(key), t.endswith("*"))])
            self.automaton.make_automaton()
        low, got = (text or "").lower(), Counter()
        if not self.terms:
            return got
        for end, found in self.automaton.iter(low):
            for i, n, begins in found:
                at = end - n
                if at >= 0 and (low[at].isalnum() or low[at] == "_"):
                    continue
                more = end + 1 < len(low) and (low[end + 1].isalnum() or low[end + 1] == "_")
                if more == begins:
                    got[i] += 1
        return got


class BlockMax:
    """Examples under TF-IDF, normalised to length 1."""

    def __init__(self, vectors: list[dict[int, int]], labels: list[int], ids: list[int], idf: np.ndarray, votes: dict[int, float],
        width: int = 64):
        self.idf, self.width = idf, width
        weighed = [self.vector(v) for v in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (int(weighed[i][0][np.argmax(weighed[i][1])]) if len(weighed[i][0])
            else -1, ids[i]))
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.labels = np.array([labels[i] for i in order], np.int32)
        self.votes = np.array([votes[y] for y in self.labels], np.float64)
        blocks = max(1, -(-len(order) // width))
        self.top = np.zeros((idf.size, blocks))
        postings: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for at, i in enumerate(order):
            for t, w in zip(*weighed[i], strict=True):
                postings.setdefault((int(t), at // width), []).append((at % width, w))
        self.postings = {}
        for (t, b), p in postings.items():
            self.postings[t, b] = np.array([x for x, _ in p]), np.array([w for _, w in p])
            self.top[t, b] = max(w for _, w in p)

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        t = np.array(sorted(counts), np.int64)
        if not t.size:
            return t, np.empty(0)
        w = np.array([1 + math.log(counts[int(i)]) for i in t]) * self.idf[t]
        return t, w / np.linalg.norm(w)

    def nearest(self, counts: dict[int, int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and similarities of the k nearest with a term in common; ties by position."""
        t, q = self.vector(counts)
        bound = q @ self.top[t]
        found: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(found) == k and bound[b] < -found[-1][0] - 1e-12:
                break
            s = np.zeros(self.width)
            for i, w in zip(t, q, strict=True):
                if (p := self.postings.get((int(i), int(b)))) is not None:
                    s[p[0]] += w * p[1]
            found += [(-s[i], int(b) * self.width + int(i)) for i in np.flatnonzero(s)]
            found = sorted(found)[:k]
        return np.array([i for _, i in found], np.int64), np.array([-s for s, _ in found])


def _sketch(text: str | None) -> np.ndarray:
    """The 128 smallest hashes of a text's different 5-word shingles, ascending; wordless texts are equal."""
    got = np.unique(mix(shingle_hashes(word_hashes(text), 5)))[:SKETCH]
    return got if got.size else np.zeros(1, np.uint64)


class Copies:
    """Sketches by their hashes, to find near copies: exact for texts of up to 128 shingles, else estimated."""

    def __init__(self, sketches: list[np.ndarray]):
        self.sketches = sketches
        self.sizes = np.array([x.size for x in sketches], np.int64)
        at = np.repeat(np.arange(len(sketches)), self.sizes)
        every = np.concatenate([*sketches, np.empty(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.hashes, self.owner = every[order], at[order]

    def near(self, sketch: np.ndarray, least: float = 0.8) -> list[tuple[int, float]]:
        """Places and similarities of all sketches at least so similar, most similar first."""
        low, high = np.searchsorted(self.hashes, sketch, "left"), np.searchsorted(self.hashes, sketch, "right")
        hit = [self.owner[a:b] for a, b in zip(low, high, strict=True) if b > a]
        if not hit:
            return []
        common = np.bincount(np.concatenate(hit), minlength=self.sizes.size)
        found = []
        for i in np.flatnonzero(common >= least * np.maximum(self.sizes, sketch.size)):
            x = np.union1d(sketch, self.sketches[i])[:SKETCH]
            both = np.intersect1d(np.intersect1d(sketch, self.sketches[i], True), x, True).size
            if both >= least * x.size:
                found.append((int(i), both / x.size))
        return sorted(found, key=lambda f: (-f[1], f[0]))


@dataclass
class Model:
    finder: Finder
    index: BlockMax | None
    base: float
    bare: float
    k: int
    pull: float
    #: examples without any term, their ids, labels and votes
    copies: Copies | None = None
    about: tuple[list[int], np.ndarray, np.ndarray] | None = None
    _seen: dict = field(default_factory=dict, repr=False)

    def __call__(self, text: str | None) -> tuple[float, list]:
        counts = self.finder(text) if self.index is not None else {}
        if not counts:
            return self._alike(text)
        key = tuple(sorted(counts.items()))
        if key not in self._seen:
            if len(self._seen) > 20_000:
                self._seen.clear()
            at, s = self.index.nearest(counts, self.k)
            vote = s * self.index.votes[at]
            p = (float(vote @ self.index.labels[at]) + self.pull * self.base) / (float(vote.sum()) + self.pull)
            self._seen[key] = p, [{"doc_id": int(self.index.ids[i]), "similarity": float(x), "label": int(self.index.labels[i])}
                for i, x in zip(at[:3], s[:3], strict=True)]
        return self._seen[key]

    def _alike(self, text: str | None) -> tuple[float, list]:
        """The vote of the near copies of a text without terms."""
        found = self.copies.near(_sketch(text))[: self.k] if self.copies is not None else []
        if not found:
            return self.bare, []
        ids, labels, votes = self.about
        at = [i for i, _ in found]
        vote = np.array([s for _, s in found]) * votes[at]
        p = (float(vote @ labels[at]) + self.pull * self.base) / (float(vote.sum()) + self.pull)
        return p, [{"doc_id": ids[i], "similarity": s, "label": int(labels[i])} for i, s in found[:3]]


def _crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _different(texts: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Id and crc32 of the texts, in the order of ids, that are no near copy of an earlier one of their label, with their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(_crc, got), pa.int64()),
                pa.array([_sketch(t).tobytes() for t in got], pa.binary())], names=["doc_id", "label", "crc", "sketch"])

    rows = sorted(texts.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, crc long, sketch binary").collect())
    sketches = [np.frombuffer(r["sketch"], np.uint64) for r in rows]
    stay: dict[tuple[int, int], np.ndarray] = {}
    for y in (0, 1):
        of = [i for i, r in enumerate(rows) if r["label"] == y]
        copies, gone = Copies([sketches[i] for i in of]), set()
        for k, i in enumerate(of):
            if k not in gone:
                stay[rows[i]["doc_id"], rows[i]["crc"]] = sketches[i]
                gone.update(j for j, _ in copies.near(sketches[i]) if j > k)
    return stay


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 5, fold: int = 0, per_class: int = 2048,
    strength: float = 24.0, k: int = 15, pull: float = 0.05) -> Model:
    """The terms, their idf over all docs, and the index of the labels outside the fold."""
    texts, total = sample(docs, training_rows(labels, label_col, folds, fold), per_class)
    n, share = sum(total.values()), (total.get(1, 0) / sum(total.values()) if total else 0.0)
    if len(total) < 2:
        return Model(Finder([]), None, share, share, k, pull)
    rows = texts.select("doc_id", "label", "text")
    stay = _different(rows)
    keys = set(stay)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for key, y, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (key, _crc(text)) not in keys:
                    continue
                got[y].update(terms_of(text))
                got[y][""] += 1
        for y, c in got.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([y] * len(c), pa.int32()),
                pa.array(list(c.values()), pa.int64())], names=["term", "label", "n"])

    counted = rows.select("doc_id", "label", "text").mapInArrow(count, "term string, label int, n long").groupBy("term").agg(
        F.sum(F.expr("if(label = 1, n, 0)")).alias("a"), F.sum(F.expr("if(label = 0, n, 0)")).alias("b"))
    counted = materialise(counted, "toxicity-terms")
    taken = next(((r["a"], r["b"]) for r in counted.where("term = ''").collect()), (0, 0))
    if not all(taken):
        return Model(Finder([]), None, share, share, k, pull)
    votes = {1: total[1] / taken[0], 0: total[0] / taken[1]}
    tied = (F.col("a") * votes[1] >= F.col("b") * votes[0]) & (F.col("a") / taken[0] > F.col("b") / taken[1]) & (_g2(F.col("a"),
        F.col("b"), *taken) >= strength)
    terms = sorted(r["term"] for r in counted.where("term <> ''").where(tied).select("term").collect())
    finder = Finder(terms)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        df = np.zeros(len(terms) + 1, np.int64)
        for b in batches:
            for t in b.column(0):
                df[-1] += 1
                for i in finder(t.as_py()):
                    df[i] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df), pa.int32()), pa.array(df[df > 0])], names=["term", "n"])

    df = {r["term"]: r["n"] for r in docs.select(F.col("text").cast("string")).mapInArrow(frequency, "term int, n long").groupBy(
        "term").agg(F.sum("n").alias("n")).collect()} if terms else {}
    idf = np.array([math.log((1 + df.get(len(terms), 0)) / (1 + df.get(i, 0))) + 1 for i in range(len(terms))])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array([(key, _crc(t)) in keys for key, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(),
                strict=True)], pa.bool_()))
            found = [finder(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(_crc, b.column(2).to_pylist()), pa.int64()),
                pa.array([sorted(f.items()) for f in found], pa.map_(pa.int32(), pa.int32()))], names=["doc_id", "label", "crc", "counts"])

    examples = rows.select("doc_id", "label", "text").mapInArrow(vectors, "doc_id long, label int, crc long, counts map<int,int>").collect()
    examples.sort(key=lambda r: (r["doc_id"], r["crc"]))
    bare = [sum(votes[y] for r in examples if not r["counts"] and r["label"] == y) for y in (0, 1)]
    kept = [r for r in examples if r["counts"]]
    rest = [r for r in examples if not r["counts"]]
    copies = Copies([stay[r["doc_id"], r["crc"]] for r in rest])
    about = [r["doc_id"] for r in rest], np.array([r["label"] for r in rest], np.int32), np.array([votes[r["label"]]
        for r in rest], np.float64)
    index = None if not kept else BlockMax([r["counts"] for r in kept], [r["label"] for r in kept], [r["doc_id"] for r in kept], idf, votes)
    base = share
    return Model(finder, index, base, (bare[1] + share) / (sum(bare) + 1), k, pull, copies, about)


_EVIDENCE = "array<struct<doc_id:bigint,similarity:double,label:int>>"


def score(docs: DataFrame, model: Model, folds: int = 5, fold: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        m = sent.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))
        for b in batches:
            got = [m(t.as_py()) for t in b.column(2)]
            p = np.array([g[0] for g in got], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)),
                pa.array([g[1] for g in got], kind)], names=["doc_id", "held_out", "score", "predicted", "evidence"])

    key = F.col(id_col).cast("long")
    return docs.select(key.alias("doc_id"), held_out(key, folds, fold).alias("held_out"), F.col(text_col).cast(
        "string")).mapInArrow(run, f"doc_id long, held_out boolean, score double, predicted int, evidence {_EVIDENCE}")


def keep_documents(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows whose score is below the limit, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        m = sent.value
        for b in batches:
            yield b.filter(pa.array([m(t.as_py())[0] < limit for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))
