"""What a query's words may match: typos, splits, joined words, plurals and synonyms, as ways to cover its words.

A query is words at places. A way covers one or more places by atoms, all of which a document must have; an atom
is a token, the beginning of one, or a token within the word's typos. A document matches where every required
place is covered. Atoms are found in one read of the postings and folded by document in one aggregation.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylark.functions.text import STOP_WORDS
from skylark.sources.postings import Postings

_WORD = re.compile(r"[^\W_]+")
#: Distance between neighbouring query words that counts as far.
FAR = 8


@dataclass
class Options:
    """How words are expanded; the names are those of settings and requests."""

    query_type: str = "prefixLast"
    typo_tolerance: str = "true"
    one_typo: int = 5
    two_typos: int = 9
    typos_on_numbers: bool = True
    no_typos_on_words: Collection[str] = ()
    no_typos_on_attributes: Collection[str] = ()
    no_prefix_on_attributes: Collection[str] = ()
    stop_words: Sequence[str] = ()
    plurals: bool = False
    optional_words: Collection[str] = ()
    advanced_syntax: bool = False

    def typos(self, word: str) -> int:
        if self.typo_tolerance == "false" or word in self.no_typos_on_words or (word.isdigit() and not self.typos_on_numbers):
            return 0
        return 0 if len(word) < self.one_typo else 1 if len(word) < self.two_typos else 2


@dataclass(frozen=True)
class Atom:
    word: str
    prefix: bool = False
    near: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class Way:
    covers: tuple[int, ...]
    atoms: tuple[int, ...]
    cost: int = 0


@dataclass
class Parsed:
    """A query's words in order, and what else its syntax asks for."""

    words: list[str]
    prefix: list[bool]
    optional: set[int]
    phrases: list[list[str]] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)


def parse(text: str, o: Options) -> Parsed:
    """Words of a query; stop words go unless nothing else is left or the word is still being typed."""
    phrases, excluded = [], []
    if o.advanced_syntax:
        phrases = [w for p in re.findall(r'"([^"]*)"', text) if (w := _WORD.findall(p.lower()))]
        for x in re.findall(r"(?:^|\s)-(\w+)", re.sub(r'"[^"]*"', " ", text)):
            excluded += _WORD.findall(x.lower())
        text = re.sub(r"(^|\s)-\w+", r"\1", text)
    words = _WORD.findall(text.lower())
    ended = bool(re.search(r"[\s\"]$", text))
    last = len(words) - 1
    prefix = [o.query_type == "prefixAll" or (o.query_type == "prefixLast" and i == last and not ended) for i in range(len(words))]
    stop = {w for x in o.stop_words for w in STOP_WORDS.get(x, [])}
    keep = [i for i, w in enumerate(words) if w not in stop or prefix[i]] or list(range(len(words)))
    optional = {x.lower() for x in o.optional_words}
    return Parsed([words[i] for i in keep], [prefix[i] for i in keep], {n for n, i in enumerate(keep) if words[i] in optional},
        phrases, excluded)


def plural_forms(word: str) -> set[str]:
    """Singular and plural forms of an English word, by rule."""
    if re.search(r"(s|x|z|ch|sh)es$", word):
        one = word[:-2]
    elif re.search(r"[^aeiou]ies$", word):
        one = word[:-3] + "y"
    elif len(word) > 3 and re.search(r"[^s]s$", word):
        one = word[:-1]
    else:
        one = word
    many = one + "es" if re.search(r"(s|x|z|ch|sh)$", one) else one[:-1] + "ies" if re.search(r"[^aeiou]y$", one) else one + "s"
    return {word, one, many}


def synonym_edges(synonyms: DataFrame) -> DataFrame:
    """from, to and typo_cost of a synonym table (type, input, words), lower-cased."""
    both = synonyms.where("type = 'synonym'").select(F.explode("words").alias("from"), "words").select("from", F.explode(
        "words").alias("to"), F.lit(0).alias("typo_cost"))
    one = synonyms.where("type IN ('oneWaySynonym', 'altCorrection1', 'altCorrection2')").select(
        F.col("input").alias("from"), F.explode("words").alias("to"), F.when(F.col("type") == "altCorrection1", 1).when(
            F.col("type") == "altCorrection2", 2).otherwise(0).alias("typo_cost")
    )
    return both.unionByName(one).select(F.lower("from").alias("from"), F.lower("to").alias("to"), "typo_cost").where("`from` <> `to`")


def expand(p: Parsed, o: Options, post: Postings, synonyms: DataFrame | None, first_paths: int = 3) -> tuple[list[Atom], list[Way]]:
    """The atoms of a query and the ways they cover its words."""
    atoms: list[Atom] = []
    ways: list[Way] = []

    def add(covers: Sequence[int], parts: Sequence[Atom], cost: int = 0) -> None:
        places = []
        for a in parts:
            if a not in atoms:
                atoms.append(a)
            places.append(atoms.index(a))
        way = Way(tuple(covers), tuple(places), cost)
        if way not in ways:
            ways.append(way)

    words = p.words
    near = post.similar({w: o.typos(w) for w in words})
    halves = {w: [(w[:k], w[k:]) for k in range(2, min(12, len(w) - 2) + 1)] for w in words if len(w) >= 4}
    known = post.known(sorted({x for pairs in halves.values() for pair in pairs for x in pair}))
    for i, w in enumerate(words):
        add([i], [Atom(w, p.prefix[i], tuple(sorted(near.get(w, {}).items())))])
        for a, b in halves.get(w, []):  # the first split of which both halves are words
            if known.get(a, first_paths) < first_paths and known.get(b, first_paths) < first_paths:
                add([i], [Atom(a), Atom(b)])
                break
        for form in sorted(plural_forms(w) - {w}) if o.plurals else []:
            add([i], [Atom(form)])
    for i in range(min(len(words), 5) - 1):
        add([i, i + 1], [Atom(words[i] + words[i + 1])])
    if len(words) >= 3:
        add(range(len(words)), [Atom("".join(words))])
    if synonyms is not None and words:
        spans = {" ".join(words[i:j]): (i, j) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}
        for r in synonym_edges(synonyms).where(F.col("from").isin(sorted(spans))).distinct().collect():
            i, j = spans[r["from"]]
            if parts := _WORD.findall(r["to"]):
                add(range(i, j), [Atom(x) for x in parts], r["typo_cost"])
    return atoms, ways


def _hit(a: Atom, o: Options) -> Column:
    """Whether a posting is of an atom."""
    token, on = F.col("token"), lambda paths: ~F.col("path").isin(sorted(paths)) if paths else F.lit(True)
    out = token == a.word
    if a.prefix:
        out |= F.startswith(token, F.lit(a.word)) & on(o.no_prefix_on_attributes)
    if a.near:
        out |= token.isin([t for t, _ in a.near]) & on(o.no_typos_on_attributes)
    return out


def _typos(a: Atom) -> Column:
    out = F.when(F.startswith(F.col("token"), F.lit(a.word)), F.lit(0)) if a.prefix else F.when(F.col("token") == a.word, F.lit(0))
    for n in (1, 2):
        if same := [t for t, d in a.near if d == n]:
            out = out.when(F.col("token").isin(same), F.lit(n))
    return out.otherwise(F.lit(0))


def rows_of(atoms: Sequence[Atom], post: Postings, restrict: Sequence[str] | None = None) -> DataFrame:
    """The postings that any atom needs, read once."""
    whole = [t for a in atoms for t in (a.word, *(x for x, _ in a.near))]
    rows = post.read(whole, [a.word for a in atoms if a.prefix])
    return rows.where(F.col("path").isin(list(restrict))) if restrict else rows


def _least(columns: Sequence[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


def _most(columns: Sequence[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def _distance(i: int) -> Column:
    """How near the words at places i and i + 1 come in one attribute, FAR at most; `at` has what they hit."""
    pair = F.filter(F.array_sort("at"), lambda x: F.get(x["s"], i) | F.get(x["s"], i + 1))

    def gap(x: Column, k: Column) -> Column:
        before = F.get(pair, k - 1)
        return F.when((k > 0) & (F.get(x["s"], i) != F.get(before["s"], i)), x["p"] - before["p"]).otherwise(FAR)

    return F.least(F.lit(FAR), F.coalesce(F.array_min(F.transform(pair, gap)), F.lit(FAR)))


def fold(rows: DataFrame, n: int, atoms: Sequence[Atom], ways: Sequence[Way], o: Options, weights: Mapping[str, float]) -> DataFrame:
    """_id, covered (by place), typos, words, attribute, proximity, exact and score of every object with an atom."""
    weight = F.lit(0.0)
    for path, w in weights.items():
        weight = F.when(F.col("path") == path, F.lit(w)).otherwise(weight)
    hit = [_hit(a, o) for a in atoms]
    single = [[w.atoms[0] for w in ways if w.covers == (i,) and len(w.atoms) == 1] for i in range(n)]
    sums = []
    for k, a in enumerate(atoms):
        sums += [
            F.min(F.when(hit[k], _typos(a))).alias(f"t{k}"), F.max(F.when(F.col("token") == a.word, 1).otherwise(0)).alias(f"e{k}"),
            F.min(F.when(hit[k], F.col("attr_rank"))).alias(f"r{k}"), F.max(F.when(hit[k], weight)).alias(f"w{k}"),
        ]
    if n > 1:
        sides = F.array(*[reduce(lambda a, b: a | b, [hit[k] for k in s]) for s in single])
        at = F.struct((F.col("attr_rank").cast("long") * 1_000_000_000 + F.col("pos")).alias("p"), sides.alias("s"))
        sums.append(F.collect_set(F.when(F.exists(sides, lambda x: x), at)).alias("at"))
    got = rows.groupBy(F.col("object_id").alias("_id")).agg(*sums)

    by_place = [[w for w in ways if i in w.covers] for i in range(n)]
    cost = [_least([sum((F.col(f"t{k}") for k in w.atoms), F.lit(w.cost)) for w in ws]) for ws in by_place]
    every = [sorted({k for w in ws for k in w.atoms}) for ws in by_place]
    near = sum((_distance(i) for i in range(n - 1)), F.lit(0))
    total = lambda cs: sum(cs, F.lit(0))
    return got.select(
        "_id", F.array(*[c.isNotNull() for c in cost]).alias("covered"), total(F.coalesce(c, F.lit(0)) for c in cost).cast(
            "int").alias("typos"),
        total(c.isNotNull().cast("int") for c in cost).cast("int").alias("words"), _least(
            [F.col(f"r{k}") for k in range(len(atoms))]).alias("attribute"),
        near.cast("int").alias("proximity"), total(_most([F.col(f"e{k}") for k in s]) for s in single).cast("int").alias("exact"),
        total(F.coalesce(_most([F.col(f"w{k}") for k in ks]), F.lit(0.0)) for ks in every).alias("score"),
    )


def rounds(p: Parsed, how: str, most: int = 5) -> list[list[int]]:
    """Required places of the whole query and of each relaxation tried where it finds nothing."""
    needed = [i for i in range(len(p.words)) if i not in p.optional]
    out, n = [needed], len(p.words)
    if how in ("lastWords", "firstWords"):
        for k in range(1, min(most, n - 1) + 1):
            out.append([i for i in needed if (i < n - k if how == "lastWords" else i >= k)])
    return [*out, []] if how == "allOptional" else out


def fits(required: Sequence[int]) -> Column:
    """Whether the required places are covered, and any at all."""
    return reduce(lambda a, b: a & b, [F.get("covered", i) for i in required], F.col("words") > 0)
