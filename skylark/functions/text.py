"""Text analysis: tokens, edge n-grams, attribute weights, query alternatives, plurals, stop words.

All of it is native expressions. Only tokenize_offsets(), which also gives places in the text, is an Arrow
UDF; tokens_of() is the plain form of both, which tests hold them against.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF), (0x2E80, 0x2EFF), (0x3000, 0x30FF), (0x31F0, 0x31FF), (0xAC00,
    0xD7AF), (0x1100, 0x11FF), (0x20000, 0x2A6DF), (0x2A700, 0x2CEAF))
TOKENS = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), *[T.StructField(n, T.IntegerType())
    for n in ("pos", "start", "end")]]))


def is_cjk(c: str) -> bool:
    n = ord(c)
    return n >= 0x1100 and any(lo <= n <= hi for lo, hi in _CJK)


def tokens_of(text: str) -> list[tuple[str, int, int, int]]:
    """(token, position, start, end in characters) of a text.

    An ideograph or kana is a token; so is a run of other letters and digits. Runs that only punctuation
    divides are also emitted joined, after them, where they are two or more and have 3 bytes or more; a
    blank, a NUL or an ideograph ends such a chain, and punctuation in front of its first run breaks it."""
    out: list[tuple[str, int, int, int]] = []
    chain: list[str] = []
    begin, broken, i = 0, False, 0

    def flush(end: int) -> None:
        nonlocal broken
        word = "".join(chain)
        if len(chain) > 1 and len(word.encode()) >= 3:
            out.append((word, len(out), begin, end))
        chain.clear()
        broken = False

    while i < len(text):
        c = text[i]
        if is_cjk(c):
            flush(i)
            out.append((c, len(out), i, i + 1))
            i += 1
        elif c.isalnum():
            j = i
            while j < len(text) and text[j].isalnum() and not is_cjk(text[j]):
                j += 1
            out.append((text[i:j], len(out), i, j))
            if chain and broken:
                chain.append(text[i:j])
            elif not chain and not broken:
                begin = i
                chain.append(text[i:j])
            broken, i = False, j
        elif c.isspace() or c == "\0":
            flush(i)
            i += 1
        else:
            broken, i = True, i + 1
    flush(len(text))
    return out


@F.pandas_udf(TOKENS)
def _tokenize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: [{"token": w.lower(), "pos": p, "start": s, "end": e} for w, p, s, e in tokens_of(t or "")])


def tokenize_offsets(text: Column) -> Column:
    """Lower-cased tokens with positions and offsets."""
    return _tokenize(text)


_IDEOGRAPH = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in _CJK)
_BLANK = r"[\s\x00\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F]+"
_PART = rf"[{_IDEOGRAPH}]|[\p{{IsAlphabetic}}\p{{N}}&&[^{_IDEOGRAPH}]]+"


def tokenize(text: Column) -> Column:
    """Lower-cased tokens (token, pos) as native expressions.

    Blanks around every ideograph make it a chunk of its own; the runs of any other chunk are joined unless
    punctuation begins it."""
    chunks = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"([{_IDEOGRAPH}])", " $1 "), _BLANK)

    def tokens(chunk: Column) -> Column:
        parts = F.regexp_extract_all(chunk, F.lit(_PART), F.lit(0))
        joined = F.array_join(parts, "")
        chained = (F.size(parts) > 1) & (F.octet_length(joined) >= 3) & chunk.rlike(rf"^[\p{{IsAlphabetic}}\p{{N}}]")
        return F.when(chained, F.array_append(parts, joined)).otherwise(parts)

    flat = F.flatten(F.transform(chunks, tokens))
    return F.transform(flat, lambda t, i: F.struct(F.lower(t).alias("token"), i.alias("pos")))


def ascii_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, without the joined ones."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def joined_tokens(text: Column) -> Column:
    """The joined tokens of ASCII text: chains of runs that punctuation divides, of 3 characters or more."""
    chain = F.regexp_extract_all(F.lower(text), F.lit(r"(?<![^\s])[a-z0-9]+(?:[^a-z0-9\s]+[a-z0-9]+)+"), F.lit(0))
    return F.filter(F.transform(chain, lambda x: F.regexp_replace(x, "[^a-z0-9]", "")), lambda x: F.length(x) >= 3)


def edge_ngrams(token: Column, least: int = 2, most: int = 20) -> Column:
    """Prefixes of least to most characters; shorter tokens have none."""
    n = F.least(F.lit(most), F.char_length(token))
    return F.when(n >= least, F.transform(F.sequence(F.lit(least), n), lambda k: F.substring(token, 1, k))).otherwise(F.array(
        ).cast("array<string>"))


def allowed_typos(token: Column, one: int = 5, two: int = 9) -> Column:
    """Typos that a query word may have, by its length."""
    n = F.char_length(token)
    return F.when(n < one, 0).when(n < two, 1).otherwise(2)


def attribute_weights(searchable: Sequence[str], override: Mapping[str, float] | None = None) -> dict[str, float]:
    """Weight of each searchable attribute: 100 to the power of minus its place, unless set."""
    override = override or {}
    return {a: float(override.get(a, 100.0**-i)) for i, a in enumerate(searchable)}


def split_points(token: Column) -> Column:
    """Lengths of the first half that a split of the token may have."""
    n = F.char_length(token)
    return F.when(n >= 4, F.sequence(F.lit(2), F.least(F.lit(12), n - 2))).otherwise(F.array().cast("array<int>"))


def joined_alternatives(tokens: Column) -> Column:
    """Neighbouring pairs of the first 5 tokens joined, and the whole query joined where it has 3 or more."""
    low = F.transform(tokens, lambda t: F.lower(t))
    pairs = F.when(F.size(low) > 1, F.transform(F.sequence(F.lit(1), F.least(F.size(low), F.lit(5)) - 1), lambda i: F.concat(
        F.element_at(low, i), F.element_at(low, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(low) >= 3, F.array_append(pairs, F.array_join(low, ""))).otherwise(pairs)


def split_alternatives(words: DataFrame, vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """(token, first, second): the first split of which both halves are words of the vocabulary.

    Two semi joins on the halves; each token keeps its smallest split by aggregation."""
    halves = words.select(F.lower(token).alias("token")).distinct().select("token", F.explode(split_points(F.col("token"))).alias("at"))
    halves = halves.select("token", "at", F.substring(F.col("token"), F.lit(1), F.col("at")).alias("first"), F.substring(
        F.col("token"), F.col("at") + 1, F.lit(1 << 20)).alias("second"))
    v = vocabulary.select(F.col("token").alias("w")).distinct()
    both = halves.join(v, F.col("first") == F.col("w"), "left_semi").join(v, F.col("second") == F.col("w"), "left_semi")
    return both.groupBy("token").agg(F.min_by(F.struct("first", "second"), "at").alias("s")).select("token", "s.first", "s.second")


STOP_WORDS = {"en": ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that",
    "the", "this", "to", "was", "with"], "fr": ["au", "de", "des", "du", "en", "est", "et", "la", "le", "les", "pour", "que",
    "qui", "sur", "un", "une"], "de": ["auf", "das", "der", "die", "ein", "eine", "ist", "mit", "nicht", "und", "von", "zu"],
    "es": ["con", "de", "del", "el", "en", "es", "la", "los", "para", "por", "que", "se", "su", "un", "una"]}


def without_stop_words(tokens: Column, languages: Sequence[str] = ("en",)) -> Column:
    words = sorted({w for x in languages for w in STOP_WORDS.get(x, [])})
    return F.filter(tokens, lambda t: ~t.isin(words)) if words else tokens


def singular(word: Column, irregular: Mapping[str, str] | None = None) -> Column:
    """A word without its English plural ending; irregular forms come first."""
    out = F.when(word.rlike("(s|x|z|ch|sh)es$"), F.regexp_replace(word, "es$", "")).when(word.rlike("[^aeiou]ies$"),
        F.regexp_replace(word, "ies$", "y")).when(word.rlike("[^s]s$") & (F.length(word) > 3), F.regexp_replace(word, "s$",
        "")).otherwise(word)
    for plural, single in (irregular or {}).items():
        out = F.when(word == plural, single).otherwise(out)
    return out


def highlight(text: Column, words: Column, before: str = "<em>", after: str = "</em>") -> Column:
    """The text with every word that begins with one of words marked."""
    pattern = F.concat(F.lit(r"(?i)\b("), F.array_join(
        F.transform(words, lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}])", r"\\$1")), "|"), F.lit(r")"))
    return F.regexp_replace(text, pattern, F.lit(f"{before}$1{after}"))


def match_level(matched: Column, wanted: Column) -> Column:
    return F.when(matched == 0, "none").when(matched < wanted, "partial").otherwise("full")


def snippet(text: Column, words: int, around: Column, ellipsis: str = "…") -> Column:
    """`words` words of the text from the first that begins with `around`."""
    all_ = F.split(text, " ")
    at = F.coalesce(F.array_position(F.transform(all_, lambda w: F.startswith(F.lower(w), F.lower(around))), True), F.lit(1)).cast("int")
    first = F.greatest(F.lit(1), F.when(at == 0, 1).otherwise(at))
    cut = F.array_join(F.slice(all_, first, words), " ")
    return F.concat(F.when(first > 1, ellipsis).otherwise(""), cut, F.when(F.size(all_) >= first + words, ellipsis).otherwise(""))


def dictionary_filter(rows: DataFrame, entries: DataFrame, language: str, column: str = "tokens") -> DataFrame:
    """rows without the enabled stop words of a dictionary table (language, word, state)."""
    words = entries.where((F.col("language") == language) & (F.col("state") == "enabled")).agg(F.collect_set(F.lower("word")).alias("stop"))
    return rows.join(F.broadcast(words)).withColumn(column, F.filter(column,
        lambda t: ~F.array_contains(F.col("stop"), F.lower(t)))).drop("stop")
