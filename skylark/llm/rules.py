"""Quality rules: counts within a text, and how often its lines occur in other documents of its host.

Lines are normalised (lower case, blanks as one space) and hashed. A line is removed on a host where more
than `line_limit` different documents have it; a document of which less than `left_percent` % of the words
of its different lines is left is rejected. Documents with equal texts are one document.

Copies are no evidence that a line is boilerplate: of the documents with a line of one that would be rejected
if each counted, those without content of their own count as one. Content of its own is `own_words` words or more in lines
that are not frequent and neither begin nor end like a frequent line (in their first or last three words), as
an edited copy of a frequent line does. So pages made of one template, however long, are rejected, while a
group of near copies of one article stays for near-duplicate removal to settle.

All of it is DataFrame and SQL functions: windows and lines within a text are handled in its own row, only
line hashes are shuffled, once a text and summed before the shuffle, and a verdict table within Spark's
broadcast threshold is broadcast, a larger one joined by key.

Defined results: a null text has no words and fails the base rules; a null source is a host of its own;
null ids and repeated rows are judged as others; an empty table gives an empty result; other columns are
kept by keep_documents() and ignored by judge().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HAS_WORD, WORD, materialise

WINDOW = 8
#: Words at either end of a line by which an edited copy of it is known.
ENDS = 3


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, also where the optimiser moves or repeats the expression."""
    return F.transform(F.array(value), body)[0]


def _repeated(h: Column) -> Column:
    """Words covered by windows that occur twice or more; h holds the hashes of the windows in order."""
    at = lambda s, i: F.get(s, i)["x"]

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda here, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - here, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, n: a + n)

    def places(s: Column) -> Column:
        again = F.filter(s, lambda e, i: e["x"].eqNullSafe(at(s, i - 1)) | e["x"].eqNullSafe(at(s, i + 1)))
        return _let(F.sort_array(F.transform(again, lambda e: e["i"])), covered)

    ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0)).otherwise(_let(ranked, places))


def base_counts(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(text, F.lit(""))

    def counted(w: Column) -> Column:
        none = F.array().cast("array<bigint>")
        places = F.sequence(F.lit(0), F.size(w) - WINDOW)
        windows = lambda h: F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        repeated = F.when(F.size(w) < WINDOW, none).otherwise(_let(F.transform(w, lambda x: F.xxhash64(x)), windows))
        return F.struct(
            F.size(w).cast("long").alias("n"), F.array_join(w, "").alias("j"), _let(repeated, _repeated).cast("long").alias("r")
        )

    def named(c: Column) -> Column:
        return F.struct(
            c["n"].alias("n_words"), F.char_length(c["j"]).cast("long").alias("word_chars"),
            (F.char_length(c["j"]) - F.char_length(F.regexp_replace(c["j"], r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            _let(F.filter(F.split(t, "\n"), lambda x: x.rlike(HAS_WORD)), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast(
                "long").alias("n_dup_lines"),
            c["r"].alias("n_repeat_words"), ((c["n"] < 20) | (c["r"] * 100 > c["n"] * 30)).alias("base_failed"),
        )

    return _let(_let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), counted), named)


def _host(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _lines(text: Column) -> Column:
    """The different normalised lines of a text: hash, words, and hashes of the first and last words."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")
    rows = F.array_distinct(F.filter(F.transform(F.split(flat, "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    return F.transform(
        rows,
        lambda x: F.struct(
            F.xxhash64(x).alias("line"),
            (F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words"),
            F.xxhash64(F.substring_index(x, " ", ENDS)).alias("head"),
            F.xxhash64(F.substring_index(x, " ", -ENDS)).alias("tail"),
        ),
    )


def _poor(rows: DataFrame, left_percent: int) -> DataFrame:
    """host and text_key where too few words are left; rows are the frequent lines of the texts."""
    lost = rows.groupBy("host", "text_key").agg(F.sum("words").alias("removed"), F.max("total").alias("total"))
    return lost.where((F.col("total") - F.col("removed")) * 100 < F.col("total") * left_percent).select("host", "text_key")


def _copies(texts: DataFrame, many: DataFrame, asked: DataFrame, own_words: int) -> DataFrame:
    """host and text_key of those of the asked texts that have no content of their own."""
    rest = (
        texts.join(asked, ["host", "text_key"], "left_semi").select("host", "text_key", F.explode("lines").alias("l"))
        .select("host", "text_key", "l.*").join(many.select("host", "line"), ["host", "line"], "left_anti")
        .join(many.select("host", "head").distinct(), ["host", "head"], "left_anti")
        .join(many.select("host", "tail").distinct(), ["host", "tail"], "left_anti")
    )
    own = rest.groupBy("host", "text_key").agg(F.sum("words").alias("own")).where(F.col("own") >= own_words)
    return asked.join(own, ["host", "text_key"], "left_anti")


def depleted(
    docs: DataFrame, line_limit: int = 10, left_percent: int = 30, own_words: int = 5, source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """host and text_key of the texts that lose too many words with their host's frequent lines."""
    text = F.col(text_col).cast("string")
    every = docs.select(_host(F.col(source_col)).alias("host"), _key(text).alias("text_key"), _lines(text).alias("lines"))
    every = every.groupBy("host", "text_key").agg(F.first("lines").alias("lines"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x.words)
    texts = materialise(every.withColumn("total", total), "rules-texts")
    lines = texts.select("host", "text_key", "total", F.explode("lines").alias("l")).select("host", "text_key", "total", "l.*")
    counted = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"), F.min("head").alias("head"), F.min("tail").alias("tail"))
    many = materialise(counted.where(F.col("n") > line_limit).drop("n"), "rules-many")
    rows = lines.drop("head", "tail").join(many.select("host", "line"), ["host", "line"])
    poor = materialise(_poor(rows, left_percent), "rules-poor")
    if poor.isEmpty():
        return poor
    # a text is rejected only if it would be when every text counts, so only the lines of those are counted again
    at_stake = rows.join(poor, ["host", "text_key"], "left_semi").select("host", "line").distinct()
    rows = materialise(rows.join(at_stake, ["host", "line"], "left_semi"), "rules-at-stake")
    copies = _copies(texts, many, rows.select("host", "text_key").distinct(), own_words).withColumn("copy", F.lit(1))
    votes = rows.join(copies, ["host", "text_key"], "left").groupBy("host", "line")
    frequent = votes.agg(F.sum(F.when(F.col("copy").isNull(), 1).otherwise(0)).alias("n"), F.max(
        F.coalesce("copy", F.lit(0))).alias("copy"))
    frequent = frequent.where(F.col("n") + F.col("copy") > line_limit).select("host", "line")
    return materialise(_poor(rows.join(poor, ["host", "text_key"], "left_semi").join(frequent, ["host", "line"]), left_percent),
        "rules-gone")


def judge(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", line_limit: int = 10,
        left_percent: int = 30
) -> DataFrame:
    """The base counts and the verdict of every row."""
    text = F.col(text_col).cast("string")
    keys = F.col(id_col).cast("long").alias("doc_id"), _host(F.col(source_col)).alias("host"), _key(text).alias("text_key")
    counts = docs.select(*keys, base_counts(text).alias("c")).select("doc_id", "host", "text_key", "c.*")
    gone = depleted(docs, line_limit, left_percent, source_col=source_col, text_col=text_col).withColumn("gone", F.lit(True))
    kept = ~F.col("base_failed") & F.col("gone").isNull()
    return counts.join(gone, ["host", "text_key"], "left").withColumn("kept", kept).drop("host", "text_key", "gone")


def keep_documents(docs: DataFrame, line_limit: int = 10, left_percent: int = 30) -> DataFrame:
    """The rows that pass, with all their columns."""
    text = F.col("text").cast("string")
    gone = depleted(docs, line_limit, left_percent)
    passed = docs.where(~base_counts(text)["base_failed"])
    passed = passed.select(F.struct("*").alias("doc"), _host(F.col("source")).alias("host"), _key(text).alias("text_key"))
    return passed.join(gone, ["host", "text_key"], "left_anti").select("doc.*")


def op10_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols",
        "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), raw AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), win AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM d)
), hits AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM hits)
 GROUP BY r
), base AS (
  SELECT d.r, doc_id, host, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(array_to_string(w, '')) - length(regexp_replace(array_to_string(w, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)
), texts AS (SELECT DISTINCT host, text FROM d
), lines AS (
  SELECT DISTINCT host, text, line FROM (
    SELECT host, text, trim(lower(regexp_replace(unnest(string_split(text, chr(10))), '[\x20\x09-\x0D]+', ' ', 'g'))) AS line
 FROM texts) WHERE line <> ''
), marked AS (
  SELECT host, text, line, string_split(line, ' ') AS w FROM lines
), sized AS (
  SELECT host, text, line, len(w) AS words, array_to_string(w[:3], ' ') AS head, array_to_string(w[-3:], ' ') AS tail FROM marked
), many AS (SELECT host, line, any_value(head) AS head, any_value(tail) AS tail FROM sized GROUP BY host, line HAVING count(*) > 10
), totals AS (SELECT host, text, sum(words) AS total FROM sized GROUP BY host, text
), lost AS (
  SELECT host, text, sum(words) AS removed FROM sized SEMI JOIN many USING (host, line) GROUP BY host, text
), poor AS (
  SELECT host, text FROM lost JOIN totals USING (host, text) WHERE (total - removed) * 100 < total * 30
), stake AS (SELECT DISTINCT host, line FROM sized SEMI JOIN poor USING (host, text) SEMI JOIN many USING (host, line)
), asked AS (SELECT DISTINCT host, text FROM sized SEMI JOIN stake USING (host, line)
), own AS (
  SELECT host, text FROM sized SEMI JOIN asked USING (host, text) ANTI JOIN many USING (host, line)
  ANTI JOIN many AS heads USING (host, head) ANTI JOIN many AS tails USING (host, tail) GROUP BY host, text HAVING sum(words) >= 5
), copies AS (SELECT host, text FROM asked ANTI JOIN own USING (host, text)
), votes AS (
  SELECT s.host, s.line, count(*) FILTER (c.text IS NULL) AS n, max((c.text IS NOT NULL)::INT) AS copy
  FROM (SELECT * FROM sized SEMI JOIN stake USING (host, line)) AS s LEFT JOIN copies AS c USING (host, text) GROUP BY s.host, s.line
), frequent AS (SELECT host, line FROM votes WHERE n + copy > 10
), gone AS (
  SELECT host, text FROM (SELECT host, text, sum(words) AS removed FROM sized SEMI JOIN frequent USING (host, line) GROUP BY host, text)
  JOIN totals USING (host, text) WHERE (total - removed) * 100 < total * 30
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT
 AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND gone.text IS NULL AS kept
FROM base LEFT JOIN gone USING (host, text)
"""
