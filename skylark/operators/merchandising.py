"""Query rules: conditions, rewrites, edits, and what they pin, hide, filter and pass on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE = (
    "id string, pattern string, anchoring string, context string, enabled boolean, valid_from long, valid_until long, "
    "query string, remove array<string>, filters string, user_data string"
)
#: A rule that also pins and hides objects.
RULE_WITH_PINS = f"{RULE}, promote array<struct<object_id:string,position:int>>, hide array<string>, filter_promotes boolean"


def applies(query: Column, context: Column, now: Column) -> Column:
    """Whether a rule's row fits a query: pattern and anchoring, context, switch and validity."""
    q, p = F.lower(F.trim(query)), F.lower("pattern")
    text = F.when(F.col("anchoring") == "is", q == p).when(F.col("anchoring") == "startsWith", F.startswith(q, p)).when(F.col(
        "anchoring") == "endsWith", F.endswith(q, p)).otherwise(F.contains(q, p))
    return (
        F.coalesce(text, F.lit(True)) & F.coalesce(F.col("context") == context, F.col("context").isNull()) & F.coalesce("enabled",
            F.lit(True))
        & (F.coalesce("valid_from", F.lit(0)) <= now) & (now <= F.coalesce("valid_until", F.lit(2**62)))
    )


def apply_rules(queries: DataFrame, rules: DataFrame, now: int = 0) -> DataFrame:
    """query_id, text and what the rules make of it: rewritten, filters, user_data, applied_rules (ids in order).

    Rules with the columns promote, hide and filter_promotes also give these, gathered in the order of ids. Rules
    are a list that a merchandiser writes; they travel to each query as one array, not as a join of all pairs."""
    packed = rules.agg(F.sort_array(F.collect_list(F.struct(*rules.columns))).alias("rules"))
    asked = queries if "context" in queries.columns else queries.withColumn("context", F.lit(None).cast("string"))
    rows = asked.withColumnRenamed("context", "asked").join(F.broadcast(packed)).select("query_id", "text", "asked",
        F.explode_outer("rules").alias("r"))
    hit = rows.select("query_id", "text", "asked", "r.*").withColumn("hit", F.col("id").isNotNull() & applies(F.col("text"),
        F.col("asked"), F.lit(now)))
    pins = [c for c in ("promote", "hide", "filter_promotes") if c in rules.columns]
    on = F.when(F.col("hit"), F.struct("id", "query", "remove", "filters", "user_data", *pins))
    got = hit.groupBy("query_id", "text").agg(F.array_sort(F.collect_list(on)).alias("a"))
    first = F.get(F.filter("a", lambda r: r["query"].isNotNull()), 0)["query"]
    removed = F.array_distinct(F.flatten(F.transform(F.filter("a", lambda r: r["remove"].isNotNull()), lambda r: r["remove"])))
    edited = F.array_join(F.filter(F.split(F.coalesce(first, F.col("text")), " "), lambda w: ~F.array_contains(removed, F.lower(w))), " ")
    return got.select(
        "query_id", "text", edited.alias("rewritten"), F.array_join(
            F.transform(F.filter("a", lambda r: r["filters"].isNotNull()), lambda r: F.concat(F.lit("("), r["filters"],
            F.lit(")"))), " AND ").alias("filters"),
        F.array_join(F.transform(F.filter("a", lambda r: r["user_data"].isNotNull()), lambda r: r["user_data"]), "|").alias(
            "user_data"), F.array_join(F.transform("a", lambda r: r["id"]), ",").alias("applied_rules"),
        *[_together("a", c).alias(c) for c in pins],
    )


def _together(rules: str, column: str) -> Column:
    """The lists of a column of all rules as one, in order; for a switch whether any rule has it on."""
    if column == "filter_promotes":
        return F.exists(rules, lambda r: F.coalesce(r[column], F.lit(False)))
    return F.flatten(F.transform(F.filter(rules, lambda r: r[column].isNotNull()), lambda r: r[column]))


def replace_words(text: Column, edits: list[tuple[str, str | None]]) -> Column:
    """Words deleted (None) or replaced, one edit after the other."""
    out = text
    for word, to in edits:
        out = F.regexp_replace(out, rf"(?i)(?<!\S)\Q{word}\E(?!\S)", to or "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def search_rules(rules: DataFrame, text: str) -> DataFrame:
    return rules.where(F.contains(F.lower(F.concat_ws(" ", "id", "pattern", "query")), F.lit(text.lower())))


def search_synonyms(synonyms: DataFrame, text: str, kind: str | None = None) -> DataFrame:
    """Synonym rows with a word that has the text in it, of one type if given."""
    hit = synonyms.where(F.exists("words", lambda w: F.contains(F.lower(w), F.lit(text.lower()))) | F.contains(F.lower("input"),
        F.lit(text.lower())))
    return hit.where(F.col("type") == kind) if kind else hit


def automatic_filters(queries: DataFrame, counted: DataFrame, allowed: list[str]) -> DataFrame:
    """query_id, facet, value where a query has a facet's value as a word; counted is of facets.counts."""
    words = queries.select("query_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w"))
    values = counted.where(F.col("facet").isin(allowed)).select("facet", "value", F.lower("value").alias("w"))
    return words.join(values, "w").select("query_id", "facet", "value")
