"""Facets: paths, counts, hierarchies, values, statistics, disjunctive counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def path_of(field: str, value: Column) -> Column:
    """/field/value, levels of a value divided by slashes."""
    return F.concat(F.lit(f"/{field}/"), F.replace(value, F.lit(" > "), F.lit("/")))


def paths(docs: DataFrame, field: str, id_col: str = "object_id") -> DataFrame:
    """object_id and path of a string, an array of strings, or a struct (one path a string member)."""
    kind = dict(docs.dtypes)[field]
    if kind.startswith("struct"):
        members = [f.name for f in docs.schema[field].dataType.fields if f.dataType.simpleString() == "string"]
        all_ = F.array(*[F.when(F.col(f"{field}.{m}").isNotNull(), F.concat(F.lit(f"/{field}.{m}/"), F.col(f"{field}.{m}")))
            for m in members])
    elif kind == "array<string>":
        all_ = F.transform(field, lambda v: path_of(field, v))
    elif kind == "string":
        all_ = F.array(path_of(field, F.col(field)))
    else:
        raise TypeError(f"{field} of type {kind} is no facet")
    return docs.select(id_col, F.explode(F.filter(all_, lambda x: x.isNotNull())).alias("path"))


def display(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, "^/+", ""), F.lit("/"), F.lit(" > "))


def deepest(levels: Column) -> Column:
    """The value of the largest lvlN of a map."""
    entries = F.filter(F.map_entries(levels), lambda e: e["key"].rlike("^lvl[0-9]+$"))
    ranked = F.transform(entries, lambda e: F.struct(F.regexp_extract(e["key"], "([0-9]+)$", 1).cast("int").alias("n"),
        e["value"].alias("v")))
    return F.array_max(ranked)["v"]


def counts(hits: DataFrame, facets: Sequence[str]) -> DataFrame:
    """facet, value, count of several attributes in one pass: rows are unpivoted, partial sums are shuffled."""
    one = [F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets]
    return hits.select(F.explode(F.array(*one)).alias("f")).select("f.*").where("value IS NOT NULL").groupBy("facet",
        "value").agg(F.count(F.lit(1)).alias("count"))


def top_values(counted: DataFrame, n: int, by: str = "count") -> DataFrame:
    """The first n values of each facet by count or by name, with their rank."""
    keys = [F.desc("count"), F.col("value")] if by == "count" else [F.col("value")]
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("facet").orderBy(*keys))).where(F.col("rank") <= n)


def below(pathed: DataFrame, prefix: str) -> DataFrame:
    """Counts of the levels right below a path."""
    parts = F.split(F.substring(F.col("path"), len(prefix.rstrip("/")) + 2, 1 << 20), "/")
    return pathed.where(F.startswith("path", F.lit(prefix.rstrip("/") + "/"))).groupBy(F.element_at(parts, 1).alias("value")).agg(
        F.count_distinct("object_id").alias("count"))


def search_values(counted: DataFrame, facet: str, text: str, n: int = 10) -> DataFrame:
    """Values of a facet with a word that begins with the text, highlighted."""
    hit = counted.where((F.col("facet") == facet) & F.lower("value").rlike(rf"(^|[^\p{{L}}\p{{N}}])\Q{text.lower()}\E"))
    marked = F.regexp_replace("value", F.lit(rf"(?i)(?<![\p{{L}}\p{{N}}])(\Q{text}\E)"), F.lit("<em>$1</em>"))
    return hit.select("value", marked.alias("highlighted"), "count").orderBy(F.desc("count"), "value").limit(n)


def stats(hits: DataFrame, numeric: Sequence[str]) -> DataFrame:
    one = [F.struct(F.lit(f).alias("facet"), F.col(f).cast("double").alias("x")) for f in numeric]
    agg = [F.min("x").alias("min"), F.max("x").alias("max"), F.round(F.avg("x"), 4).alias("avg"), F.round(F.sum("x"), 2).alias("sum")]
    return hits.select(F.explode(F.array(*one)).alias("f")).select("f.*").where("x IS NOT NULL").groupBy("facet").agg(*agg)


def disjunctive(docs: DataFrame, refined: Mapping[str, Sequence[str]], base: Column | None = None) -> DataFrame:
    """facet, value, count where each facet ignores its own refinement; refined values without rows count 0.

    One scan: a row counts for a facet if it fits all other refinements."""
    base = F.lit(True) if base is None else base
    fits = {f: F.coalesce(F.col(f).isin(list(v)), F.lit(False)) if v else F.lit(True) for f, v in refined.items()}
    one = [F.when(reduce(lambda a, b: a & b, [c for g, c in fits.items() if g != f], base), F.struct(F.lit(f).alias("facet"),
        F.col(f).cast("string").alias("value"))) for f in refined]
    counted = docs.select(F.explode(F.filter(F.array(*one), lambda x: x.isNotNull())).alias("f")).select("f.*").where(
        "value IS NOT NULL").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))
    asked = docs.sparkSession.createDataFrame([(f, x) for f, v in refined.items() for x in v], "facet string, value string")
    return counted.join(asked, ["facet", "value"], "full").select("facet", "value", F.coalesce("count", F.lit(0)).alias("count"))


def order_values(counted: DataFrame, first: Sequence[str], rest: str = "count", hidden: Sequence[str] = ()) -> DataFrame:
    """Values in an explicit order, then the remaining ones by count, by name, or not at all."""
    place = F.array_position(F.array(*map(F.lit, first)), F.col("value")) if first else F.lit(0)
    shown = counted.where(~F.col("value").isin(list(hidden))) if hidden else counted
    if rest == "hidden":
        shown = shown.where(place > 0)
    keys = [F.when(place == 0, 1 << 30).otherwise(place), *([F.desc("count")] if rest == "count" else []), F.col("value")]
    return shown.withColumn("rank", F.row_number().over(Window.partitionBy("facet").orderBy(*keys)))


def zero_filled(every: DataFrame, counted: DataFrame) -> DataFrame:
    """All facet values with their count among the hits, 0 where there is none."""
    return every.select("facet", "value").join(counted, ["facet", "value"], "left").select("facet", "value", F.coalesce("count",
        F.lit(0)).alias("count"))
