"""Search analytics over the search log and the insight events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def day(ts: Column) -> Column:
    """The UTC day of epoch milliseconds."""
    return F.to_date(F.timestamp_millis(ts))


def rate(part: Column, whole: Column) -> Column:
    """part / whole at 6 decimals, null without whole."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 6)


def scope(rows: DataFrame, index: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The rows of an index and of days from start to end."""
    if index:
        rows = rows.where(F.col("index_name") == index)
    if start:
        rows = rows.where(day(F.col("timestamp_ms")) >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(day(F.col("timestamp_ms")) <= F.lit(end).cast("date"))
    return rows


def daily(rows: DataFrame, **measures: Column) -> DataFrame:
    """Measures by day and over all days (day 'total'), by one rollup."""
    return rows.withColumn("d", day(F.col("timestamp_ms"))).rollup("d").agg(*[m.alias(n) for n, m in measures.items()]).select(
        F.coalesce(F.date_format("d", "yyyy-MM-dd"), F.lit("total")).alias("day"), *measures)


def searches_daily(s: DataFrame) -> DataFrame:
    return daily(s, count=F.count(F.lit(1)))


def users_daily(s: DataFrame) -> DataFrame:
    return daily(s, users=F.count_distinct("user_token"))


def no_result_rate(s: DataFrame) -> DataFrame:
    none = F.count_if(~F.col("has_results"))
    return daily(s, count=F.count(F.lit(1)), no_results=none, rate=rate(none, F.count(F.lit(1))))


def top_searches(s: DataFrame, n: int = 10) -> DataFrame:
    got = s.groupBy("query").agg(F.count(F.lit(1)).alias("count"), F.max("nb_hits").alias("nb_hits"))
    return _ranked(got, n, F.desc("count"), F.col("query"))


def _ranked(rows: DataFrame, n: int, *keys: Column) -> DataFrame:
    return rows.orderBy(*keys).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*keys)))


def searches_without_results(s: DataFrame, n: int = 10) -> DataFrame:
    got = s.where("NOT has_results").groupBy("query").agg(F.count(F.lit(1)).alias("count"), F.count_if(
        F.col("filters").isNotNull()).alias("with_filter_count"))
    return _ranked(got, n, F.desc("count"), F.col("query"))


def tracked(s: DataFrame) -> DataFrame:
    return s.where("query_id IS NOT NULL")


def marked(s: DataFrame, e: DataFrame, condition: Column, name: str) -> DataFrame:
    """Tracked searches with whether an event of the condition refers to them; events are reduced to their ids first."""
    ids = e.where(condition & F.col("query_id").isNotNull()).select("query_id").distinct().withColumn(name, F.lit(True))
    return tracked(s).join(ids, "query_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def event_rate(s: DataFrame, e: DataFrame, condition: Column) -> DataFrame:
    """Tracked searches with such an event, of all tracked ones, by day and in total."""
    hit = F.count_if("hit")
    return daily(marked(s, e, condition, "hit"), tracked=F.count(F.lit(1)), hits=hit, rate=rate(hit, F.count(F.lit(1))))


def is_click() -> Column:
    return F.col("event_type") == "click"


def is_conversion(subtype: str | None = None) -> Column:
    c = F.col("event_type") == "conversion"
    return c & (F.col("event_subtype") == subtype) if subtype else c


def no_click_rate(s: DataFrame, e: DataFrame) -> DataFrame:
    none = F.count_if(~F.col("hit"))
    return daily(marked(s, e, is_click(), "hit"), tracked=F.count(F.lit(1)), no_clicks=none, rate=rate(none, F.count(F.lit(1))))


def searches_without_clicks(s: DataFrame, e: DataFrame, n: int = 10) -> DataFrame:
    got = marked(s, e, is_click(), "hit").where("NOT hit").groupBy("query").agg(F.count(F.lit(1)).alias("count"))
    return _ranked(got, n, F.desc("count"), F.col("query"))


def click_positions(e: DataFrame) -> DataFrame:
    """timestamp_ms, query_id and position, one row a clicked object."""
    return e.where(is_click()).select("timestamp_ms", "query_id", F.explode(F.from_json("positions", "array<int>")).alias("position"))


def average_click_position(e: DataFrame) -> DataFrame:
    return daily(click_positions(e), clicks=F.count(F.lit(1)), average=F.round(F.avg("position"), 6))


def position_histogram(e: DataFrame, edges: tuple[int, ...] = (11, 16, 21)) -> DataFrame:
    """Positions 1 to edges[0]-1 one by one, then ranges up to the next edge; end -1 is without end."""
    p = F.col("position")
    start, end = p, p
    for a, b in zip(edges, [*[x - 1 for x in edges[1:]], -1], strict=True):
        start, end = F.when(p >= a, a).otherwise(start), F.when(p >= a, b).otherwise(end)
    return click_positions(e).groupBy(start.alias("start"), end.alias("end")).agg(F.count(F.lit(1)).alias("clicks"))


def revenue(e: DataFrame) -> DataFrame:
    """Revenue by currency, by day and in total."""
    rows = e.where(is_conversion() & F.col("value").isNotNull()).withColumn("d", day(F.col("timestamp_ms")))
    return rows.groupBy("d", "currency").agg(F.sum("value").alias("v")).rollup("currency", "d").agg(F.round(F.sum("v"), 2).alias(
        "revenue")).where("currency IS NOT NULL").select(F.coalesce(F.date_format("d", "yyyy-MM-dd"), F.lit("total")).alias(
        "day"), "currency", "revenue")


_FILTER = r"([A-Za-z_][\w.]*)\s*(<=|>=|!=|:|=|<|>)\s*('[^']*'|[^\s()]+)"


def filter_parts(s: DataFrame) -> DataFrame:
    """attribute, operator, value and has_results of every comparison in the filters of searches."""
    found = F.regexp_extract_all("filters", F.lit(_FILTER), F.lit(0))
    part = lambda i: F.regexp_replace(F.regexp_extract("f", _FILTER, i), "^'|'$", "")
    return s.where("filters IS NOT NULL").select("has_results", F.explode(found).alias("f")).select(part(1).alias("attribute"),
        part(2).alias("operator"), part(3).alias("value"), "has_results")


def top_filters(s: DataFrame, n: int = 10, attribute: str | None = None, no_results: bool = False) -> DataFrame:
    rows = filter_parts(s)
    if no_results:
        rows = rows.where("NOT has_results")
    if attribute:
        return _ranked(rows.where(F.col("attribute") == attribute).groupBy("attribute", "operator", "value").agg(F.count(
            F.lit(1)).alias("count")), n, F.desc("count"), F.col("operator"), F.col("value"))
    return _ranked(rows.groupBy("attribute").agg(F.count(F.lit(1)).alias("count")), n, F.desc("count"), F.col("attribute"))


def top_hits(e: DataFrame, n: int = 10) -> DataFrame:
    """Objects by events, with clicks, conversions and revenue."""
    rows = e.select("event_type", "value", F.explode(F.from_json("object_ids", "array<string>")).alias("object_id"))
    got = rows.groupBy("object_id").agg(F.count(F.lit(1)).alias("count"), F.count_if(is_click()).alias("clicks"), F.count_if(
        is_conversion()).alias("conversions"), F.round(F.sum(F.when(is_conversion(), F.col("value"))), 2).alias("revenue"))
    return _ranked(got, n, F.desc("count"), F.col("object_id"))


def top_countries(s: DataFrame) -> DataFrame:
    got = s.where("country IS NOT NULL").groupBy("country").agg(F.count(F.lit(1)).alias("count"))
    return got.withColumn("percent", F.round(F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy(F.lit(1))),
        4)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "country")))


def country_searches(s: DataFrame, n: int = 3) -> DataFrame:
    """The first n queries of every country."""
    got = s.where("country IS NOT NULL").groupBy("country", "query").agg(F.count(F.lit(1)).alias("count"))
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("count"), "query"))).where(
        F.col("rank") <= n)


def top_regions(s: DataFrame, country: str, n: int = 10) -> DataFrame:
    """The first n regions of a country by searches, with their share of the country's in percent."""
    got = s.where((F.col("country") == country) & F.col("region").isNotNull()).groupBy("region").agg(F.count(F.lit(1)).alias("count"))
    share = F.round(F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy(F.lit(1))), 4)
    return _ranked(got.withColumn("percent", share), n, F.desc("count"), F.col("region"))


def device(tags: Column) -> Column:
    """The platform among a search's tags."""
    tags = F.split(tags, ",")
    return F.when(F.array_contains(tags, "mobile"), "mobile").when(F.array_contains(tags, "tablet"), "tablet").when(
        F.array_contains(tags, "desktop"), "desktop").otherwise("other")


def devices(s: DataFrame) -> DataFrame:
    """Searches by platform tag, with their share in percent."""
    got = s.groupBy(device(F.col("analytics_tags")).alias("device")).agg(F.count(F.lit(1)).alias("count"))
    return got.withColumn("percent", F.round(F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy(F.lit(1))), 4))


def devices_daily(s: DataFrame) -> DataFrame:
    """Searches by day and platform."""
    day = F.to_date(F.timestamp_millis("timestamp_ms"))
    return s.groupBy(F.date_format(day, "yyyy-MM-dd").alias("day"), device(F.col("analytics_tags")).alias("device")).agg(F.count(
        F.lit(1)).alias("count"))


def delta(s: DataFrame, split_ms: int) -> DataFrame:
    """Searches and no-result rate before and from a moment, and their change in percent."""
    late = F.col("timestamp_ms") >= split_ms
    now, before = F.count_if(late), F.count_if(~late)
    return s.agg(before.alias("before"), now.alias("now"), F.round(F.try_divide((now - before) * 100.0, before), 4).alias("change"))


def top_searches_with_analytics(s: DataFrame, e: DataFrame, n: int = 10, by: str = "search_count", descending: bool = True) -> DataFrame:
    """Queries with clicks, rates, positions, conversions and revenue: pre-aggregates joined by search."""
    clicks = click_positions(e).groupBy("query_id").agg(F.count(F.lit(1)).alias("clicks"), F.sum("position").alias("positions"))
    sales = e.where(is_conversion() & F.col("query_id").isNotNull()).groupBy("query_id").agg(F.count(F.lit(1)).alias(
        "conversions"), F.sum("value").alias("revenue"))
    rows = s.join(clicks, "query_id", "left").join(sales, "query_id", "left")
    traced, clicked, bought = F.count("query_id"), F.count_if(F.col("clicks") > 0), F.count_if(F.col("conversions") > 0)
    got = rows.groupBy("query").agg(
        F.count(F.lit(1)).alias("search_count"), traced.alias("tracked_count"), F.coalesce(F.sum("clicks"), F.lit(0)).alias(
            "click_count"), rate(clicked, traced).alias("click_through_rate"),
        F.round(F.try_divide(F.sum("positions"), F.sum("clicks")), 6).alias("average_click_position"), rate(bought, traced).alias(
            "conversion_rate"), F.round(F.coalesce(F.sum("revenue"), F.lit(0.0)), 2).alias("revenue"),
    )
    key = F.col(by)
    return _ranked(got, n, key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col("query"))


def status(s: DataFrame, retention_days: int = 90) -> DataFrame:
    return s.agg((F.count(F.lit(1)) > 0).alias("has_data"), F.max("timestamp_ms").alias("updated_at")).select(F.lit(True).alias(
        "enabled"), "has_data", F.lit(retention_days).alias("retention_days"), "updated_at")


def attribution(s: DataFrame, e: DataFrame) -> DataFrame:
    """Events with the query and index that their query_id names."""
    found = tracked(s).groupBy("query_id").agg(F.min(F.struct("query", "index_name")).alias("of"))
    return e.where("query_id IS NOT NULL").join(found, "query_id").select("event_id", "query_id", F.col("of.query").alias(
        "query"), F.col("of.index_name").alias("search_index"))


def dedup_searches(rows: DataFrame, window_s: int = 30, seconds: str = "t", order: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """counted: whether a search opens a new one for its user and index, that is, comes first or at least
    window_s whole seconds after the one before. Text and filters do not matter; every event moves the clock."""
    before = F.lag(seconds).over(Window.partitionBy("user_token", "index_name").orderBy(seconds, *order))
    return rows.withColumn("counted", before.isNull() | (F.floor(F.col(seconds) - before) >= window_s))


def effective_ids() -> Column:
    """object_ids, or objectIDs where it is empty."""
    return F.when(F.size("object_ids") > 0, F.col("object_ids")).otherwise(F.col("objectIDs"))


def validation_error(now_ms: int, days: int = 4) -> Column:
    """The first rule that an event breaks, or null: type, name, user, objects, positions, query id, age."""
    n, qid = F.coalesce(F.size(F.coalesce("ids", F.array().cast("array<string>"))), F.lit(0)), F.col("query_id")
    searched = (F.col("event_type") == "click") & qid.isNotNull()
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    return (
        F.when(~F.coalesce(F.col("event_type").isin("click", "conversion", "view"), F.lit(False)), F.concat(
            F.lit("invalid event type: "), F.coalesce("event_type", F.lit(""))))
        .when(~size("event_name").between(1, 64), "event name must have 1 to 64 bytes")
        .when(~size("user_token").between(1, 129), "user token must have 1 to 129 bytes")
        .when(~n.between(1, 20), "an event must have 1 to 20 objects")
        .when(searched & F.col("positions").isNull(), "a click after a search must have positions")
        .when(searched & (F.size("positions") != n), "positions must be as many as objects")
        .when(qid.isNotNull() & ~qid.rlike("^[0-9a-fA-F]{32}$"), "query id must be 32 hexadecimal digits")
        .when(F.col("timestamp") < now_ms - days * DAY_MS, f"timestamp must lie within the last {days} days")
    )


def ingest(batch: DataFrame, now_ms: int, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(accepted events, one row on the batch): invalid ones are dropped, and the batch fails if all are or it is too large."""
    checked = batch.withColumn("ids", effective_ids()).withColumn("error", validation_error(now_ms))
    n = F.count(F.lit(1))
    verdict = checked.agg(n.alias("received"), F.count_if(F.col("error").isNull()).alias("accepted"), ((n <= most)
        & ((n == 0) | (F.count_if(F.col("error").isNull()) > 0))).alias("ok"))
    return checked.where("error IS NULL").drop("error"), verdict


def new_query_id(*parts: Column) -> Column:
    """A query id of 32 hexadecimal digits that the same request always gets."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
