"""Derived tables that the registered queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search log: one search an event, for the part whose key is the event's number modulo their number."""
    e = table(spark, sf_dir, "events")
    parts = table(spark, sf_dir, "part")
    p = parts.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("query"))
    i, n = F.col("event_id"), parts.count()
    return e.join(p, (i % n) == F.col("k")).select(
        "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), "query", F.when(i % 5 != 0,
            F.md5(i.cast("string"))).alias("query_id"), F.lit("products").alias("index_name"), (i % 7).alias("nb_hits"), (
            i % 7 != 0).alias("has_results"),
        F.col("user_id").cast("string").alias("user_token"), F.when(i % 3 != 0,
            F.concat(F.lit("brand:B"), (i % 11).cast("string"), F.lit(" AND price >= "), (i % 13).cast("string"))).alias("filters"),
        F.when(i % 10 != 9, F.element_at(F.array(*map(F.lit, ["US", "FR", "DE", "ES"])), (F.col("user_id") % 4 + 1).cast(
            "int"))).alias("country"), F.element_at(F.array(*map(F.lit, ["web,desktop", "app,mobile", "app,tablet", "bot"])), (
            i % 4 + 1).cast("int")).alias("analytics_tags"),
    )


SEARCHES = """searches AS (
  SELECT event_id, epoch_us(ts) // 1000 AS timestamp_ms, p_name AS query, CASE
 WHEN event_id % 5 <> 0 THEN md5(event_id::VARCHAR) END AS query_id, 'products' AS index_name,
         event_id % 7 AS nb_hits, event_id % 7 <> 0 AS has_results, user_id::VARCHAR AS user_token,
         CASE WHEN event_id % 3 <> 0 THEN 'brand:B' || (event_id % 11) || ' AND price >= ' || (event_id % 13) END AS filters,
         CASE WHEN event_id % 10 <> 9 THEN ['US', 'FR', 'DE', 'ES'][(user_id % 4 + 1)::INT] END AS country,
         ['web,desktop', 'app,mobile', 'app,tablet', 'bot'][(event_id % 4 + 1)::INT] AS analytics_tags
  FROM events JOIN part ON event_id % (SELECT count(*) FROM part) = p_partkey
)"""


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insight events: clicks, views and purchases that refer to searches."""
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "purchase", "conversion").otherwise(F.col("event_type"))
    js = lambda a, b: F.concat(F.lit("["), a.cast("string"), F.lit(","), b.cast("string"), F.lit("]"))
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "purchase")).select(
        "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), kind.alias("event_type"), F.when(
            kind == "conversion", F.when(i % 2 == 0, "purchase").otherwise("addToCart")).alias("event_subtype"),
        F.lit("products").alias("index_name"), F.col("user_id").cast("string").alias("user_token"), F.when(i % 6 != 5,
            F.md5((i - i % 4).cast("string"))).alias("query_id"), js(i % 50, i % 37).alias("object_ids"),
        F.when(kind == "click", js(i % 25 + 1, i % 9 + 1)).alias("positions"), F.when(kind == "conversion",
            F.round("value", 2)).alias("value"), F.when(kind == "conversion", F.when(i % 3 == 0, "EUR").otherwise("USD")).alias(
            "currency"),
    )


INSIGHTS = """insights AS (
  SELECT event_id, epoch_us(ts) // 1000 AS timestamp_ms, CASE event_type
 WHEN 'purchase' THEN 'conversion' ELSE event_type END AS event_type,
         CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'purchase' ELSE 'addToCart' END END AS event_subtype, 'products' AS index_name, user_id::VARCHAR AS user_token,
         CASE WHEN event_id % 6 <> 5 THEN md5((event_id - event_id % 4)::VARCHAR) END AS query_id, [event_id % 50, event_id % 37] AS objects,
         CASE WHEN event_type = 'click' THEN [event_id % 25 + 1, event_id % 9 + 1] END AS places, CASE WHEN event_type = 'purchase' THEN round(value, 2) END AS value,
         CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'EUR' ELSE 'USD' END END AS currency
  FROM events WHERE event_type IN ('click', 'view', 'purchase')
)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary of part names."""
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("token")).distinct()


WORDS = "words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part)"


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with coordinates from their key."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("object_id"), ((k * 37) % 1700 / 10.0 - 85).alias("lat"), (
        (k * 91) % 3600 / 10.0 - 180).alias("lng"))


STORES = "stores AS (SELECT s_suppkey AS object_id, (s_suppkey * 37) % 1700 / 10.0 - 85 AS lat, (s_suppkey * 91) % 3600 / 10.0 - 180 AS lng FROM supplier)"
