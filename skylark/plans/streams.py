"""Registered queries that run as streams; their result equals that of the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylark.plans import catalog
from skylark.plans.tables import table
from skylark.session import work_path
from skylark.streaming import events


def _replay(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """rows as files of a folder that a stream can read."""
    path = work_path(spark, name)
    rows.write.parquet(path)
    return path


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_searches over a replayed stream."""
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("user_token"), F.lit("products").alias("index_name"), (
            F.unix_micros(F.col("ts").cast("timestamp")) / 600_000_000.0).alias("t"), F.timestamp_seconds(
            F.unix_micros(F.col("ts").cast("timestamp")) / 600_000_000.0).alias("at")
    )
    path = _replay(spark, rows, "replay")
    stream = events.dedup_stream(events.read_stream(spark, path, rows.schema))
    out = work_path(spark, "dedup")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", work_path(spark,
        "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(events.COUNTED).parquet(out).select("event_id", "counted")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid events by day, after a stream wrote them into daily folders."""
    rows = catalog.raw_insights(spark, sf_dir)
    path, out = _replay(spark, rows, "raw"), work_path(spark, "ingested")
    q = events.ingest_stream(events.read_stream(spark, path, rows.schema), out, work_path(spark, "offsets"), catalog.NOW_MS)
    q.awaitTermination()
    return spark.read.parquet(out).groupBy(F.col("date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("events"))


QUERIES = {"stream_dedup": stream_dedup, "stream_ingest": stream_ingest}
SQL = {
    "stream_dedup": catalog.SQL["dedup_searches"],
    "stream_ingest": f"WITH v AS ({catalog.SQL['validate_insights']}) SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, count(*) AS events FROM v JOIN events USING (event_id) WHERE error IS NULL GROUP BY 1",
}
