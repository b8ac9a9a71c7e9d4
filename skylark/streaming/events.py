"""Streams of events: ingestion into daily partitions, and the as-you-type filter with state by user."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skylark.operators.analytics import effective_ids, validation_error

COUNTED = "event_id long, user_token string, index_name string, t double, counted boolean"


def read_stream(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def ingest_stream(events: DataFrame, path: str, checkpoint: str, now_ms: int, interval: str | None = None):
    """Validate events and append them to index_name=/date= folders; restarts go on from the checkpoint."""
    valid = events.withColumn("ids", effective_ids()).where(validation_error(now_ms).isNull()).withColumn("date", F.to_date(
        F.timestamp_millis("timestamp")))
    writer = valid.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(
        "index_name", "date")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def dedup_stream(rows: DataFrame, window_s: int = 30) -> DataFrame:
    """The streaming form of dedup_searches over rows (event_id, user_token, index_name, t, at).

    The state is the second of the last event of a user and index; it is dropped when the watermark of `at`
    has passed twice the window, since the next event then opens a new search anyway. An event that comes more than
    four days late is left out, as the ingestion rejects it too (dedup_searches, which sees all rows at once, has no
    such limit)."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frame = pd.concat(list(batches)).sort_values(["t", "event_id"])
        last = state.get[0] if state.exists else None
        counted = []
        for t in frame["t"]:
            counted.append(last is None or int((t - last) // 1) >= window_s)
            last = t
        state.update((float(last),))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(frame["at"].max().timestamp() * 1000)) + 2 * window_s * 1000)
        yield pd.DataFrame({"event_id": frame["event_id"], "user_token": key[0], "index_name": key[1], "t": frame["t"], "counted": counted})

    kept = rows.select("event_id", "user_token", "index_name", "t", "at").withWatermark("at", "4 days")
    return kept.groupBy("user_token", "index_name").applyInPandasWithState(run, COUNTED, "last double", "append",
        GroupStateTimeout.EventTimeTimeout)


def run_to_memory(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """All that is available now of a stream, as a table; for tests and small replays."""
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append").trigger(
        availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
