"""Event streams: windows with late data, sessions, and baskets kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema=None, files_per_trigger: int = 10, late: str = "1 hour") -> DataFrame:
    """A stream over a folder of Parquet files with columns like ``events``; time becomes a zoned timestamp with a watermark."""
    schema = schema or spark.read.parquet(folder).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per event-time window and type; works on a stream and on a table alike."""
    return events.groupBy(F.window("ts", width, slide or width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of each user, closed after ``gap`` without events."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")


def deduplicated(events: DataFrame) -> DataFrame:
    """Each event id once, as long as copies come within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def running_counts(events: DataFrame) -> DataFrame:
    """Per user the number of events and the last type so far, kept as arbitrary state: a row per user and batch."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, kind = state.get if state.exists else (0, -1, "")
        for f in frames:
            n += len(f)
            i = int(f["event_id"].idxmax())
            if f["event_id"][i] > last:
                last, kind = int(f["event_id"][i]), str(f["event_type"][i])
        state.update((n, last, kind))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_event": [last], "last_type": [kind]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, last_event long, last_type string", "n long, last_event long, last_type string", "update", GroupStateTimeout.NoTimeout)
