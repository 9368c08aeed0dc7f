"""Streams of events: windowed counts with late data, and directly-follows pairs with state."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.sources import tables


def arrivals(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    # As a pattern, since a stream's plain path must be a folder, and a table may be one file.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/{name}.parque[t]")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for all that has arrived, in append mode: rows that later arrivals could still change are not in it.

    Rows and checkpoint stand in the application's shared folder, so a lost executor costs its tasks only.
    """
    place = f"{tables.own_folder(stream.sparkSession)}/{uuid.uuid4().hex}"
    run = stream.writeStream.outputMode("append").format("parquet").option("path", f"{place}/{name}").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/{name}")


def windowed_counts(events: DataFrame, time: str = "ts", event: str = "event_type", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per type and window; rows later than ``late`` are dropped by the watermark."""
    w = F.window(time, size)
    return events.withWatermark(time, late).groupBy(w, event).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), event, "n")


def follow_pairs(events: DataFrame, case: str = "user_id", time: str = "ts", event: str = "event_type", late: str = "2 hours") -> DataFrame:
    """T6 on a stream: each event's successor in its case. State is one event per case and expires after ``late``.

    Batches are taken in event order; an event older than its case's last one starts no pair.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    hours = pd.Timedelta(late)

    def step(key, frames, state):
        last = None if state.hasTimedOut or not state.exists else state.get
        if state.hasTimedOut:
            state.remove()
            return
        out = []
        for pdf in frames:
            for t, e in sorted(zip(pdf[time], pdf[event])):
                if last is not None and t.value >= last[0]:
                    out.append((last[1], e))
                if last is None or t.value >= last[0]:
                    last = (t.value, e)
        if last is not None:
            state.update(last)
            state.setTimeoutTimestamp(max(int(last[0] // 1_000_000 + hours.total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["source", "target"])

    return events.withWatermark(time, late).groupBy(case).applyInPandasWithState(step, "source string, target string", "t bigint, e string", "append", GroupStateTimeout.EventTimeTimeout)
