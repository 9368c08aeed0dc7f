"""Queries of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenir.plans.catalogue import query
from provenir.streaming import follow


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events
  WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOUR FROM events) GROUP BY ALL""")
def t6_windowed_counts(spark, d):
    """Windows that the watermark has closed, two hours behind the last event."""
    events = follow.arrivals(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a zone: the session's, there and back
    return follow.drained(follow.windowed_counts(events), "windows").withColumn("start", F.col("start").cast("timestamp_ntz"))
