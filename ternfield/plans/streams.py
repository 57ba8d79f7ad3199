"""Queries that read a given table as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ternfield.plans.catalog import query
from ternfield.sources.tables import table
from ternfield.streaming import events as stream


def _events(spark, sf):
    """The table's files as a stream."""
    there = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    return there.withColumn("ts", F.col("ts").cast("timestamp"))


@query("WITH h AS (SELECT date_trunc('hour', ts) AS h, event_type AS symbol, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1, 2) SELECT epoch_us(h) AS start, symbol, n, round(mean, 6) AS mean FROM h WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_windows(spark, sf):
    """Counts and means by hour and symbol of the hours that the watermark closed."""
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(start AS timestamp_ntz))")
    return stream.drained(stream.symbol_windows(_events(spark, sf)), "windows").select(start.alias("start"), "symbol", "n", F.round("mean", 6).alias("mean"))


@query("WITH e AS (SELECT *, epoch_ms(ts) AS ms FROM events), s AS (SELECT user_id, event_type AS prev, lead(event_type) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS next FROM e WHERE ms < (SELECT max(ms) - 600000 FROM e)) SELECT prev, next, count(*) AS n FROM s WHERE next IS NOT NULL GROUP BY 1, 2")
def stream_transitions(spark, sf):
    """Counts of neighbouring symbols of each user, in event time, of events that the watermark has passed."""
    return stream.drained(stream.transitions(_events(spark, sf)), "transitions").groupBy("prev", "next").agg(F.count("*").alias("n"))
