"""Streaming forms: windowed symbol counts, and transitions in event time kept as state by key."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ternfield.sources.scratch import shared_dir

STATE = "last string, ms array<bigint>, ids array<bigint>, symbols array<string>"


def symbol_windows(events: DataFrame, *, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, symbol, n, mean) by tumbling window; events later than ``late`` are left out by the watermark."""
    w = F.window("ts", length)
    counted = events.withWatermark("ts", late).groupBy(w.alias("w"), F.col("event_type").alias("symbol")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return counted.select(F.col("w.start").alias("start"), "symbol", "n", "mean")


def transitions(events: DataFrame, *, late: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """(user_id, prev, next) of each user's events in order of (milliseconds of ts, event_id), across batches.

    An event waits as state until the watermark has passed it, so that those up to ``late`` behind still take their place;
    those behind the watermark of their batch are left out. The last symbol of a user without events is kept for at least ``idle_ms`` of event time. Events
    with null ts, event_id or event_type are left out.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, *held = state.get if state.exists else (None, [], [], [])
        waiting, mark, out = list(zip(*held, strict=True)), state.getCurrentWatermarkMs(), []
        for part in parts:
            part = part[part["ms"] >= mark]  # Spark itself leaves out only what the batch before would have
            waiting += zip(part["ms"].tolist(), part["event_id"].tolist(), part["event_type"].tolist(), strict=True)
        waiting.sort()
        passed = sum(w[0] < mark for w in waiting)
        for _, _, symbol in waiting[:passed]:
            if last is not None:
                out.append((key[0], last, symbol))
            last = symbol
        rest = waiting[passed:]
        if rest or passed or not state.hasTimedOut:
            state.update((last, *([w[i] for w in rest] for i in range(3))))
            state.setTimeoutTimestamp(max(rest[0][0], mark + 1) if rest else mark + idle_ms)
        else:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "prev", "next"])

    known = events.where("ts is not null and event_id is not null and event_type is not null")
    rows = known.withWatermark("ts", late).select("user_id", "event_id", "event_type", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, prev string, next string", STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream appends for all that its sources hold now, written to the shared folder with its progress."""
    spark, path = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start(path)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
