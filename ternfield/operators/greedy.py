"""Greedy choice of non-overlapping intervals over signals of any length, by range partitions that hand over one number.

By end, an interval is taken if it starts at or after the end of the last one taken. In that order only intervals that
start no earlier than all before them can be taken, so each partition first drops the others. What a partition does
then depends on what came before through one number, the last end taken; it may change which of its intervals is taken
first, and the choices that follow soon run together. A partition therefore reports, for each range of that number, the
last end that it hands on; these few rows are put together in order on the driver, and each partition, told its
number, emits its choice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ternfield.sources.scratch import written


def _runs(sig: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, list]:
    """(start of each run of equal signals and the end of the last, their values) of sorted signals, null being one."""
    if isinstance(sig, pa.ChunkedArray):
        sig = sig.combine_chunks()
    coded = sig.dictionary_encode(null_encoding="encode")
    codes = coded.indices.to_numpy(zero_copy_only=False)
    at = np.flatnonzero(np.diff(codes, prepend=-1))
    return np.append(at, len(codes)), [coded.dictionary[int(codes[i])].as_py() for i in at]


def _candidates(rows: DataFrame, n: int) -> DataFrame:
    """(sig, start, end, part, no), written: intervals that start no earlier than those before them in their signal and part."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, last, top = TaskContext.get().partitionId(), 0, (), 0
        for b in batches:
            if not len(b):
                continue
            start = b.column("start").to_numpy(zero_copy_only=False)
            keep = np.empty(len(b), bool)
            at, values = _runs(b.column("sig"))
            for i, value in enumerate(values):
                mine = start[at[i] : at[i + 1]]
                high = np.maximum.accumulate(mine)
                if (value,) == last:
                    high = np.maximum(high, top)
                keep[at[i] : at[i + 1]] = mine >= high
                last, top = (value,), high[-1]
            out = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array([part] * len(out), pa.int32()), pa.array(range(no, no + len(out)), pa.int64())], ["sig", "start", "end", "part", "no"])
            no += len(out)

    kinds = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("no", T.LongType())])
    return written(rows.repartitionByRange(n, "sig", "end", "start").sortWithinPartitions("sig", "end", "start").mapInArrow(each, kinds), "interval-candidates")


def _following(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each candidate, the one taken after it (the count, if none); starts do not fall."""
    return np.maximum(np.arange(1, len(start) + 1), np.searchsorted(start, end))


def handed_on(start: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
    """(bounds, ends): what a signal's candidates hand on. For a last end x, it is that of the first bound >= x, or x itself beyond all."""
    after, out = _following(start, end).tolist(), end.tolist()
    for i in range(len(out) - 1, -1, -1):
        if after[i] < len(out):
            out[i] = out[after[i]]
    # no earlier end is beyond the first one here
    reach = min(int(np.searchsorted(start, end[0])), len(out) - 1) + 1
    change = [i for i in range(reach) if i == reach - 1 or out[i] != out[i + 1]]
    return [int(start[i]) for i in change], [out[i] for i in change]


def _put(x: int | None, bounds: list[int], ends: list[int]) -> int:
    if x is None:
        return ends[0]
    return next((e for b, e in zip(bounds, ends, strict=True) if b >= x), x)


def heads(intervals: DataFrame, *, parts: int | None = None) -> DataFrame:
    """(sig, start, end): by end, each interval that starts at or after the end of the last one taken.

    Intervals without a start or an end, and those that end before they start, are left out; a null signal is a signal.
    Work is dealt over ``parts`` ranges of (sig, end, start), as many as shuffle partitions unless told.
    """
    rows = intervals.where("start <= end").select("sig", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = _candidates(written(rows, "intervals"), n)

    def report(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        at, values = _runs(table["sig"])
        start, end = table["start"].to_numpy(), table["end"].to_numpy()
        bounds, ends = handed_on(start[: at[1]], end[: at[1]])
        last = handed_on(start[at[-2] :], end[at[-2] :])[1][0] if len(values) > 1 else None
        first = pa.array([values[0]], table["sig"].type), pa.array([values[-1]], table["sig"].type)
        return pa.table([table["part"].combine_chunks()[:1], *first, pa.array([len(values) == 1]), pa.array([bounds], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([last], pa.int64())], names=names)

    names = ["part", "first_sig", "last_sig", "whole", "bounds", "ends", "last"]
    kind = rows.schema["sig"].dataType.simpleString()
    reports = held.groupBy("part").applyInArrow(report, f"part int, first_sig {kind}, last_sig {kind}, whole boolean, bounds array<bigint>, ends array<bigint>, last bigint")
    given, sig, x = {}, (), None
    for r in sorted(reports.collect(), key=lambda r: r["part"]):  # a row a part
        given[r["part"]] = x if (r["first_sig"],) == sig else None
        x = _put(given[r["part"]], r["bounds"], r["ends"]) if r["whole"] else r["last"]
        sig = (r["last_sig"],)

    def take(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        at, values = _runs(table["sig"])
        start, end = table["start"].to_numpy(), table["end"].to_numpy()
        x, kept = given[table["part"][0].as_py()], []
        for i in range(len(values)):
            lo, hi = int(at[i]), int(at[i + 1])
            after = _following(start[lo:hi], end[lo:hi]).tolist()
            k = int(np.searchsorted(start[lo:hi], x)) if x is not None else 0
            x = None
            while k < hi - lo:
                kept.append(lo + k)
                k = after[k]
        return table.take(pa.array(kept, pa.int64())).select(["sig", "start", "end"])

    return held.groupBy("part").applyInArrow(take, f"sig {kind}, start bigint, end bigint")
