"""Streams over files that arrive in turn, with late and idle events."""

from datetime import datetime, timedelta

from ternfield.streaming import events as stream

START = datetime(2024, 1, 1)
SCHEMA = "user_id bigint, event_id bigint, event_type string, ts timestamp, value double"


def _rows(*minutes):
    return [(u, i, s, START + timedelta(minutes=m), 1.0) for u, i, s, m in minutes]


def _batches(spark, folder, batches):
    """One file a batch, in order of time of change."""
    import os
    import time

    for k, rows in enumerate(batches):
        part = folder / f"b{k}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(part))
        for f in part.glob("*.parquet"):
            os.utime(f, (time.time() - 1000 + 10 * k,) * 2)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_transitions_take_their_place_in_time(spark, tmp_path):
    batches = [
        _rows((1, 1, "a", 0), (1, 3, "c", 6)),
        _rows((1, 2, "b", 3), (2, 1, "x", 5)),  # b is behind c, but not late
        _rows((1, 4, "d", 60)),
        _rows((1, 5, "late", 1), (1, 6, "e", 61)),  # behind the watermark by far
        _rows((3, 1, "z", 200)),
    ]
    got = stream.drained(stream.transitions(_batches(spark, tmp_path, batches)), "t")
    assert sorted(map(tuple, got.collect())) == [(1, "a", "b"), (1, "b", "c"), (1, "c", "d"), (1, "d", "e")]


def test_idle_users_are_forgotten(spark, tmp_path):
    batches = [_rows((1, 1, "a", 0)), _rows((2, 1, "x", 100)), _rows((2, 2, "y", 400)), _rows((2, 4, "v", 450)), _rows((1, 2, "b", 500)), _rows((2, 3, "w", 900))]
    got = stream.drained(stream.transitions(_batches(spark, tmp_path, batches), idle_ms=60_000), "t")
    assert (1, "a", "b") not in set(map(tuple, got.collect()))
    other = tmp_path / "again"
    other.mkdir()
    got = stream.drained(stream.transitions(_batches(spark, other, batches)), "t")
    assert (1, "a", "b") in set(map(tuple, got.collect()))


def test_windows_leave_out_late_events(spark, tmp_path):
    batches = [_rows((1, 1, "a", 0), (1, 2, "a", 59)), _rows((1, 3, "a", 90)), _rows((2, 9, "a", 91)), _rows((1, 4, "a", 5)), _rows((1, 5, "a", 300))]
    got = stream.drained(stream.symbol_windows(_batches(spark, tmp_path, batches)), "w").orderBy("start").collect()
    assert [(r["n"], r["mean"]) for r in got] == [(2, 1.0), (2, 1.0)]
