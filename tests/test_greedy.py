"""Heads of intervals over many partitions against the plain loop, and their members against all pairs."""

import random

import pytest

from ternfield.operators import signal


def plain(rows):
    out, last = [], {}
    for sig, start, end in sorted((r for r in rows if r[1] is not None and r[2] is not None and r[1] <= r[2]), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1])):
        if sig not in last or start >= last[sig]:
            out.append((sig, start, end))
            last[sig] = end
    return sorted(out, key=repr)


def made(kind, n):
    rng = random.Random(kind)
    if kind == "one long signal":
        return [(1, s, s + rng.randrange(0, 40)) for s in (rng.randrange(n) for _ in range(n))]
    if kind == "nested":  # every interval starts later and ends earlier than the one outside it
        return [(1, i, 2 * n - i) for i in range(n)]
    if kind == "points":
        return [(i % 2, 5, 5) for i in range(20)] + [(0, 3, 5), (0, 5, 6), (1, 5, 9)]
    if kind == "many signals":
        return [(rng.choice([None, -7, 2**60, *range(30)]), s, s + rng.randrange(0, 9)) for s in (rng.randrange(200) for _ in range(n))]
    return [(1, None, 2), (1, 2, None), (2, 9, 3), (None, 1, 1), (1, -50, 400), (1, 3, 4), (1, 3, 4)]


@pytest.mark.parametrize("parts", [1, 13])
@pytest.mark.parametrize("kind", ["one long signal", "nested", "points", "many signals", "odd"])
def test_heads_over_partitions(spark, kind, parts):
    rows = made(kind, 1500)
    got = signal.heads(spark.createDataFrame(rows, "sig long, start long, end long"), parts=parts).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_no_intervals(spark):
    assert signal.heads(spark.createDataFrame([], "sig string, start long, end long")).count() == 0


def test_members_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), s, s + rng.choice([0, 1, 5, 30, 5000]), rng.random()) for s in (rng.randrange(600) for _ in range(400))]
    df = spark.createDataFrame(rows, "sig long, start long, end long, score double")
    taken = plain([r[:3] for r in rows]) + [(0, 100, 40_000)]
    want = set()
    for sig, a, b, x in rows:
        over = [(-(min(b, e) - max(a, s)), s) for g, s, e in taken if g == sig and min(b, e) > max(a, s)]
        if over:
            want.add((sig, a, b, x, min(over)[1]))
    got = signal.assign(df, spark.createDataFrame(taken, "sig long, start long, end long")).select("sig", "start", "end", "score", "head")
    assert sorted(map(tuple, got.collect())) == sorted(want)
