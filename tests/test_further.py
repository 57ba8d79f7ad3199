"""Bounded samples, keyed orders, soft transitions, parts and stores by class against plain code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ternfield.operators import iterate, patches, samples
from ternfield.sources import by_class

P = samples.PRIME


def plain_key(i, seed):
    return ((i % P * 48_271 + 1_000_003 * (seed + 1)) % P * 69_621 + 7_919 * (seed + 1)) % P


@pytest.mark.parametrize("per_class,total", [(5, 1000), (50, 30), (7, 20), (1000, 1000)])
def test_capped_sample(spark, per_class, total):
    rows = [(i, "hot" if i % 3 else [None, "a", "b"][i // 3 % 3]) for i in range(400)] + [(None, "a"), (2**40, "b")]
    got = samples.capped_sample(spark.createDataFrame(rows, "id long, cls string").withColumn("part", F.lit("mine")), "id", "cls", per_class=per_class, total=total, seed=2)
    assert got.columns == ["id", "cls", "part"]
    kept, by = [], {}
    for i, c in sorted((r for r in rows if r[0] is not None), key=lambda r: (plain_key(r[0], 2), r[0])):
        by[c] = by.get(c, 0) + 1
        if by[c] <= per_class:
            kept.append((i, c))
    assert sorted((r["id"], r["cls"]) for r in got.collect()) == sorted(kept[:total])


def test_cursor_and_windows(spark):
    df = spark.createDataFrame([(i * 7,) for i in range(300)] + [(None,)], "id long")
    placed = samples.cursor(df, "id", seed=1)
    order = sorted((i * 7 for i in range(300)), key=lambda i: plain_key(i, 1))
    assert {r["id"]: r["place"] for r in placed.collect()} == {i: k for k, i in enumerate(order)}
    got = {r["id"] for r in samples.window(placed, 300, start=290, size=25).collect()}
    assert got == {*order[290:], *order[:15]}
    assert [r["id"] for r in samples.cursor(df, "id", seed=2).orderBy("place").collect()] != order
    assert samples.cursor(df.limit(0), "id").count() == 0


def test_soft_transitions(spark):
    rng = np.random.default_rng(1)
    a = rng.dirichlet(np.ones(3), size=(4, 6))
    rows = [(s, t, [float(x) for x in a[s, t]]) for s in range(4) for t in range(6) if not (s == 2 and t == 3)]
    got = {(r["prev"], r["next"]): r["p"] for r in iterate.soft_transitions(spark.createDataFrame(rows, "seq long, t long, a array<double>"), 3).collect()}
    pairs = [(a[s, t], a[s, t + 1]) for s in range(4) for t in range(5) if not (s == 2 and t in (2, 3))]
    top, whole = sum(np.outer(w, x) for w, x in pairs), sum(w for w, _ in pairs)
    assert all(abs(got[j, i] - top[j, i] / whole[j]) < 1e-12 for j in range(3) for i in range(3))


def test_learnt_parts(spark):
    rng = np.random.default_rng(4)
    x, v = (rng.random((60, 4)) < 0.5).astype(float), rng.normal(size=(60, 3))
    x[:30, :2], x[30:, 2:] = 1, 1
    placed = spark.createDataFrame([(i, [int(d) for d in np.flatnonzero(x[i])]) for i in range(60)], "ex long, idx array<int>")
    values = spark.createDataFrame([(i, [float(s) for s in v[i]]) for i in range(60)], "ex long, v array<double>")
    got = {r["part"]: r for r in patches.learn_parts(placed, values, 4, 2, least=5.0, rounds=2).collect()}
    a = np.eye(2)[[i % 2 for i in range(60)]]
    for _ in range(2):
        p = np.clip(a.T @ x / a.sum(0)[:, None], 0.01, 0.99)
        z = x @ (np.log(p) - np.log(1 - p)).T + np.log(1 - p).sum(1) + np.log(a.sum(0) / 60)
        a = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    for c in range(2):
        if a[:, c].sum() > 5:
            assert np.allclose(got[c]["template"], p[c]) and np.allclose(got[c]["mean_patch"], a[:, c] @ v / a[:, c].sum())
    assert len(got) == (a.sum(0) > 5).sum()


def test_store_by_class(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    df = spark.createDataFrame([(i, i % 3, [i % 5]) for i in range(30)] + [(99, None, None)], "ex long, cls int, idx array<int>")
    by_class.write_by_class(df, folder)
    assert by_class.unlike_manifest(spark, folder).count() == 0
    by_class.write_by_class(spark.createDataFrame([(500, 1, [0, 1])], "ex long, cls int, idx array<int>"), folder)
    assert by_class.unlike_manifest(spark, folder).count() == 0
    got = by_class.read_by_class(spark, folder, bias=9, reduced={0: 7, 1: 8}).collect()
    assert sorted(r["ex"] for r in got if r["cls"] == 1) == [500] and len(got) == 20 + 1 + 1
    assert {(r["cls"], r["reduced"]) for r in got} == {(0, 7), (1, 8), (2, None), (None, None)} and all(r["idx"][-1] == 9 for r in got)
    told = {r["cls"]: (r["n"], r["on"]) for r in by_class.manifest(spark, folder).collect()}
    assert told == {0: (10, 10), 1: (1, 2), 2: (10, 10), None: (1, 0)}
    some = by_class.read_by_class(spark, folder, classes=[2])
    read = some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == 10 and "cls" in read.split("PartitionFilters: [")[1].split("]")[0]
    spark.createDataFrame([(7, 2, [1])], "ex long, cls int, idx array<int>").write.mode("append").partitionBy("cls").parquet(f"{folder}/data")
    assert [r["cls"] for r in by_class.unlike_manifest(spark, folder).collect()] == [2]
