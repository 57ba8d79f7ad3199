"""Mixtures by node against plain code, and plans that do not grow with the features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ternfield.operators import iterate, learn, mixtures
from ternfield.sources import scratch


def plain_em(x, a, rounds, u=None):
    u = np.ones(len(x)) if u is None else u
    for _ in range(rounds):
        mass = (a * u[:, None]).sum(0)
        p = np.clip((a * u[:, None]).T @ x / np.maximum(mass, 1e-300)[:, None], 0.01, 0.99)
        z = x @ (np.log(p) - np.log(1 - p)).T + np.log(1 - p).sum(1) + np.log(np.maximum(mass / mass.sum(), 1e-300))
        ll = z.max(1) + np.log(np.exp(z - z.max(1, keepdims=True)).sum(1))
        a = np.exp(z - ll[:, None])
    return a, ll


def table(spark, x, **columns):
    rows = [(i, [int(d) for d in np.flatnonzero(r)], *[c[i] for c in columns.values()]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "ex long, idx array<int>, " + ", ".join(f"{n} {'double' if isinstance(c[0], float) else 'int'}" for n, c in columns.items()))


@pytest.mark.parametrize("broadcast", [True, False])
def test_nodes_are_fitted_apart(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(mixtures, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(5)
    x = (rng.random((90, 12)) < 0.3).astype(float)
    x[:, 7] = 0  # on nowhere
    node, u = [int(i) for i in rng.integers(0, 3, 90)], [float(v) for v in rng.random(90)]
    size = [2, 3, 1]
    df = table(spark, x, node=node, u=u, k=[size[n] for n in node])
    soft, model = mixtures.fit(df, 12, 3, nodes=3, rounds=3, weight="u")
    got = {r["ex"]: r for r in soft.collect()}
    for n in range(3):
        mine = [i for i in range(90) if node[i] == n]
        a, ll = plain_em(x[mine], np.eye(size[n])[[i % size[n] for i in mine]], 3, np.array(u)[mine])
        assert np.allclose([got[i]["a"] for i in mine], a) and np.allclose([got[i]["ll"] for i in mine], ll)
    rows = {r["node"]: r for r in model.collect()}
    assert [len(rows[n]["mean"]) for n in range(3)] == size and all(len(m) == 12 for r in rows.values() for m in r["mean"])
    assert sum(r["n"] for r in rows.values()) == 90


def test_odd_examples(spark):
    df = spark.createDataFrame([(0, []), (1, None), (2, [0, 3]), (3, [3])], "ex long, idx array<int>")
    soft, _ = iterate.em(df, 4, 2, rounds=2)
    assert all(abs(sum(r["a"]) - 1) < 1e-9 for r in soft.collect()) and soft.count() == 4
    none, history = iterate.em(df.limit(0), 4, 2, rounds=2, tol=1e-3)
    assert none.count() == 0 and set(history) <= {0.0}


def test_many_features_do_not_grow_the_plan(spark):
    """20,000 features: as many nodes in the plan as with 50, and the same results as plain code."""

    def fitted(dim, n=40):
        rng = np.random.default_rng(dim)
        x = (rng.random((n, dim)) < 0.02).astype(float)
        soft, _ = iterate.em(table(spark, x, cls=[i % 4 for i in range(n)]), dim, 3, rounds=2)
        return x, soft

    length = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    x, wide = fitted(20_000)
    _, narrow = fitted(50)
    assert length(wide) < 2 * length(narrow)
    a, _ = plain_em(x, np.eye(3)[[i % 3 for i in range(40)]], 2)
    assert np.allclose([r["a"] for r in wide.orderBy("ex").collect()], a)
    w = np.random.default_rng(0).normal(size=(4, 20_000))
    df = table(spark, x, cls=[i % 4 for i in range(40)])
    z = learn.margins(df, w)
    assert length(z) < 10_000
    assert np.allclose([r["z"] for r in z.orderBy("ex").collect()], x @ w.T)
    assert learn.multiclass(df, 20_000, [0, 1, 2, 3], steps=2, rate=1.0).shape == (4, 20_000)


def test_nested_clusters(spark):
    rng = np.random.default_rng(8)
    cls = [i % 2 for i in range(160)]
    p = np.where(np.arange(160)[:, None] % 4 < 2, 0.9, 0.1) * (np.arange(20) < 10) + np.where(np.arange(160)[:, None] % 4 < 2, 0.1, 0.9) * (np.arange(20) >= 10)
    x = (rng.random((160, 20)) < p).astype(float)
    df = table(spark, x, cls=cls)
    tree, leaves, model = mixtures.nested(df, 20, 2, least=10, most=3, rounds=4)
    a, _ = plain_em(x, np.eye(2)[[i % 2 for i in range(160)]], 4)
    t = {(r["cls"], r["cluster"]): r for r in tree.collect()}
    for c in range(2):
        for j in range(2):
            mass = int(np.floor(round(a[np.array(cls) == c, j].sum(), 6)))
            assert t[c, j]["mass"] == mass and t[c, j]["k"] == min(mass // 10, 3) and (t[c, j]["node"] is None) == (mass < 10)
    got = {r["ex"]: r for r in leaves.collect()}
    for (c, j), r in t.items():
        mine = [i for i in range(160) if cls[i] == c and a[i, j] > 0.9] if r["k"] else []
        assert {i for i, g in got.items() if (g["cls"], g["cluster"]) == (c, j)} == set(mine)
        if mine:
            inner, _ = plain_em(x[mine], np.eye(r["k"])[[i % r["k"] for i in mine]], 4)
            assert np.allclose([got[i]["a"] for i in mine], inner)
    assert model.count() == sum(r["k"] > 0 for r in t.values())


def test_joint_weights(spark):
    rng = np.random.default_rng(9)
    x, cls = (rng.random((60, 10)) < 0.4).astype(float), [i % 3 for i in range(60)]
    weighed, model, totals = mixtures.joint(table(spark, x, cls=cls), 10, 2, 3, rounds=2, inner=2)
    of = [np.flatnonzero(np.array(cls) == c) for c in range(3)]

    def means(a, u):
        mass = (a * u[:, None]).sum(0)
        return lambda rows: (np.clip((a * u[:, None]).T @ x[rows] / np.maximum(mass, 1e-300)[:, None], 0.01, 0.99), mass / mass.sum())

    models = [means(np.eye(2)[[i % 2 for i in rows]], np.ones(len(rows)))(rows) for rows in of]
    score = lambda m, rows: x[rows] @ (np.log(m[0]) - np.log(1 - m[0])).T + np.log(1 - m[0]).sum(1) + np.log(np.maximum(m[1], 1e-300))
    for t in range(2):
        z = np.hstack([score(m, np.arange(60)) for m in models])
        e = np.where(z - z.max(1, keepdims=True) > -13.8, np.exp(z - z.max(1, keepdims=True)), 0)
        u = np.array([e[i, 2 * c : 2 * c + 2].sum() for i, c in enumerate(cls)]) / e.sum(1)
        assert abs(totals[t] - u.sum()) < 1e-8
        for c, rows in enumerate(of):
            for _ in range(2):
                zc = score(models[c], rows)
                a = np.exp(zc - zc.max(1, keepdims=True))
                models[c] = means(a / a.sum(1, keepdims=True), u[rows])(rows)
    assert np.allclose([r["u"] for r in weighed.orderBy("ex").collect()], u)
    got = {r["node"]: r["mean"] for r in model.collect()}
    assert all(np.allclose(got[c], models[c][0]) for c in range(3))


def test_sweep_is_each_fit_alone(spark):
    rng = np.random.default_rng(3)
    x = (rng.random((50, 8)) < 0.4).astype(float)
    swept, _ = iterate.sweep(table(spark, x, cls=[0] * 50), 8, [2, 3], seeds=[1, 4], rounds=2)
    for r in swept.collect():
        start = np.eye(r["k"])[[(i % 65521 * 40503 + r["seed"] * 30341) % 65521 % r["k"] for i in range(50)]]
        assert abs(plain_em(x, start, 2)[1].sum() - r["loglik"]) < 1e-6


def test_array_row_round_trip(spark):
    row = scratch.array_row(spark, "t", w=np.array([[1.0, 2.0], [3.0, 4.0]]), b=np.array([5.0, 6.0])).select("w", "b", F.size("w")).first()
    assert row["w"] == [[1.0, 2.0], [3.0, 4.0]] and row["b"] == [5.0, 6.0]
