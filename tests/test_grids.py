"""Grids of linear learners and kernel machines against plain code."""

import numpy as np
import pytest

from ternfield.operators import grid, kernel


def test_linear_grid_against_plain_code(spark):
    rng = np.random.default_rng(2)
    x, cls, dev = (rng.random((80, 9)) < 0.4).astype(float), rng.integers(0, 3, 80), rng.random(80) < 0.3
    df = spark.createDataFrame([(int(cls[i]), [int(d) for d in np.flatnonzero(x[i])], bool(dev[i])) for i in range(80)], "cls int, idx array<int>, dev boolean")
    start = rng.normal(size=(3, 9))
    seen, w = grid.linear_grid(df, 9, [0, 1, 2], [1.0, 0.05], passes=3, start=start, start_step=4)
    n = int((~dev).sum())
    want = {}
    for p, c in enumerate([1.0, 0.05]):
        v = start.copy()
        for t in range(3):
            y = np.where(cls[~dev, None] == np.arange(3), 1.0, -1.0)
            z = x[~dev] @ v.T
            rate = 1 / (c * n)
            v = (1 - 1 / (t + 5)) * v + (np.where(y * z < 1, y, 0).T @ x[~dev]) / (rate * (t + 5) * n)
            want[t + 1, c] = float((np.round(x[dev] @ v.T, 12).argmax(1) == cls[dev]).mean())
        assert np.allclose(w[p], v)
    got = {(r["pass"], r["penalty"]): r["accuracy"] for r in seen.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_linear_grid_on_odd_rows(spark):
    df = spark.createDataFrame([(1, [0], False), (0, None, False), (1, [], False)], "cls int, idx array<int>, dev boolean")
    seen, w = grid.linear_grid(df, 2, [1], [1.0], passes=2)
    assert w.shape == (1, 1, 2) and [r["accuracy"] for r in seen.collect()] == [None, None]
    assert (grid.linear_grid(df.limit(0), 2, [1], [1.0], passes=1)[1] == 0).all()


def plain_machine(v, y, gamma, c, steps, batch, n):
    alpha, far = np.zeros(len(v)), ((v[:, None] - v) ** 2).sum(2)
    for t in range(steps):
        for i in range(t * batch, min((t + 1) * batch, len(v))):
            f = (alpha[: t * batch] * y[: t * batch] * np.exp(-gamma * far[i, : t * batch])).sum() * c * n / (t * batch) if t else 0
            alpha[i] = y[i] * f < 1
    return alpha * y * c * n / (steps * batch)


def test_kernel_machine_against_plain_code(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(120, 3))
    y = np.where((v**2).sum(1) < 2.4, 1, -1)  # no line parts them
    rows = spark.createDataFrame([(i, int(y[i]), [float(a) for a in v[i]]) for i in range(120)], "ex long, y int, v array<double>")
    models = [(0.5, 1.0), (0.5, 0.1), (2.0, 1.0)]
    machines = kernel.fit(rows, models, steps=3, batch=20)
    order = sorted(range(120), key=lambda i: (i % 65521 * 40503 % 65521, i))[:60]
    got = {r["ex"]: r["f"] for r in kernel.decide(rows, machines).collect()}
    for j, (g, c) in enumerate(models):
        a = plain_machine(v[order], y[order], g, c, 3, 20, 120)
        want = np.exp(-g * ((v[:, None] - v[order]) ** 2).sum(2)) @ a
        assert np.allclose([got[i][j] for i in range(120)], want)
    right = {(r["gamma"], r["penalty"]): r["accuracy"] for r in kernel.accuracy(rows, machines).collect()}
    assert max(right.values()) > 0.85 and set(right) == set(models)
    gamma, c, score = kernel.tuned(rows.where("ex < 70"), rows.where("ex between 70 and 95"), rows.where("ex > 95"), models, batch=20)
    assert (gamma, c) in models and score > 0.6


@pytest.mark.parametrize("n", [0, 1])
def test_kernel_machine_on_few_rows(spark, n):
    rows = spark.createDataFrame([(i, 1, [1.0, 2.0]) for i in range(n)], "ex long, y int, v array<double>")
    machines = kernel.fit(rows, [(1.0, 1.0)], batch=4)
    odd = spark.createDataFrame([(0, 1, None), (1, -1, [0.0, 0.0])], "ex long, y int, v array<double>")
    got = {r["ex"]: r["f"] for r in kernel.decide(odd, machines).collect()}
    assert got[0] is None and len(got[1]) == 1
