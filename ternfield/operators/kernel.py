"""Two-class machines with a radial kernel, exp(-gamma * squared distance), by kernelised mini-batch sub-gradients.

Each step scores a small batch against the support rows and adds those it gets wrong or hardly right. The batches are
disjoint parts of the rows in a fixed scattered order, so the support is bounded by steps x batch, whatever the table's
size; all (gamma, penalty) of a grid share the steps and the scoring. Scoring all rows is one pass in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a task holds against the support at once.
AT_ONCE = 1024


def scattered(ex: Column) -> Column:
    """A fixed order of rows that does not follow their ids; ids break ties."""
    return F.pmod(F.pmod(ex, F.lit(65521)) * 40503, F.lit(65521))


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    far = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(far, 0))


class Machines:
    """Support rows [n, dim] with their signs, and a coefficient of each for every (gamma, penalty)."""

    def __init__(self, models: Sequence[tuple[float, float]], support: np.ndarray, weight: np.ndarray):
        self.models, self.support, self.weight = list(models), support, weight

    def values(self, v: np.ndarray) -> np.ndarray:
        """[row, model]: decision values."""
        out = np.zeros((len(v), len(self.models)))
        for lo in range(0, len(v), AT_ONCE):
            for gamma in {g for g, _ in self.models}:
                k = kernel(v[lo : lo + AT_ONCE], self.support, gamma)
                mine = [j for j, (g, _) in enumerate(self.models) if g == gamma]
                out[lo : lo + AT_ONCE, mine] = k @ self.weight[:, mine]
        return out


def fit(rows: DataFrame, models: Sequence[tuple[float, float]], *, steps: int = 3, batch: int = 32) -> Machines:
    """Machines for each (gamma, C) of rows (ex, y, v) with y = -1 or 1 and v an array of numbers; null v are left out.

    After step t a support row weighs y / (rate t batch) for rate = 1 / (C n), n being the number of rows.
    """
    rows = rows.where(F.col("v").isNotNull())
    n = rows.count()
    taken = rows.select("ex", "y", F.col("v").cast("array<double>").alias("v"), scattered(F.col("ex")).alias("o")).orderBy("o", "ex").limit(steps * batch).collect()
    v, y = np.array([r["v"] for r in taken], float), np.array([r["y"] for r in taken], float)
    if not taken:
        return Machines(models, np.zeros((0, 1)), np.zeros((0, len(models))))
    rate = np.array([1 / (c * n) for _, c in models])
    used = np.zeros((len(taken), len(models)))
    for t in range(-(-len(taken) // batch)):
        now = slice(t * batch, (t + 1) * batch)
        f = Machines(models, v[: t * batch], used[: t * batch] * y[: t * batch, None] / (rate * t * batch)).values(v[now]) if t else np.zeros((len(v[now]), len(models)))
        used[now] = y[now, None] * f < 1
    t = -(-len(taken) // batch)
    keep = used.any(1)
    return Machines(models, v[keep], used[keep] * y[keep, None] / (rate * t * batch))


def decide(rows: DataFrame, machines: Machines) -> DataFrame:
    """rows (…, v) with ``f``, the decision value of every model, in the order of ``machines.models``; null for a null v."""

    @F.pandas_udf("array<double>")
    def values(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in parts:
            there = v.notna().to_numpy()
            known = np.array(v[there].tolist(), float) if there.any() else np.zeros((0, 1))
            f = iter(machines.values(known) if len(machines.support) else np.zeros((len(known), len(machines.models))))
            yield pd.Series([next(f) if t else None for t in there], dtype=object)

    return rows.withColumn("f", values(F.col("v").cast("array<double>")))


def accuracy(rows: DataFrame, machines: Machines) -> DataFrame:
    """(gamma, penalty, accuracy) on rows (y, v), by the sign of the decision value; 0 is negative."""
    long = decide(rows, machines).select("y", F.posexplode("f").alias("j", "f"))
    right = long.groupBy("j").agg(F.avg(((F.col("f") > 0) == (F.col("y") > 0)).cast("double")).alias("accuracy"))
    named = F.array(*[F.struct(F.lit(float(g)).alias("gamma"), F.lit(float(c)).alias("penalty")) for g, c in machines.models])
    return right.withColumn("m", F.get(named, F.col("j"))).select("m.gamma", "m.penalty", "accuracy")


def tuned(train: DataFrame, dev: DataFrame, test: DataFrame, models: Sequence[tuple[float, float]], *, steps: int = 3, batch: int = 32) -> tuple[float, float, float]:
    """(gamma, C, accuracy on test): the best model on dev, the first of equals, fitted again on train and dev together."""
    found = {(r["gamma"], r["penalty"]): r["accuracy"] for r in accuracy(dev, fit(train, models, steps=steps, batch=batch)).collect()}
    best = max(models, key=lambda m: found.get((float(m[0]), float(m[1])), 0.0))
    row = accuracy(test, fit(train.unionByName(dev), [best], steps=steps, batch=batch)).first()
    return float(best[0]), float(best[1]), row["accuracy"] if row else float("nan")
