"""Linear learners by mini-batch sub-gradient steps: several weight rows a class, several losses, averaging.

A step is one pass over the examples: every example meets all weight rows (a written table of one row), and the
change of the weights is one aggregation with map-side sums. Weights (rows x features) are all that the driver holds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternfield.operators import mixtures
from ternfield.sources.scratch import array_row


def margins(examples: DataFrame, weights: np.ndarray, *, base: int | None = None, bias: str | None = None) -> DataFrame:
    """examples with ``z``, the score under every weight row.

    Features are ``idx`` (ids that are on) or, with a ``base``, ``cells`` of (idx, val) that count val / base.
    ``bias`` names an array column added to the scores. The weights are a written table of one row, broadcast up to
    ``mixtures.BROADCAST_BYTES``; beyond that every task reads the row itself.
    """
    row = array_row(examples.sparkSession, "weights", __w=weights, __b=np.zeros(len(weights)))
    row = F.broadcast(row) if weights.nbytes <= mixtures.BROADCAST_BYTES else row
    met = examples.crossJoin(row).withColumn("z", mixtures.scores("__w", "__b", base=base)).drop("__w", "__b")
    z = F.zip_with("z", bias, lambda a, b: a + b) if bias else F.col("z")
    return met.withColumn("z", F.transform(z, lambda x: F.round(x, 12)))


def pulls(scored: DataFrame, classes: Sequence[int], *, loss: str = "hinge", k: float = 1.0, gamma: float = 1.0, beta: float = 1.0) -> DataFrame:
    """scored with ``pull``, by weight row: how strongly the example draws the row to itself (below 0: pushes it off).

    ``own`` is the best row of the true class and ``off`` the best of the others, the first of equals.
    hinge: examples with off - own > -1 pull own and push off. ramp: only those with off - own < 1 too.
    self_paced: only those with k (1 + off - own) < 1 too. smoothed: the same examples as hinge, but all rows of a
    class share the pull by softmax at ``beta``, and those of others the push by softmax at ``gamma``.
    """
    of = F.array(*[F.lit(int(c)) for c in classes])
    rows = F.transform(F.arrays_zip(F.col("z").alias("z"), of.alias("c")), lambda r, i: F.struct(r["z"].alias("z"), (-i).alias("i"), r["c"].alias("c")))
    s = scored.withColumn("rows", rows)
    s = s.withColumn("own", F.array_max(F.filter("rows", lambda r: r["c"] == F.col("cls")))).withColumn("off", F.array_max(F.filter("rows", lambda r: r["c"] != F.col("cls"))))
    gap = F.col("off.z") - F.col("own.z")
    use = gap > -1
    if loss == "ramp":
        use &= gap < 1
    elif loss == "self_paced":
        use &= k * (1 + gap) < 1
    elif loss not in ("hinge", "smoothed"):
        raise ValueError(f"no such loss: {loss}")
    if loss == "smoothed":
        e_own = lambda r: F.when(r["c"] == F.col("cls"), F.exp((r["z"] - F.col("own.z")) / beta)).otherwise(0.0)
        e_off = lambda r: F.when(r["c"] != F.col("cls"), F.exp((r["z"] - F.col("off.z")) / gamma)).otherwise(0.0)
        s = s.withColumn("so", F.aggregate("rows", F.lit(0.0), lambda a, r: a + e_own(r))).withColumn("sf", F.aggregate("rows", F.lit(0.0), lambda a, r: a + e_off(r)))
        pull = lambda r: e_own(r) / F.col("so") - e_off(r) / F.col("sf")
    else:
        pull = lambda r: (r["i"] == F.col("own.i")).cast("double") - (r["i"] == F.col("off.i")).cast("double")
    return s.where(use & F.col("own").isNotNull() & F.col("off").isNotNull()).withColumn("pull", F.transform("rows", pull))


def gradient(pulled: DataFrame, n_rows: int, dim: int, *, base: int | None = None) -> np.ndarray:
    """[row, feature] sums of pull * feature."""
    part = pulled.select(F.explode("cells").alias("c"), "pull").select(F.col("c.idx").alias("d"), (F.col("c.val") / base).alias("x"), "pull") if base else pulled.select(F.explode("idx").alias("d"), F.lit(1.0).alias("x"), "pull")
    out = np.zeros((n_rows, dim))
    for r in part.groupBy("d").agg(*[F.sum(F.get("pull", j) * F.col("x")).alias(f"g{j}") for j in range(n_rows)]).collect():
        out[:, r["d"]] = [r[f"g{j}"] for j in range(n_rows)]
    return out


def projected(w: np.ndarray, rate: float) -> np.ndarray:
    """w scaled to the ball of radius 1 / sqrt(rate), in which the optimum lies."""
    norm = float(np.sqrt((w * w).sum()))
    return w * min(1.0, 1 / (np.sqrt(rate) * norm)) if norm else w


def pair_distance(w: np.ndarray) -> float:
    """The sum of squared distances of all pairs of rows."""
    return float(len(w) * (w * w).sum() - (w.sum(0) ** 2).sum())


def multiclass(
    examples: DataFrame,
    dim: int,
    classes: Sequence[int],
    *,
    steps: int,
    rate: float,
    start: np.ndarray | None = None,
    start_step: int = 0,
    loss: str = "hinge",
    project: bool = True,
    average: float | None = None,
    differences: bool = False,
    base: int | None = None,
    bias: str | None = None,
    **shape: float,
) -> np.ndarray:
    """Weights [row, feature]; row j belongs to ``classes[j]``. examples: (cls, idx or cells).

    A step moves by 1 / (rate (t + 1)) along the mean gradient. ``average`` = e keeps a running mean in which step t
    counts (e + 1) / (t + e + 1). ``differences`` shrinks the rows' differences in place of the rows. Examples of a
    class without a row, and with null features, have no pull; without examples the start is returned.
    """
    w = np.zeros((len(classes), dim)) if start is None else np.array(start, float)
    n, mean = examples.count(), w.copy()
    for t in range(start_step, start_step + steps if n else start_step):
        eta = 1 / (rate * (t + 1))
        g = gradient(pulls(margins(examples, w, base=base, bias=bias), classes, loss=loss, **shape), len(classes), dim, base=base)
        w = w - (len(w) * w - w.sum(0)) / (t + 1 + len(w)) if differences else (1 - eta * rate) * w
        w = w + eta / n * g
        if project and differences:
            far = pair_distance(w)
            w = w * min(1.0, 1 / np.sqrt(rate * far)) if far > 0 else w
        elif project:
            w = projected(w, rate)
        share = (average + 1) / (t - start_step + average + 1) if average is not None else 1.0
        mean = (1 - share) * mean + share * w
    return mean


def all_pairs(examples: DataFrame, dim: int, classes: Sequence[int], *, steps: int, rate: float) -> np.ndarray:
    """[pair, feature] two-class hinge fits of all pairs i < j at once: a step is one pass over the examples.

    An example takes part in the pairs of its class, as +1 for the pair's first class. No pair's examples are gathered.
    """
    pairs = [(i, j) for i in classes for j in classes if i < j]
    sizes = {r["cls"]: r["n"] for r in examples.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    n = np.array([sizes.get(i, 0) + sizes.get(j, 0) for i, j in pairs], float)
    w = np.zeros((len(pairs), dim))
    sign = F.array(*[F.when(F.col("cls") == i, 1.0).when(F.col("cls") == j, -1.0).otherwise(0.0) for i, j in pairs])
    for t in range(steps):
        eta = 1 / (rate * (t + 1))
        pull = F.zip_with("z", sign, lambda z, y: F.when(z * y < 1, y).otherwise(0.0))
        w = (1 - eta * rate) * w + eta / np.maximum(n, 1)[:, None] * gradient(margins(examples, w).withColumn("pull", pull), len(pairs), dim)
    return w


def kernel_features(rows: DataFrame, landmarks: DataFrame, *, width: float = 1.0) -> DataFrame:
    """(ex, k): the kernel exp(-distance / width) of each row's vector ``v`` to each landmark (mark, v), by mark.

    Landmarks are a fixed number of rows chosen by the caller; as one array they are broadcast to the rows.
    """
    marks = landmarks.agg(F.array_sort(F.collect_list(F.struct("mark", "v"))).alias("marks"))
    gap = lambda m: F.sqrt(F.aggregate(F.zip_with("v", m["v"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x))
    return rows.join(F.broadcast(marks)).select("ex", F.transform("marks", lambda m: F.exp(-gap(m) / width)).alias("k"))
