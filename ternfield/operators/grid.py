"""Grids of linear one-against-the-rest learners: every (penalty, class) is a weight row, and all rows share each pass.

A pass over the examples is one aggregation: the pulls of the training rows on all weight rows, feature by feature, and
the hits of the development rows under each penalty, so accuracy by pass costs no pass of its own but the last.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ternfield.operators.learn import margins


def _pass(rows: DataFrame, w: np.ndarray, of: list[int], n_penalties: int, dim: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(gradient [row, feature], hits by penalty, development rows) under the weights w."""
    k = len(of) // n_penalties
    scored = margins(rows, w)
    of_row = F.array(*[F.lit(c) for c in of])
    y = F.zip_with("z", of_row, lambda z, c: F.when(c == F.col("cls"), 1.0).otherwise(-1.0))
    pull = F.zip_with("z", y, lambda z, s: F.when(~F.col("dev") & (z * s < 1), s).otherwise(0.0))
    block = lambda p: F.slice("z", F.lit(p * k + 1), F.lit(k))
    if k > 1:
        guess = lambda p: F.get(of_row, (F.array_position(block(p), F.array_max(block(p))) - 1).cast("int"))
        hit = lambda p: guess(p) == F.col("cls")
    else:
        hit = lambda p: (F.get("z", F.lit(p)) > 0) == (F.col("cls") == of[0])
    hits = F.array(*[F.when(F.col("dev") & hit(p), 1.0).otherwise(0.0) for p in range(n_penalties)])
    at = F.concat(F.coalesce("idx", F.array().cast("array<int>")), F.array(F.lit(-1)))
    long = scored.select(F.explode(at).alias("d"), pull.alias("pull"), hits.alias("hits"), F.col("dev").cast("double").alias("dev"))
    sums = [F.sum(F.get("pull", F.lit(j))).alias(f"g{j}") for j in range(len(of))] + [F.sum(F.get("hits", F.lit(p))).alias(f"h{p}") for p in range(n_penalties)]
    grad, found, held = np.zeros((len(of), dim)), np.zeros(n_penalties), 0.0
    for r in long.groupBy("d").agg(*sums, F.sum("dev").alias("dev")).collect():  # a row a feature
        if r["d"] < 0:
            found, held = np.array([r[f"h{p}"] for p in range(n_penalties)]), r["dev"]
        else:
            grad[:, r["d"]] = [r[f"g{j}"] for j in range(len(of))]
    return grad, found, held


def linear_grid(rows: DataFrame, dim: int, classes: Sequence[int], penalties: Sequence[float], *, passes: int = 3, start: np.ndarray | None = None, start_step: int = 0) -> tuple[DataFrame, np.ndarray]:
    """((pass, penalty, accuracy), weights [penalty, class, feature]) of hinge fits of rows (cls, idx, dev).

    ``penalties`` are the C of half the squared norm plus C times the hinge losses of the rows without ``dev``; a pass is
    one sub-gradient step over all of them. Accuracy is on the rows with ``dev``, by the best class, the first of
    equals, or with one class by the sign; null without such rows. ``start`` (class x feature) and ``start_step`` warm
    start every penalty. Null features are none.
    """
    of = [int(c) for _ in penalties for c in classes]
    n = rows.where(~F.col("dev")).count()
    w = np.zeros((len(of), dim)) if start is None else np.tile(np.asarray(start, float), (len(penalties), 1))
    rate = np.repeat([1 / (c * max(n, 1)) for c in penalties], len(classes))
    seen = []
    for t in range(passes + 1):
        grad, found, held = _pass(rows, w, of, len(penalties), dim)
        if t:
            seen += [(t, float(c), float(h / held) if held else None) for c, h in zip(penalties, found, strict=True)]
        if t < passes:
            step = start_step + t + 1
            w = (1 - 1 / step) * w + (1 / (rate * step))[:, None] / max(n, 1) * grad
    return rows.sparkSession.createDataFrame(seen, "pass int, penalty double, accuracy double"), w.reshape(len(penalties), len(classes), dim)
