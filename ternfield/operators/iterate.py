"""Iterative fits as DataFrame loops: Bernoulli mixtures by EM, linear classifiers by sub-gradient steps.

Mixtures are fitted by ``operators.mixtures``, whose models are written tables of one row a node. Weights of linear
classifiers (rows x features) come to the driver each step and go back as a written table of one row; the examples
never leave the executors, and each step is one aggregation with map-side sums.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternfield.operators import mixtures
from ternfield.operators.learn import margins


def m_step(soft: DataFrame, dim: int, k: int, *, base: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(means [k, dim] clamped to [.01, .99], weights [k]) of (idx or cells, a): a holds the responsibilities."""
    row = mixtures.m_step(_alone(soft, k), dim, k, base=base).select("mean", "part").first()
    return np.array(row["mean"]), np.array(row["part"])


def _alone(examples: DataFrame, k: int) -> DataFrame:
    """examples as the only node of ``operators.mixtures``."""
    return examples.withColumns({"node": F.lit(0).cast("long"), "k": F.lit(k)})


def mod_start(k: int) -> Column:
    """One-hot responsibilities: component ex mod k."""
    return mixtures.mod_start(F.lit(k))


def hashed_start(k: Column, seed: Column) -> Column:
    """One-hot responsibilities: a component by hash of ex and seed."""
    of = F.pmod(F.xxhash64("ex", seed), k)
    return F.transform(F.sequence(F.lit(0), k - 1), lambda c: (of == c).cast("double"))


def seeded_start(k: Column, seed: Column) -> Column:
    """One-hot responsibilities: a component by arithmetic on ex and seed, the same in any engine."""
    of = (F.pmod("ex", F.lit(65521)) * 40503 + seed * 30341) % 65521 % k
    return F.transform(F.sequence(F.lit(0), k - 1), lambda c: (of == c).cast("double"))


def em(examples: DataFrame, dim: int, k: int, *, rounds: int = 2, tol: float = 0.0, start: Column | None = None, base: int | None = None) -> tuple[DataFrame, list[float]]:
    """(examples with responsibilities a and log likelihoods ll, log likelihood by round). Starts from component ex mod k unless told otherwise.

    A round is one pass over the examples; the model is a written table of one row, so plans do not grow with rounds or
    features. With a ``tol`` the rounds end when one gains too little; without, the history is empty.
    """
    soft = _alone(examples, k).withColumn("a", mod_start(k) if start is None else start)
    history, model = [], None
    for _ in range(rounds):
        model = mixtures.m_step(soft, dim, k, base=base) if model is None else model
        soft, model = mixtures.e_step(_alone(examples, k), model, dim, k, base=base), None
        if tol:
            model = mixtures.m_step(soft, dim, k, base=base)  # sums up this round's likelihood and is the next one's model
            row = model.select("loglik").first()
            history.append(row[0] if row else 0.0)
            if len(history) > 1 and history[-1] - history[-2] <= -tol * history[-2]:
                break
    return soft.drop("node", "k"), history


def sweep(examples: DataFrame, dim: int, sizes: Sequence[int], *, seeds: Sequence[int], rounds: int = 4, start: Callable[[Column, Column], Column] = seeded_start) -> tuple[DataFrame, DataFrame]:
    """((k, seed, loglik), soft (ex, …, k, seed, a, ll)) of mixtures of several sizes from several starts.

    Every (size, start) is a node of one fit, so a round is one pass for all of them.
    """
    node = F.col("k").cast("long") * 1_000_003 + F.col("seed")
    tries = F.explode(F.array(*[F.struct(F.lit(int(k)).alias("k"), F.lit(int(s)).alias("seed")) for k in sizes for s in seeds])).alias("t")
    every = examples.select("*", tries).select(*examples.columns, "t.k", "t.seed").withColumn("node", node)
    soft, _ = mixtures.fit(every, dim, max(sizes), nodes=len(sizes) * len(seeds), rounds=rounds, start=start(F.col("k"), F.col("seed")))
    return soft.groupBy("k", "seed").agg(F.sum("ll").alias("loglik")), soft


def restarts(examples: DataFrame, dim: int, k: int, *, seeds: Sequence[int], rounds: int = 4) -> tuple[DataFrame, int, float]:
    """(examples with responsibilities, seed, log likelihood) of the best of several starts, fitted together; the least seed of equals."""
    swept, soft = sweep(examples, dim, [k], seeds=seeds, rounds=rounds, start=hashed_start)
    row = swept.orderBy(F.desc("loglik"), "seed").first()
    seed, total = (row["seed"], row["loglik"]) if row else (seeds[0], 0.0)
    return soft.where(F.col("seed") == seed).drop("node", "k", "seed"), seed, total


def kept_components(model: DataFrame, stay: Sequence[int]) -> DataFrame:
    """A model of one node with the components ``stay`` alone, their shares made 1 again."""
    at = F.array(*[F.lit(int(c)) for c in stay])
    pick = lambda col: F.transform(at, lambda c: F.get(col, c))
    left = F.aggregate(pick(F.col("part")), F.lit(0.0), lambda acc, x: acc + x)
    b = F.transform(pick(F.col("b")), lambda x: x - F.ln(left))
    return model.select("node", F.lit(len(stay)).alias("k"), pick(F.col("w")).alias("w"), b.alias("b"))


def pruned(examples: DataFrame, dim: int, k: int, *, least: float, rounds: int = 3, one_by_one: bool = False) -> tuple[DataFrame, int]:
    """(examples with responsibilities, components left): components with less mass than ``least`` go, and EM runs again.

    They go all together, or the smallest alone with ``one_by_one``, until all have that mass; one always stays.
    """
    soft, _ = em(examples, dim, k, rounds=rounds)
    while True:
        model = mixtures.m_step(_alone(soft, k), dim, k)
        row = model.select("mass").first()
        if row is None or k == 1:
            return soft, k
        mass = np.array(row["mass"])
        stay = mass >= least
        if one_by_one and not stay.all():
            stay = np.arange(k) != mass.argmin()
        if not stay.any():
            stay = np.arange(k) == mass.argmax()
        if stay.all():
            return soft, k
        model, k = kept_components(model, np.flatnonzero(stay)), int(stay.sum())
        soft = mixtures.e_step(_alone(examples, k), model, dim, k)
        for _ in range(rounds):
            soft = mixtures.e_step(_alone(examples, k), mixtures.m_step(soft, dim, k), dim, k)
        soft = soft.drop("node", "k")


def em_by_class(examples: DataFrame, dim: int, classes: Sequence[int], k: int, *, rounds: int = 2, weight: str | None = None) -> DataFrame:
    """examples (ex, cls, idx) with responsibilities inside their class: k components a class, all classes in one pass.

    ``weight`` names a column that scales an example's part in masses and means. Examples of other classes are left out.
    """
    of = examples.where(F.col("cls").isin([int(c) for c in classes])).withColumns({"node": F.col("cls").cast("long"), "k": F.lit(k)})
    soft, _ = mixtures.fit(of, dim, k, nodes=len(classes), rounds=rounds, weight=weight)
    return soft.drop("node", "k")


def cluster_means(soft: DataFrame, other: DataFrame, values: str) -> DataFrame:
    """(comp, d, mean): the responsibility-weighted mean of parallel data (ex, values array) in each component."""
    both = soft.select("ex", "a").join(other.select("ex", F.posexplode(values).alias("d", "x")), "ex")
    long = both.select("d", F.col("x").cast("double").alias("x"), F.posexplode("a").alias("comp", "a"))
    return long.groupBy("comp", "d").agg((F.sum(F.col("a") * F.col("x")) / F.sum("a")).alias("mean"))


def soft_transitions(soft: DataFrame, k: int) -> DataFrame:
    """(prev, next, p) of responsibilities (seq, t, a) over k components: how often ``next`` follows ``prev``.

    p is the sum of the products of neighbours' responsibilities over that of the earlier one's. Places are numbered by
    1 within a sequence; a gap ends a run. Neighbours meet by (seq, t), so a long sequence is not gathered.
    """
    before = soft.select("seq", (F.col("t") + 1).alias("t"), F.col("a").alias("was"))
    both = soft.select("seq", "t", "a").join(before, ["seq", "t"])
    cells = F.array(*[F.struct(F.lit(j).alias("prev"), F.lit(i).alias("next"), F.sum(F.get("was", F.lit(j)) * F.get("a", F.lit(i))).alias("s")) for j in range(k) for i in range(k)])
    whole = F.array(*[F.sum(F.get("was", F.lit(j))) for j in range(k)])
    out = both.agg(cells.alias("cells"), whole.alias("whole")).select(F.inline("cells"), "whole")
    return out.select("prev", "next", F.try_divide("s", F.get("whole", F.col("prev"))).alias("p"))


def pegasos(examples: DataFrame, dim: int, *, steps: int = 3, rate: float = 2.0) -> np.ndarray:
    """Weights [dim] of a two-class hinge fit on (idx, y) with y = -1 or 1, each step over all examples."""
    n, w = examples.count(), np.zeros(dim)
    for t in range(steps):
        eta = 1 / (rate * (t + 1))
        grad = np.zeros(dim)
        for r in margins(examples, w[None, :]).where(F.get("z", F.lit(0)) * F.col("y") < 1).select(F.explode("idx").alias("d"), "y").groupBy("d").agg(F.sum("y").alias("g")).collect():
            grad[r["d"]] = r["g"]
        w = (1 - eta * rate) * w + eta / n * grad
    return w
