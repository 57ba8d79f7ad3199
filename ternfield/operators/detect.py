"""Cascades, hard examples, restricted votes, normalised scores, and detections against true instances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ternfield.operators import classify
from ternfield.operators.positions import numbered


def cascade(ranked: DataFrame, second: DataFrame, *, top: int = 5) -> DataFrame:
    """(ex, truth, guess): the first of the ``top`` classes whose second score (ex, cls, second) is not above 0.

    The second classifiers score their own class below 0. guess is null where none accepts.
    """
    heads = ranked.where(F.col("rank") <= top).join(second, ["ex", "cls"], "left")
    first = F.min(F.when(F.col("second") <= 0, F.struct("rank", "cls")))["cls"]
    return heads.groupBy("ex", "truth").agg(first.alias("guess"))


def hard_examples(ranked: DataFrame, *, positive_top: int, negative_top: int | None = None) -> DataFrame:
    """(cls, ex, positive): what a second classifier of each class trains on.

    Positives are the class's own examples that rank it among the first ``positive_top``. Negatives are
    examples of other classes that rank it among the first ``negative_top``, or, without such a number,
    those that rank it after their true class.
    """
    own = F.max(F.when(F.col("cls") == F.col("truth"), F.col("rank"))).over(Window.partitionBy("ex"))
    rows = ranked.withColumn("own", own)
    false = (F.col("rank") <= negative_top) if negative_top else (F.col("rank") > F.col("own"))
    keep = F.when(F.col("cls") == F.col("truth"), F.col("rank") <= positive_top).otherwise(false)
    return rows.where(keep).select("cls", "ex", (F.col("cls") == F.col("truth")).alias("positive"))


def trainable(mined: DataFrame, *, least: int = 20) -> DataFrame:
    """(cls, positives, negatives) of the classes with ``least`` examples or more on both sides."""
    n = lambda c: F.sum(c.cast("long"))
    by = mined.groupBy("cls").agg(n(F.col("positive")).alias("positives"), n(~F.col("positive")).alias("negatives"))
    return by.where((F.col("positives") >= least) & (F.col("negatives") >= least))


def top_votes(ranked: DataFrame, *, top: int = 5) -> DataFrame:
    """(ex, truth, guess): votes of the pairs of classes among an example's ``top`` ones alone."""
    return classify.pair_votes(ranked.where(F.col("rank") <= top))


def off_class(scored: DataFrame) -> DataFrame:
    """(cls, mu, sd): mean and deviation of each class's scores on examples of other classes."""
    return scored.where("cls != truth").groupBy("cls").agg(F.avg("score").alias("mu"), F.stddev_samp("score").alias("sd"))


def normalised(scored: DataFrame) -> DataFrame:
    """scored in units of the class's off-class deviation; null where that is 0."""
    s = F.round(F.try_divide(F.col("score") - F.col("mu"), F.col("sd")), 6)
    return scored.join(F.broadcast(off_class(scored)), "cls").select("ex", "truth", "cls", s.alias("score"))


def sparsify(weights: DataFrame, quantile: float) -> DataFrame:
    """(i, j, d, w) with the weights below the pair's quantile of absolute weights set to 0."""
    cut = weights.groupBy("i", "j").agg(F.percentile(F.abs("w"), quantile).alias("cut"))
    kept = F.when(F.abs("w") >= F.col("cut") - 1e-12, F.col("w")).otherwise(0.0)
    return weights.join(F.broadcast(cut), ["i", "j"]).select("i", "j", "d", kept.alias("w"))


def density(values: DataFrame, value: str, *, low: float, high: float, points: int, width: float) -> DataFrame:
    """(x, density) on an even grid: the mean of normal densities around the values.

    Equal values are counted first, and the grid is a literal array, so nothing is joined.
    """
    step = (high - low) / (points - 1)
    counts = values.groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) + i * step)
    rows = counts.select("v", "n", F.explode(grid).alias("x"))
    kernel = F.exp(-F.pow((F.col("x") - F.col("v")) / width, 2) / 2) / (width * (2 * 3.141592653589793) ** 0.5)
    return rows.groupBy("x").agg((F.sum(F.col("n") * kernel) / F.sum("n")).alias("density"))


def sequences(symbols: DataFrame, wanted: list[str]) -> DataFrame:
    """(sig, s, e): runs of consecutive symbols (sig, ord, symbol, s, e) equal to the wanted ones."""
    w = Window.partitionBy("sig").orderBy("ord")
    fits = F.lit(True)
    for i, symbol in enumerate(wanted):
        fits &= F.lead("symbol", i).over(w).eqNullSafe(F.lit(symbol))
    return symbols.withColumn("fits", fits).withColumn("last", F.lead("e", len(wanted) - 1).over(w)).where("fits").select("sig", "s", F.col("last").alias("e"))


def context(intervals: DataFrame, *, share: float = 0.3) -> DataFrame:
    """(sig, s, e, ws, we): windows from share * length before the start to as much after it plus the longest length."""
    longest = intervals.agg(F.max(F.col("e") - F.col("s")).alias("longest"))
    r = share * (F.col("e") - F.col("s"))
    return intervals.join(F.broadcast(longest)).select("sig", "s", "e", (F.col("s") - r).alias("ws"), (F.col("s") + r + F.col("longest")).alias("we"))


def sliding_scores(cells: DataFrame, weights: DataFrame, const: DataFrame, *, length: int, size: int) -> DataFrame:
    """(ex, t, cls, score) of templates (cls, i, f, w) of ``size`` frames at each start inside ``length`` frames."""
    starts = F.sequence(F.greatest(F.lit(0), F.col("t") - size + 1), F.least(F.col("t"), F.lit(length - size)))
    at = cells.select("ex", F.col("t").alias("at"), "f", F.explode(starts).alias("t")).select("ex", "t", (F.col("at") - F.col("t")).alias("i"), "f")
    sums = at.join(F.broadcast(weights), ["i", "f"]).groupBy("ex", "t", "cls").agg(F.sum("w").alias("s"))
    return sums.join(F.broadcast(const), "cls").select("ex", "t", "cls", F.round(F.col("s") + F.col("b"), 6).alias("score"))


def matches(detections: DataFrame, truths: DataFrame, *, tolerance: float) -> DataFrame:
    """(sig, det, truth): detections (sig, det, mid) and true instances (sig, truth, tmid) one to one.

    Each takes the nearest of the other side within the tolerance, the lesser id of equals; both must agree. Only
    instances in the same or a neighbouring bin of the tolerance's width are compared.
    """
    slot = lambda c: F.floor(F.col(c) / tolerance)
    d = detections.withColumn("slot", slot("mid"))
    t = truths.withColumn("slot", F.explode(F.array(*[slot("tmid") + i for i in (-1, 0, 1)])))
    near = d.join(t, ["sig", "slot"]).withColumn("gap", F.abs(F.col("mid") - F.col("tmid"))).where(F.col("gap") <= tolerance)
    best = near.groupBy("sig", "det").agg(F.min(F.struct("gap", "truth")).alias("b")).select("sig", "det", "b.truth")
    back = near.groupBy("sig", "truth").agg(F.min(F.struct("gap", "det")).alias("b")).select("sig", "truth", "b.det")
    return best.join(back, ["sig", "det", "truth"])


def outcomes(detections: DataFrame, truths: DataFrame, *, tolerance: float) -> DataFrame:
    """(sig, hits, alarms, misses) of every signal with a detection or a true instance."""
    n = lambda df, name: df.groupBy("sig").agg(F.count("*").alias(name))
    hits = n(matches(detections, truths, tolerance=tolerance), "hits")
    both = n(detections, "d").join(n(truths, "t"), "sig", "full").join(hits, "sig", "left").fillna(0, ["d", "t", "hits"])
    return both.select("sig", "hits", (F.col("d") - F.col("hits")).alias("alarms"), (F.col("t") - F.col("hits")).alias("misses"))


def word_ids(words: Column, rows: DataFrame) -> DataFrame:
    """(word, id): the distinct words numbered in order, from 0; null is no word."""
    return numbered(rows.select(words.alias("word")).where("word is not null").distinct(), "word", name="id")


def two_class_sets(rows: DataFrame, first: Sequence[int], second: Sequence[int]) -> DataFrame:
    """The rows of two sets of classes, with y = 0 for the first and 1 for the second."""
    return rows.where(F.col("cls").isin([*first, *second])).withColumn("y", F.when(F.col("cls").isin(list(first)), 0).otherwise(1))


def prepared_subgradient(rows: DataFrame, weights: DataFrame, *, shrink: float, eps: float) -> DataFrame:
    """(d, w): weights (d, w) times ``shrink`` plus the sub-gradient over rows (ex, idx, y) in error."""
    one = F.broadcast(weights.agg(F.map_from_entries(F.collect_list(F.struct("d", "w"))).alias("w")))
    z = F.aggregate("idx", F.lit(0.0), lambda acc, d: acc + F.coalesce(F.try_element_at("w", d), F.lit(0.0)))
    scored = rows.crossJoin(one).withColumn("z", F.round(z, 9))
    wrong = error_margin(scored, F.col("z"), eps=eps).where("part = 'error'")
    grad = wrong.select(F.explode("idx").alias("d"), "y").groupBy("d").agg(F.sum(-F.col("y")).alias("g"))
    return weights.join(grad, "d", "left").select("d", (F.col("w") * shrink + F.coalesce("g", F.lit(0))).alias("w"))


def error_margin(rows: DataFrame, score: Column, *, eps: float) -> DataFrame:
    """rows (ex, y, …) with ``part``: error where -y*score is above -1 + eps, margin within eps of -1, else none."""
    z = -F.col("y") * score
    return rows.withColumn("part", F.when(z > -1 + eps, "error").when(F.abs(z + 1) <= eps, "margin"))
