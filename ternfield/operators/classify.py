"""Bernoulli templates, linear scores over sparse rows, predictions, votes and their evaluation.

Examples are (ex, cls, idx): idx holds the ids of the features that are on. Models are long tables. Scores are
rounded to 9 digits before they are ranked, so that ties are ties whatever the order of summation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ternfield.functions.features import clamp
from ternfield.operators.positions import running


def ones(examples: DataFrame) -> DataFrame:
    """(ex, cls, d): the features that are on."""
    return examples.select("ex", "cls", F.explode("idx").alias("d"))


def templates(examples: DataFrame, dim: int, *, low: float = 0.01, high: float = 0.99, weight: str | None = None) -> DataFrame:
    """(cls, d, p): share of a class's examples with the feature on, over the full grid, clamped. ``weight`` names a
    column of how many examples a row stands for."""
    many = F.sum(weight) if weight else F.count("*")
    sizes = examples.groupBy("cls").agg(many.alias("n"))
    grid = sizes.select("cls", "n", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("d"))
    seen = examples.select("*", F.explode("idx").alias("d")).groupBy("cls", "d").agg(many.alias("k"))
    return grid.join(seen, ["cls", "d"], "left").select("cls", "d", clamp(F.coalesce("k", F.lit(0)) / F.col("n"), low, high).alias("p"))


def log_odds(model: DataFrame) -> DataFrame:
    return model.select("cls", "d", (F.ln("p") - F.ln(1 - F.col("p"))).alias("w"))


def log_const(model: DataFrame) -> DataFrame:
    return model.groupBy("cls").agg(F.sum(F.ln(1 - F.col("p"))).alias("b"))


def weight_rows(weights: DataFrame, const: DataFrame) -> DataFrame:
    """(cls, w, b): each class's weights as one array, by feature."""
    rows = weights.groupBy("cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "w"))), lambda c: c["w"]).alias("w"))
    return rows.join(const, "cls")


def scores(examples: DataFrame, model: DataFrame) -> DataFrame:
    """(ex, truth, cls, score) of every example under every class; an example with nothing on has the constant.

    The model is a row a class, so it is broadcast and each example is scored in place, without a shuffle.
    """
    rows = F.broadcast(weight_rows(log_odds(model), log_const(model)))
    total = F.aggregate("idx", F.col("b"), lambda acc, i: acc + F.get("w", i))
    return examples.withColumnRenamed("cls", "truth").join(rows).select("ex", "truth", "cls", F.round(total, 9).alias("score"))


def soft_scores(examples: DataFrame, model: DataFrame, base: int) -> DataFrame:
    """(ex, cls, score) of fixed-point rows (ex, cells): the sum of weight * value / base."""
    rows = F.broadcast(weight_rows(log_odds(model), log_const(model)).drop("b"))
    total = F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + F.get("w", c["idx"]) * c["val"]) / base
    return examples.join(rows).select("ex", "cls", F.round(total, 6).alias("score"))


def ranked(scored: DataFrame) -> DataFrame:
    """scored with rank, from 1; equal scores rank by class."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("ex").orderBy(F.desc("score"), "cls")))


def predict(scored: DataFrame) -> DataFrame:
    """(ex, truth, guess): the first class of the best score."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "cls"))["cls"]
    return scored.groupBy("ex", "truth").agg(best.alias("guess"))


def rivals(scored: DataFrame) -> DataFrame:
    """(ex, own, rival_cls, rival, hinge): the true class's score, the best other class and 1 + rival - own."""
    other = F.min(F.when(F.col("cls") != F.col("truth"), F.struct((-F.col("score")).alias("s"), "cls")))
    own = F.max(F.when(F.col("cls") == F.col("truth"), F.col("score")))
    both = scored.groupBy("ex").agg(own.alias("own"), other.alias("o"))
    return both.select("ex", "own", F.col("o.cls").alias("rival_cls"), (-F.col("o.s")).alias("rival"), F.round(1 - F.col("o.s") - F.col("own"), 6).alias("hinge"))


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """(median): the element at floor(n / 2), from 0, of the sorted values; nulls are left out, no values give null."""
    counts = df.select(F.col(value).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return running(counts, "v", ["n"]).crossJoin(F.broadcast(total)).where(F.col("n_upto") > F.floor(F.col("total") / 2)).agg(F.min("v").alias("median"))


def confusion(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy(F.col("truth").alias("label"), "guess").agg(F.count("*").alias("n"))


def dense_confusion(cells: DataFrame) -> DataFrame:
    """All cells from 0 to the largest label and guess, zeros too."""
    ends = cells.agg(F.max("label").alias("r"), F.max(F.greatest("label", "guess")).alias("c"))
    grid = ends.select(F.explode(F.sequence(F.lit(0), "r")).alias("label"), "c").select("label", F.explode(F.sequence(F.lit(0), "c")).alias("guess"))
    return grid.join(cells, ["label", "guess"], "left").fillna(0, ["n"])


def normalised(cells: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("label"))
    return cells.select("label", "guess", F.round(F.try_divide(F.col("n"), total), 9).alias("share"))


def reduce_confusion(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cells with both sides mapped by (fine, coarse); a fine label without a coarse one has no cell."""
    m = F.broadcast(mapping)
    rows = m.select(F.col("fine").alias("label"), F.col("coarse").alias("coarse_label"))
    cols = m.select(F.col("fine").alias("guess"), F.col("coarse").alias("coarse_guess"))
    return cells.join(rows, "label").join(cols, "guess").groupBy("coarse_label", "coarse_guess").agg(F.sum("n").alias("n"))


def pair_weights(model: DataFrame) -> DataFrame:
    """(i, j, d, w): log-odds differences of every pair of classes i < j."""
    lo = log_odds(model)
    a, b = lo.select(F.col("cls").alias("i"), "d", F.col("w").alias("wi")), lo.select(F.col("cls").alias("j"), "d", F.col("w").alias("wj"))
    return a.join(b, "d").where("i < j").select("i", "j", "d", (F.col("wi") - F.col("wj")).alias("w"))


def pair_votes(scored: DataFrame, *, high_ties: bool = False) -> DataFrame:
    """(ex, truth, guess): each pair of classes votes by the sign of its score; a zero votes for none.

    A pair's score is the difference of the classes' own, so an example's votes come from its row of scores.
    """
    rows = scored.groupBy("ex", "truth").agg(F.array_sort(F.collect_list(F.struct("cls", "score"))).alias("s"))
    votes = F.transform("s", lambda a: F.struct(F.size(F.filter("s", lambda b: a["score"] > b["score"])).alias("v"), (a["cls"] if high_ties else -a["cls"]).alias("c")))
    top = F.array_max(votes)["c"]
    return rows.select("ex", "truth", (top if high_ties else -top).alias("guess"))


def known_pairs(scored: DataFrame) -> DataFrame:
    """(label, other, n): how often the classifier of the true class against another decides for that other."""
    own = F.max(F.when(F.col("cls") == F.col("truth"), F.col("score"))).over(Window.partitionBy("ex"))
    return scored.withColumn("own", own).where(F.col("cls") != F.col("truth")).groupBy(F.col("truth").alias("label"), F.col("cls").alias("other")).agg(F.sum((F.col("score") > F.col("own")).cast("long")).alias("n"))


def soft_assignment(scored: DataFrame, *, cut: float = 13.8) -> DataFrame:
    """(ex, cls, a): softmax over the classes; terms more than ``cut`` below the best are left out."""
    w = Window.partitionBy("ex")
    e = scored.withColumn("z", F.col("score") - F.max("score").over(w)).where(F.col("z") >= -cut).withColumn("e", F.exp("z"))
    return e.select("ex", "truth", "cls", (F.col("e") / F.sum("e").over(w)).alias("a"))


def two_proportion(model: DataFrame, sizes: DataFrame) -> DataFrame:
    """(i, j, d, z) for i < j with the pooled standard error."""
    m = model.join(F.broadcast(sizes), "cls")
    side = lambda c: m.select(F.col("cls").alias(c), "d", F.col("p").alias("p" + c), F.col("n").alias("n" + c))
    pool = (F.col("pi") * F.col("ni") + F.col("pj") * F.col("nj")) / (F.col("ni") + F.col("nj"))
    z = (F.col("pi") - F.col("pj")) / F.sqrt(pool * (1 - pool) * (1 / F.col("ni") + 1 / F.col("nj")))
    return side("i").join(side("j"), "d").where("i < j").select("i", "j", "d", z.alias("z"))
