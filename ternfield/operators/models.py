"""Models of several components a class, their scores and votes, and tables of class statistics.

Models are long tables (cls, comp, d, p, weight), small beside the examples. Scores are rounded to 9 digits
before they are ranked. Rows with null keys join nothing; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ternfield.functions.features import clamp

#: Terms more than this below the best are left out of a softmax.
CUT = 13.8


def component_templates(examples: DataFrame, dim: int, *, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(cls, comp, d, p, weight): templates of examples (ex, cls, comp, idx) and each component's share of its class."""
    sizes = examples.groupBy("cls", "comp").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy("cls")))
    grid = sizes.select("cls", "comp", "n", "weight", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("d"))
    seen = examples.select("cls", "comp", F.explode("idx").alias("d")).groupBy("cls", "comp", "d").agg(F.count("*").alias("k"))
    return grid.join(seen, ["cls", "comp", "d"], "left").select("cls", "comp", "d", clamp(F.coalesce("k", F.lit(0)) / F.col("n"), low, high).alias("p"), "weight")


def component_scores(examples: DataFrame, model: DataFrame) -> DataFrame:
    """(ex, truth, cls, comp, score): ln(weight) plus the log likelihood of every example under every component.

    A row a component is broadcast; its number of rows is that of the model, whatever the examples.
    """
    odds = F.ln("p") - F.ln(1 - F.col("p"))
    rows = model.groupBy("cls", "comp").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", odds.alias("w")))), lambda c: c["w"]).alias("w"), (F.sum(F.ln(1 - F.col("p"))) + F.ln(F.max("weight"))).alias("b"))
    total = F.aggregate("idx", F.col("b"), lambda acc, i: acc + F.get("w", i))
    return examples.select("ex", F.col("cls").alias("truth"), "idx").crossJoin(F.broadcast(rows)).select("ex", "truth", "cls", "comp", F.round(total, 9).alias("score"))


def best_components(scored: DataFrame) -> DataFrame:
    """(ex, own_comp, own, rival_cls, rival_comp, rival): the best component of the true class and of all others; ties to the least."""
    key = F.struct((-F.col("score")).alias("s"), "cls", "comp")
    mine = F.col("cls") == F.col("truth")
    both = scored.groupBy("ex").agg(F.min(F.when(mine, key)).alias("o"), F.min(F.when(~mine, key)).alias("r"))
    return both.select("ex", F.col("o.comp").alias("own_comp"), (-F.col("o.s")).alias("own"), F.col("r.cls").alias("rival_cls"), F.col("r.comp").alias("rival_comp"), (-F.col("r.s")).alias("rival"))


def smoothed_assignments(scored: DataFrame, *, beta: float, gamma: float) -> DataFrame:
    """(ex, cls, comp, own, a): a softmax over the true class's rows at ``beta`` and one over all others' at ``gamma``.

    The second has an extra mass exp(-(1 + off - true) / gamma), that of no error. Examples where that exponent is
    -CUT or less have a negligible gradient and no rows, and so have terms CUT or more below their best.
    """
    w = Window.partitionBy("ex")
    mine = F.col("cls") == F.col("truth")
    s = scored.withColumns({"true": F.max(F.when(mine, F.col("score"))).over(w), "off": F.max(F.when(~mine, F.col("score"))).over(w)})
    s = s.withColumn("extra", (1 + F.col("off") - F.col("true")) / gamma).where(F.col("extra") > -CUT)
    z = s.withColumn("z", F.when(mine, (F.col("score") - F.col("true")) / beta).otherwise((F.col("score") - F.col("off")) / gamma)).where(F.col("z") > -CUT)
    mass = F.sum(F.exp("z")).over(Window.partitionBy("ex", mine)) + F.when(mine, F.lit(0.0)).otherwise(F.exp(-F.col("extra")))
    return z.select("ex", "cls", "comp", mine.alias("own"), (F.exp("z") / mass).alias("a"))


def model_columns(model: DataFrame) -> DataFrame:
    """(cls, comp, column): places of a model's rows by class and component, from 0. A row a component meets in one window."""
    place = F.row_number().over(Window.orderBy("cls", "comp")) - 1
    return model.select("cls", "comp").distinct().select("cls", "comp", place.alias("column"))


def selected_rows(model: DataFrame, classes: Sequence[int]) -> DataFrame:
    """model's rows of the named classes, relabelled by their places in that list; others go."""
    ids = F.array(*[F.lit(c) for c in classes])
    place = F.array_position(ids, F.col("cls")).cast("int") - 1
    return model.withColumn("cls", place).where("cls >= 0")


def label_components(model: DataFrame, label: int) -> DataFrame:
    """(comp): the components of a class, once each."""
    return model.where(F.col("cls") == label).select("comp").distinct()


def ordered_rows(model: DataFrame) -> DataFrame:
    """(cls, comp, row): rows by class, inside it by component, as a stable sort by component and then by class leaves them."""
    return model_columns(model).select("cls", "comp", F.col("column").alias("row"))


def size_clipped(examples: DataFrame, dim: int) -> DataFrame:
    """(cls, d, p): templates clipped to [1 / 2n, 1 - 1 / 2n] for the n examples of each class."""
    sizes = examples.groupBy("cls").agg(F.count("*").alias("n"))
    grid = sizes.select("cls", "n", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))).alias("d"))
    seen = examples.select("cls", F.explode("idx").alias("d")).groupBy("cls", "d").agg(F.count("*").alias("k"))
    half = 1 / (2 * F.col("n"))
    return grid.join(seen, ["cls", "d"], "left").select("cls", "d", F.greatest(F.least(F.coalesce("k", F.lit(0)) / F.col("n"), 1 - half), half).alias("p"))


def weighted_features(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """(ex, d, v) with v times the feature's weight (d, w); features without a weight keep their value."""
    return cells.join(F.broadcast(weights), "d", "left").select("ex", "d", (F.col("v") * F.coalesce("w", F.lit(1.0))).alias("v"))


def with_soft_bias(cells: Column, dim: int, base: int) -> Column:
    """Fixed-point cells with a feature ``dim`` that has the value ``base``."""
    return F.array_append(cells, F.struct(F.lit(dim).alias("idx"), F.lit(base).alias("val")))


def pair_row(weights: DataFrame, bias: DataFrame) -> DataFrame:
    """One row (classes, pairs) of pair models trained apart: weights (i, j, d, w) and bias (i, j, b).

    A pair has the places pi and pj of its classes among the sorted classes, its bias and its weights by feature, so the
    row holds pairs x features numbers, whatever the number of examples.
    """
    rows = weights.groupBy("i", "j").agg(F.map_from_entries(F.collect_list(F.struct("d", "w"))).alias("w")).join(bias, ["i", "j"])
    one = rows.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("i", "j"))))).alias("classes"), F.collect_list(F.struct("i", "j", "b", "w")).alias("p"))
    at = lambda c: (F.array_position("classes", c) - 1).cast("int")
    return one.select("classes", F.transform("p", lambda p: F.struct(at(p["i"]).alias("pi"), at(p["j"]).alias("pj"), p["b"].alias("b"), p["w"].alias("w"))).alias("pairs"))


def pair_matrix(weights: DataFrame, bias: DataFrame, dim: int) -> DataFrame:
    """(row, neg, pos, b, w): pair models (i, j, d, w) and (i, j, b) as the rows of a matrix, numbered from 0 by neg, then pos.

    A positive score favours i, so that is pos. w is dense, 0 where a feature has no weight; a pair without any has a
    row of zeros. The pairs, not the examples, set the size of what is numbered.
    """
    held = weights.groupBy("i", "j").agg(F.map_from_entries(F.collect_list(F.struct("d", "w"))).alias("m"))
    order = bias.agg(F.array_sort(F.collect_list(F.struct(F.col("j").alias("neg"), F.col("i").alias("pos")))).alias("order"))
    named = order.select(F.posexplode("order").alias("row", "p")).select("row", "p.neg", "p.pos")
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0)))
    rows = bias.join(held, ["i", "j"], "left").select(F.col("j").alias("neg"), F.col("i").alias("pos"), "b", dense.alias("w"))
    return named.join(rows, ["neg", "pos"]).select("row", "neg", "pos", "b", "w")


def pair_guesses(examples: DataFrame, row: DataFrame, *, high_ties: bool = False) -> DataFrame:
    """(ex, truth, guess): votes of the pair models in ``row`` (of pair_row), which is broadcast; an example stays one row.

    A positive score votes for the pair's first class, a negative one for its second, zero for none. Ties go to the lowest
    class, or the highest. Features without a weight and null or empty ``idx`` add nothing; without pair models there are no guesses.
    """
    score = lambda p: F.round(F.aggregate(F.coalesce("idx", F.array().cast("array<int>")), p["b"], lambda acc, d: acc + F.coalesce(F.try_element_at(p["w"], d), F.lit(0.0))), 9)
    side = lambda p, s: F.when(s > 0, p["pi"]).when(s < 0, p["pj"]).otherwise(-1)
    signed = F.transform("pairs", lambda p: F.struct(p["pi"].alias("pi"), p["pj"].alias("pj"), score(p).alias("s")))
    places = F.transform(signed, lambda p: side(p, p["s"]))
    counts = F.aggregate(places, F.transform("classes", lambda c: F.lit(0)), lambda acc, at: F.transform(acc, lambda v, k: v + (k == at).cast("int")))
    named = F.zip_with(counts, "classes", lambda v, c: F.struct(v.alias("v"), (c if high_ties else -c).alias("c")))
    top = F.array_max(named)["c"]
    voted = examples.crossJoin(F.broadcast(row.where(F.size("pairs") > 0)))
    return voted.select("ex", F.col("cls").alias("truth"), (top if high_ties else -top).alias("guess"))


def pair_errors(examples: DataFrame, row: DataFrame) -> DataFrame:
    """(label, other, n): how many examples of each class the pair model of it and another gives to that other.

    row is that of pair_row, broadcast; an example meets only the models of its own class. A score of zero is no error.
    Classes without examples or without a model are left out.
    """
    score = lambda p: F.round(F.aggregate(F.coalesce("idx", F.array().cast("array<int>")), p["b"], lambda acc, d: acc + F.coalesce(F.try_element_at(p["w"], d), F.lit(0.0))), 9)
    met = examples.select("cls", "idx").crossJoin(F.broadcast(row)).withColumn("at", F.array_position("classes", F.col("cls")).cast("int") - 1)
    mine = F.filter("pairs", lambda p: (p["pi"] == F.col("at")) | (p["pj"] == F.col("at")))
    first = lambda p: p["pi"] == F.col("at")
    sides = F.transform(mine, lambda p: F.struct(F.get("classes", F.when(first(p), p["pj"]).otherwise(p["pi"])).alias("other"), (F.when(first(p), score(p)).otherwise(-score(p)) < 0).alias("wrong")))
    return met.select(F.col("cls").alias("label"), F.inline(sides)).groupBy("label", "other").agg(F.sum(F.col("wrong").cast("long")).alias("n"))


def vote_signs(pairs: DataFrame) -> DataFrame:
    """(i, j, cls, sign): for each pair model, +1 for the class that a positive score favours (i), -1 for the other."""
    sides = F.array(F.struct(F.col("i").alias("cls"), F.lit(1).alias("sign")), F.struct(F.col("j").alias("cls"), F.lit(-1).alias("sign")))
    return pairs.select("i", "j").distinct().select("i", "j", F.inline(sides))


def class_masses(soft: DataFrame) -> DataFrame:
    """(cls, comp, n): each class's responsibilities in each component, summed and cut to whole numbers."""
    return soft.select("cls", F.posexplode("a").alias("comp", "a")).groupBy("cls", "comp").agg(F.floor(F.round(F.sum("a"), 6)).cast("long").alias("n"))


def mass_divergence(masses: DataFrame) -> DataFrame:
    """(i, j, kl) of every ordered pair of classes, of (n + 0.5) / total: the total is not smoothed, as it is defined.

    Classes x components rows meet, a model's size. A class without mass divides by zero and gives null.
    """
    f = masses.withColumn("f", F.try_divide(F.col("n") + 0.5, F.sum("n").over(Window.partitionBy("cls"))))
    a, b = f.select(F.col("cls").alias("i"), "comp", F.col("f").alias("fi")), f.select(F.col("cls").alias("j"), "comp", F.col("f").alias("fj"))
    return a.join(b, "comp").groupBy("i", "j").agg(F.round(F.sum(F.col("fi") * (F.ln("fi") - F.ln("fj"))), 9).alias("kl"))


def similarity_graph(divergences: DataFrame, *, least: float = 0.6) -> DataFrame:
    """(i, j, w): exp(-kl) where that is ``least`` or more, without loops."""
    w = F.exp(-F.col("kl"))
    return divergences.where((w >= least) & (F.col("i") != F.col("j"))).select("i", "j", w.alias("w"))


def reordered(edges: list[tuple[int, int]], nodes: Sequence[int]) -> list[int]:
    """Reverse Cuthill-McKee order of a class graph: breadth first from a node of least degree, neighbours by degree, then reversed.

    Runs on the driver: a graph has a node a class.
    """
    near = {n: set() for n in nodes}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    by_degree = lambda ns: sorted(ns, key=lambda n: (len(near[n]), n))
    order: list[int] = []
    seen: set[int] = set()
    for start in by_degree(nodes):
        queue = [] if start in seen else [start]
        seen.update(queue)
        for n in queue:
            order.append(n)
            fresh = by_degree(near[n] - seen)
            seen.update(fresh)
            queue += fresh
    return order[::-1]


def two_sided_p(z: Column) -> Column:
    """2 * Phi(-abs(z)) by the Chebyshev fit of the complementary error function of Press et al., relative error under 1.2e-7."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + x / 2)
    fit = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        fit = fit * t + c
    return t * F.exp(fit - x * x)


def step_up(tests: DataFrame, p: str, *, alpha: float, total: Column) -> DataFrame:
    """tests that Benjamini and Hochberg's rule rejects: all up to the last rank k by p with p <= k * alpha / total.

    Tests x classes are a model's size; equal p are counted together, and one row a distinct p meets in a window.
    """
    by = tests.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("n"))
    upto = by.withColumn("k", F.sum("n").over(Window.orderBy(p)))
    last = upto.where(F.col(p) <= F.col("k") * alpha / total).agg(F.max(p).alias("last"))
    return tests.crossJoin(F.broadcast(last)).where(F.col(p) <= F.col("last")).drop("last")
