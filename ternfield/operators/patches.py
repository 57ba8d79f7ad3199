"""Patches and parts over sparse binary arrays (ex, t, f): cells that are on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ternfield.operators import mixtures
from ternfield.sources.scratch import written


def patches(cells: DataFrame, *, height: int, width: int, size: int) -> DataFrame:
    """(ex, t, f, d): for each anchor whose patch lies inside, the places of the patch that are on."""
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(size) for j in range(size)])
    out = cells.select("ex", "t", "f", F.explode(offsets).alias("o")).select("ex", (F.col("t") - F.col("o.i")).alias("t"), (F.col("f") - F.col("o.j")).alias("f"), (F.col("o.i") * size + F.col("o.j")).alias("d"))
    return out.where(F.col("t").between(0, height - size) & F.col("f").between(0, width - size))


def part_codes(placed: DataFrame, weights: DataFrame, const: DataFrame, *, count_threshold: int = 1, likelihood_threshold: float = float("-inf")) -> DataFrame:
    """(ex, t, f, part): every part whose log likelihood is the anchor's best; patches with too few cells on have none."""
    score = placed.join(F.broadcast(weights), "d").groupBy("ex", "t", "f", "part").agg(F.sum("w").alias("s"), F.count("*").alias("on"))
    score = score.join(F.broadcast(const), "part").withColumn("s", F.round(F.col("s") + F.col("b"), 9))
    best = F.max("s").over(Window.partitionBy("ex", "t", "f"))
    return score.withColumn("best", best).where((F.col("s") == F.col("best")) & (F.col("on") >= count_threshold) & (F.col("best") >= likelihood_threshold)).select("ex", "t", "f", "part")


def channel_patches(cells: DataFrame, *, height: int, width: int, size: int, channels: int) -> DataFrame:
    """(ex, t, f, d) of cells (ex, t, f, e) with a channel: d counts the patch's rows, columns and channels in that order."""
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(size) for j in range(size)])
    place = (F.col("o.i") * size + F.col("o.j")) * channels + F.col("e")
    out = cells.select("ex", "t", "f", "e", F.explode(offsets).alias("o")).select("ex", (F.col("t") - F.col("o.i")).alias("t"), (F.col("f") - F.col("o.j")).alias("f"), place.alias("d"))
    return out.where(F.col("t").between(0, height - size) & F.col("f").between(0, width - size))


def channel_subset(cells: DataFrame, *, channels: Sequence[int], width: int) -> DataFrame:
    """The cells of some channels below a column."""
    return cells.where(F.col("e").isin(list(channels)) & (F.col("f") < width))


def value_patches(anchors: DataFrame, values: DataFrame, *, size: int) -> DataFrame:
    """(ex, t, f, d, s): the values (ex, t, f, s) in the patch at each anchor (ex, t, f)."""
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(size) for j in range(size)])
    at = anchors.select("ex", F.col("t").alias("at"), F.col("f").alias("af"), F.explode(offsets).alias("o"))
    at = at.select("ex", "at", "af", (F.col("at") + F.col("o.i")).alias("t"), (F.col("af") + F.col("o.j")).alias("f"), (F.col("o.i") * size + F.col("o.j")).alias("d"))
    return at.join(values, ["ex", "t", "f"]).select("ex", F.col("at").alias("t"), F.col("af").alias("f"), "d", "s")


def kept_parts(soft: DataFrame, *, least: float) -> DataFrame:
    """(comp, mass): the components whose responsibilities ``a`` add up to more than ``least``."""
    return soft.select(F.posexplode("a").alias("comp", "a")).groupBy("comp").agg(F.sum("a").alias("mass")).where(F.col("mass") > least)


def learn_parts(placed: DataFrame, values: DataFrame, dim: int, k: int, *, least: float, rounds: int = 2) -> DataFrame:
    """(part, mass, template, mean_patch): the components of a mixture over patches with more mass than ``least``.

    placed: (ex, idx), the places that are on in each patch; values: (ex, v), parallel data of it. template: how often a
    place is on in the part; mean_patch: the parallel data's mean, weighted by the responsibilities of the fit.
    """
    one = placed.withColumns({"node": F.lit(0).cast("long"), "k": F.lit(k)})
    soft, model = mixtures.fit(one, dim, k, rounds=rounds)
    soft = written(soft.select("ex", "a"), "part-shares")
    kept = kept_parts(soft, least=least)
    long = soft.join(values.select("ex", F.posexplode("v").alias("d", "x")), "ex").select("d", F.col("x").cast("double").alias("x"), F.posexplode("a").alias("comp", "a"))
    means = long.groupBy("comp", "d").agg((F.sum(F.col("a") * F.col("x")) / F.sum("a")).alias("m"))
    means = means.groupBy("comp").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda c: c["m"]).alias("mean_patch"))
    templates = model.select(F.posexplode("mean").alias("comp", "template"))
    return kept.join(templates, "comp").join(means, "comp").select(F.col("comp").alias("part"), "mass", "template", "mean_patch")


def part_places(codes: DataFrame) -> DataFrame:
    """(ex, part, n, places): where each part is active in an example, in order, of codes (ex, t, f, part)."""
    places = F.array_sort(F.collect_list(F.struct("t", "f")))
    return codes.groupBy("ex", "part").agg(F.count("*").alias("n"), places.alias("places"))


def spread(cells: DataFrame, *, radius: int, height: int, width: int, keep: Sequence[str] = ()) -> DataFrame:
    """Cells that are on within ``radius`` of one that is, inside the array; apart for each value of ``keep``."""
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)])
    out = cells.select("ex", "t", "f", *keep, F.explode(offsets).alias("o")).select("ex", (F.col("t") + F.col("o.i")).alias("t"), (F.col("f") + F.col("o.j")).alias("f"), *keep)
    return out.where(F.col("t").between(0, height - 1) & F.col("f").between(0, width - 1)).distinct()


def local_maxima(placed: DataFrame) -> DataFrame:
    """(ex, t, f, n): anchors with as many cells on as any neighbour."""
    n = placed.groupBy("ex", "t", "f").agg(F.count("*").alias("n"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    seen = n.select("ex", "t", "f", "n", F.explode(near).alias("o")).groupBy("ex", (F.col("t") + F.col("o.i")).alias("t"), (F.col("f") + F.col("o.j")).alias("f")).agg(F.max("n").alias("top"))
    return n.join(seen, ["ex", "t", "f"]).where("n >= top").select("ex", "t", "f", "n")


def inner_full(placed: DataFrame, *, size: int, radius: int, channels: int = 1) -> DataFrame:
    """The places of those anchors whose patch has something on in every cell within ``radius`` of its centre.

    With ``channels``, places count the channels of a cell last (as in ``channel_patches``); any of them is enough.
    """
    mid = size // 2
    inner = [(mid + i) * size + mid + j for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]
    cell = F.floor(F.col("d") / channels)
    full = placed.where(cell.isin(inner)).groupBy("ex", "t", "f").agg(F.size(F.collect_set(cell)).alias("on")).where(F.col("on") == len(inner))
    return placed.join(full.select("ex", "t", "f"), ["ex", "t", "f"], "left_semi")
