"""Bernoulli mixtures, many at once: every node (a class, a cluster, or the only one) has a mixture of its own.

A model is a written table, one row a node, with its components' means, log-odds and constants as arrays. An E-step
joins it to the examples by node: broadcast while it is small, shuffled beyond that. An M-step is one aggregation by
(node, feature), which sums the responsibilities, the features under them and the log likelihood of all nodes together;
its size in the plan depends on the components of a node, not on features, nodes or rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternfield.sources.scratch import written

#: Bytes of a model's arrays up to which it is broadcast.
BROADCAST_BYTES = 64 << 20
#: Places in the sums of what is no feature: log likelihood, weight of all examples, their number.
LOGLIK, WEIGHT, COUNT = -3, -2, -1


def _array(k: Column | int, f) -> Column:
    """f(0), ..., f(k - 1), none for k = 0."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(k > 0, F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), f))


def m_step(soft: DataFrame, dim: int, most: int, *, base: int | None = None, weight: str | None = None) -> DataFrame:
    """The model, written: (node, k, mass, mean, part, w, b, loglik, n) of soft (node, k, idx or cells, a[, ll]).

    ``a`` are responsibilities over the node's k <= ``most`` components and ``ll`` log likelihoods. mean: [k][dim],
    clamped to [.01, .99]; part: the components' shares; w, b: log-odds and constants of a score. With a ``base``,
    features are ``cells`` of (idx, val) that count val / base. ``weight`` names a column by which an example counts in
    mass, means and shares. Examples with null features count in mass and parts alone.
    """
    one = F.lit(1.0)
    u = F.col(weight).cast("double") if weight else one
    feature = lambda d, x: F.struct(d.cast("int").alias("d"), x.cast("double").alias("x"))
    on = F.transform("cells", lambda c: feature(c["idx"], c["val"] / base)) if base else F.transform("idx", lambda i: feature(i, one))
    ll = F.col("ll") if "ll" in soft.columns else F.lit(0.0)
    rest = F.array(feature(F.lit(LOGLIK), ll), feature(F.lit(WEIGHT), one), feature(F.lit(COUNT), one))
    long = soft.select("node", "k", u.alias("u"), "a", F.explode(F.concat(F.coalesce(on, F.array().cast("array<struct<d:int,x:double>>")), rest)).alias("c")).select("node", "k", "u", "a", "c.*")
    plain = F.when(F.col("d").isin(LOGLIK, COUNT), F.col("x")).otherwise(0.0)
    parts = [F.sum(F.coalesce(F.get("a", F.lit(c)), F.lit(0.0)) * F.col("u") * F.col("x")) for c in range(most)]
    sums = long.groupBy("node", "d").agg(F.max("k").alias("k"), F.sum(plain).alias("plain"), F.array(*parts).alias("s"))
    rows = sums.groupBy("node").agg(F.max("k").alias("k"), F.sort_array(F.collect_list(F.struct("d", "plain", "s"))).alias("rows"))  # dim + 3 at most
    rows = rows.select("node", "k", F.slice(F.get("rows", F.lit(1))["s"], F.lit(1), F.col("k")).alias("mass"), F.get("rows", F.lit(0))["plain"].alias("loglik"), F.get("rows", F.lit(2))["plain"].cast("long").alias("n"), F.slice("rows", F.lit(4), F.greatest(F.size("rows") - 3, F.lit(0))).alias("on"))
    # features that are on nowhere in the node, as gaps between those that are
    gap = lambda width: F.array_repeat(F.array().cast("array<double>"), width)
    filled = F.flatten(F.transform("on", lambda f, i: F.concat(gap(f["d"] - F.coalesce(F.get("on", i - 1)["d"], F.lit(-1)) - 1), F.array(f["s"]))))
    tail = F.lit(dim - 1) - F.coalesce(F.get("on", F.size("on") - 1)["d"], F.lit(-1))
    model = rows.withColumn("columns", F.concat(F.coalesce(filled, F.array().cast("array<array<double>>")), gap(tail)))
    clamp = lambda p: F.greatest(F.least(p, F.lit(0.99)), F.lit(0.01))
    mean = _array(F.col("k"), lambda c: F.transform("columns", lambda f: clamp(F.coalesce(F.get(f, c), F.lit(0.0)) / F.greatest(F.get("mass", c), F.lit(1e-300)))))
    total = F.aggregate("mass", F.lit(0.0), lambda acc, x: acc + x)
    part = F.transform("mass", lambda x: x / F.greatest(total, F.lit(1e-300)))
    model = model.select("node", "k", "mass", mean.alias("mean"), part.alias("part"), "loglik", "n")
    w = F.transform("mean", lambda row: F.transform(row, lambda p: F.ln(p) - F.ln(1 - p)))
    b = F.zip_with("mean", "part", lambda row, q: F.ln(F.greatest(q, F.lit(1e-300))) + F.aggregate(row, F.lit(0.0), lambda acc, p: acc + F.ln(1 - p)))
    return written(model.select("*", w.alias("w"), b.alias("b")), "mixture-model")


def with_model(examples: DataFrame, model: DataFrame, bytes_: int, *columns: str) -> DataFrame:
    """examples with the named columns of their node's model."""
    m = model.select("node", *columns)
    return examples.join(F.broadcast(m) if bytes_ <= BROADCAST_BYTES else m, "node")


def scores(w: str = "w", b: str = "b", *, base: int | None = None) -> Column:
    """[component]: the constant and the log-odds of the features that are on."""
    if base:
        dot = lambda row: F.aggregate(F.coalesce("cells", F.array().cast("array<struct<idx:int,val:int>>")), F.lit(0.0), lambda acc, c: acc + F.get(row, c["idx"]) * c["val"]) / base
    else:
        dot = lambda row: F.aggregate(F.coalesce("idx", F.array().cast("array<int>")), F.lit(0.0), lambda acc, i: acc + F.get(row, i))
    return F.zip_with(F.transform(w, dot), b, lambda a, c: a + c)


def e_step(examples: DataFrame, model: DataFrame, dim: int, most: int, nodes: int = 1, *, base: int | None = None) -> DataFrame:
    """examples (node, …) with ``a``, the responsibilities in their node's mixture, and ``ll``, their log likelihoods."""
    z = with_model(examples.drop("a", "ll", "k"), model, nodes * most * dim * 8, "k", "w", "b").withColumn("z", scores(base=base)).drop("w", "b")
    z = z.withColumn("m", F.array_max("z"))
    z = z.withColumn("ll", F.col("m") + F.ln(F.aggregate("z", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("m")))))
    return z.withColumn("a", F.transform("z", lambda x: F.exp(x - F.col("ll")))).drop("z", "m")


def mod_start(k: Column) -> Column:
    """One-hot responsibilities: component ex mod k."""
    return _array(k, lambda c: (F.pmod(F.col("ex"), k) == c).cast("double"))


def fit(examples: DataFrame, dim: int, most: int, *, nodes: int = 1, rounds: int = 2, start: Column | None = None, base: int | None = None, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(examples with a and ll, the last model) of EM in all nodes of examples (ex, node, k, idx or cells).

    Every round is one pass over the examples for all nodes. Starts from component ex mod k unless told otherwise.
    ``nodes`` and ``most`` bound the model's size, which decides how it travels.
    """
    soft, model = examples.withColumn("a", mod_start(F.col("k")) if start is None else start), None
    for _ in range(rounds):
        model = m_step(soft, dim, most, base=base, weight=weight)
        soft = e_step(examples, model, dim, most, nodes, base=base)
    return soft, model


def nested(examples: DataFrame, dim: int, k: int, *, least: int = 30, most: int = 6, sure: float = 0.9, rounds: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tree, leaves, model): clusters over all classes, and mixtures inside each (class, cluster), of examples (ex, cls, idx).

    tree: (cls, cluster, mass, node, k), a row a pair: its mass in the clusters' responsibilities, rounded down, and
    k = min(mass div ``least``, ``most``) components; node is null where that is 0. leaves: the examples of a node, those
    of its class that belong to its cluster by more than ``sure`` (above a half, so to one node at most), with their
    responsibilities and log likelihoods. All nodes are fitted together, one pass a round; model has a row each.
    """
    soft, _ = fit(examples.withColumns({"node": F.lit(0).cast("long"), "k": F.lit(k)}), dim, k, rounds=rounds)
    held = written(soft.select("ex", "cls", "idx", F.col("a").alias("share")), "nested-shares")
    mass = held.select("cls", F.posexplode("share").alias("cluster", "x")).groupBy("cls", "cluster").agg(F.sum(F.col("x").cast("decimal(38,9)")).cast("double").alias("mass"))
    inner = F.least(F.floor(F.floor(F.round("mass", 6)) / least), F.lit(most)).cast("int")
    tree = mass.select("cls", "cluster", F.floor(F.round("mass", 6)).cast("long").alias("mass"), inner.alias("k"))
    node = F.col("cls").cast("long") * k + F.col("cluster")
    tree = written(tree.withColumn("node", F.when(F.col("k") > 0, node)), "nested-tree")
    own = F.array_position(F.transform("share", lambda x: x > sure), True).cast("int") - 1
    members = held.withColumn("cluster", own).where("cluster >= 0").join(tree.where("k > 0").select("cls", "cluster", "node", "k"), ["cls", "cluster"])
    leaves = written(members.select("ex", "cls", "cluster", "idx", "node", "k"), "nested-members")
    soft, model = fit(leaves, dim, most, nodes=tree.where("k > 0").count(), rounds=rounds)
    return tree, soft, model


def joint(examples: DataFrame, dim: int, k: int, classes: int, *, rounds: int = 2, inner: int = 1, cut: float = 13.8) -> tuple[DataFrame, DataFrame, list[float]]:
    """(examples with u, model, total of u by round): mixtures of all classes, each example weighed by its class's posterior.

    examples: (ex, cls, idx). A class has k components, started at ex mod k. In every round an example meets the
    components of all classes in one pass: its weight u is the share of its own class's components in the sum of
    exp(score), those more than ``cut`` below the best left out. Then each class takes ``inner`` EM steps on its own
    examples, which count by u in mass and means and by its log likelihood without u.
    """
    of = examples.withColumns({"node": F.col("cls").cast("long"), "k": F.lit(k)})
    model = m_step(of.withColumn("a", mod_start(F.lit(k))), dim, k)
    totals, weighed = [], None
    for _ in range(rounds):
        every = written(model.where("node is not null").agg(F.sort_array(F.collect_list(F.struct("node", "w", "b"))).alias("every")), "joint-models")
        bytes_ = classes * k * dim * 8
        met = of.crossJoin(F.broadcast(every)) if bytes_ <= BROADCAST_BYTES else of.crossJoin(every)
        dot = lambda row: F.aggregate("idx", F.lit(0.0), lambda acc, i: acc + F.get(row, i))
        z = F.transform("every", lambda m: F.struct(m["node"].alias("node"), F.zip_with(F.transform(m["w"], dot), m["b"], lambda a, c: a + c).alias("z")))
        met = met.withColumn("zs", z).drop("every").withColumn("top", F.array_max(F.transform("zs", lambda m: F.array_max(m["z"]))))
        within = lambda m: F.aggregate(m["z"], F.lit(0.0), lambda acc, x: acc + F.when(x - F.col("top") > -cut, F.exp(x - F.col("top"))).otherwise(0.0))
        share = lambda keep: F.aggregate(F.filter("zs", keep), F.lit(0.0), lambda acc, m: acc + within(m))
        u = share(lambda m: m["node"] == F.col("node")) / share(lambda m: F.lit(True))
        weighed = written(met.withColumn("u", u).select(*of.columns, "u"), "joint-weights")
        totals.append(weighed.agg(F.sum("u")).first()[0])
        for _ in range(inner):
            model = m_step(e_step(weighed, model, dim, k, classes), dim, k, weight="u")
    return weighed, model, totals
