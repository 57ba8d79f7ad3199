"""Mixing sources to target weights by entropy balancing: every document gets a rate, every rate whole copies.

A source's documents are read at rates r that stay as near to 1 as they can (least sum of r ln r - r) while the words
read meet the source's target and no rate exceeds the cap. The solution is an exponential tilt, r = min(cap,
exp(lam * size / mean size)), with one multiplier a source; the multipliers solve the convex dual, whose gradient is
words read minus target. Rates depend on a document through (source, size) alone, so documents are counted once by
these two, and each Newton iteration is one aggregation of that table for all sources together.

Rates become copies in three steps, none of which draws at random: each (source, size) gets a whole number of copies
from running sums down the sizes, which leaves a source at most one long document away from its target; the rest is
settled by some copies more or less of sizes of every magnitude; and inside a (source, size) the documents of least hash get the odd copies. That choice
is made by shares of salted parts, so that no group of equal sizes meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ternfield.llm.common import cumulated, words, written

#: Rates are rounded to whole parts of a copy before they are summed, so that sums do not depend on their order.
PARTS = 1 << 20
#: About how many documents of one (source, size) are ranked together.
RANKED = 4096


def row_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def document_sizes(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, h), written: words and a hash of each row; a null text has no words."""
    return written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), row_hash(id_col, text_col).alias("h")), "mix-sizes")


def source_targets(counts: DataFrame, *, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, sid, source_size, target), written, from (source, size, n).

    Sources in the order of their code points, null last, are numbered by ``sid`` and weigh ``weights`` in turn. They
    share all words by weight; where that is over ``cap`` times a source's words it stops there, and the others share
    the excess. The level of words a weight at which all is dealt out is the greatest that any prefix of the sources,
    ordered by when they stop, leaves to the others.
    """
    sums = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    sums = written(sums.select(F.col("source").isNull().alias("last"), "source", "source_size", F.lit(1).cast("long").alias("one")), "mix-sources")
    placed = cumulated(sums, ["last", "source"], ["one"], "mix-order").withColumn("sid", F.col("one_upto") - 1)
    w = F.get(F.array(*[F.lit(int(x)) for x in weights]), (F.col("sid") % len(weights)).cast("int")).cast("long")
    placed = placed.select("source", "sid", "source_size", w.alias("w"), (F.lit(cap) * F.col("source_size")).alias("most"))
    stops = cumulated(written(placed.withColumn("stop", F.col("most") / F.col("w")), "mix-weights"), ["stop", "sid"], ["most", "w"], "mix-stops")
    total = placed.agg(F.sum("source_size").cast("double").alias("words"), F.sum("w").cast("double").alias("weight"))
    left = F.col("weight") - F.col("w_upto")
    level = stops.crossJoin(F.broadcast(total)).agg(F.max(F.when(left > 0, (F.col("words") - F.col("most_upto")) / left)).alias("rest"), F.max(F.col("words") / F.col("weight")).alias("even"))
    level = level.select(F.greatest("rest", "even").alias("level"))
    out = placed.crossJoin(F.broadcast(level)).select("source", "sid", "source_size", F.least(F.col("most").cast("double"), F.col("w") * F.col("level")).alias("target"))
    return written(out, "mix-targets")


def rate(lam: Column, x: Column, cap: float) -> Column:
    return F.when(lam * x >= math.log(cap), float(cap)).otherwise(F.exp(lam * x))


def multipliers(counts: DataFrame, targets: DataFrame, *, cap: int = 3, tolerance: float = 1e-9, most_rounds: int = 80) -> DataFrame:
    """(sid, source_size, target, mean, lam): the dual's solution, a source each.

    Newton on the logarithm of the words read, which is the dual's gradient plus the target, kept inside a bracket by
    halving it where a step leaves it. Sums are exact decimals, so reruns agree to the last digit. Sources without
    words keep 0.
    """
    by_source = counts.where("size > 0").groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = targets.alias("t").join(by_source.alias("m"), F.col("t.source").eqNullSafe(F.col("m.source")), "left").select("t.*", "m.mean")
    share = F.try_divide("target", F.col("source_size").cast("double"))
    full = (F.col("mean").isNotNull()) & (share >= cap * (1 - 1e-12))
    top = F.col("mean") * (math.log(cap) * (1 + 1e-9))  # all documents with words are at the cap
    state = state.select(
        "source", "sid", "source_size", "target", "mean",
        F.when(full, top).otherwise(0.0).alias("lam"),
        F.when(share < 1, F.ln(share) * F.col("mean")).otherwise(0.0).alias("low"),
        F.when(share < 1, 0.0).otherwise(top).alias("high"),
        (F.col("mean").isNotNull() & ~full).alias("open"),
    )
    state = written(state, "mix-state")
    sized = written(counts.where("size > 0").alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("s.sid", "c.size", "c.n"), "mix-counts")
    for _ in range(most_rounds):
        if state.where("open").isEmpty():
            break
        both = sized.join(state.where("open"), "sid")
        x = F.col("size") / F.col("mean")
        read = F.col("n") * F.col("size") * rate(F.col("lam"), x, cap)
        exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
        moved = both.groupBy("sid").agg(exact(read).alias("read"), exact(F.when(F.col("lam") * x < math.log(cap), read * x).otherwise(0.0)).alias("slope"))
        s = state.join(moved, "sid", "left")
        gap = F.ln(F.col("read") / F.col("target"))
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") - gap * F.try_divide(F.col("read"), F.col("slope"))
        inside = step.isNotNull() & (step > low) & (step < high)
        done = ~F.col("open") | (F.abs(gap) < tolerance) | (high - low <= 1e-12 * F.greatest(F.abs(low), F.abs(high)))
        state = written(s.select("source", "sid", "source_size", "target", "mean", F.when(done, F.col("lam")).when(inside, step).otherwise((low + high) / 2).alias("lam"), low.alias("low"), high.alias("high"), (~done).alias("open")), "mix-state")
    return state.select("source", "sid", "source_size", "target", "mean", "lam")


def copy_plan(counts: DataFrame, solved: DataFrame, *, cap: int = 3) -> DataFrame:
    """(source, sid, source_size, target, size, n, rate, copies), written: how many copies the n documents of a size get together."""
    c = counts.alias("c").join(solved.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
    x = F.col("size") / F.col("mean")
    rows = c.select("s.source", "s.sid", "s.source_size", "s.target", "c.size", "c.n", F.when(F.col("c.size") == 0, 1.0).otherwise(rate(F.col("s.lam"), x, cap)).alias("rate"))
    rows = written(rows.withColumn("parts", F.round(F.col("n") * F.col("rate") * PARTS).cast("long")).withColumn("down", -F.col("size")), "mix-rates")
    summed = cumulated(rows, ["sid", "down"], ["parts"], "mix-rounded")
    whole = lambda p: F.shiftright(p + PARTS // 2, 20)
    plan = summed.withColumn("copies", whole(F.col("parts_upto")) - whole(F.col("parts_upto") - F.col("parts")))
    plan = plan.select("source", "sid", "source_size", "target", "size", "n", "rate", "copies")
    short = plan.groupBy("sid").agg((F.round(F.first("target")).cast("long") - F.sum(F.col("copies") * F.col("size"))).alias("short"))
    # a few sizes of each magnitude that still have room, upwards and downwards: at most some hundred rows a source
    open_ = plan.join(short.where("short != 0"), "sid").where("size > 0").withColumns({"up": cap * F.col("n") - F.col("copies"), "step": F.floor(F.log2("size") * 4)})
    best = [F.max(F.when(F.col(c) > 0, F.struct(c, "size")))["size"].alias(f"by_{c}") for c in ("up", "copies")]
    picked = open_.groupBy("sid", "step").agg(*best).select("sid", F.explode(F.array_distinct(F.array("by_up", "by_copies"))).alias("size")).where("size is not null")
    fixes = picked.join(open_.select("sid", "size", "short", "up", "copies"), ["sid", "size"]).groupBy("sid").applyInPandas(settled, "sid long, size long, more long")
    return written(plan.join(fixes, ["sid", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more"), "mix-plan")


def settled(rows: pd.DataFrame) -> pd.DataFrame:
    """(sid, size, more): changes of the copies of a source's sizes that bring the words it is ``short`` of near 0.

    Whole multiples of the longest sizes first, then the best single change or pair of changes, while one helps.
    """
    rows = rows.sort_values("size", ascending=False)
    size, up, down = (rows[c].to_numpy(np.int64) for c in ("size", "up", "copies"))
    more, rest = np.zeros(len(size), np.int64), int(rows["short"].iloc[0])
    for i in range(len(size)):
        times = min(abs(rest) // int(size[i]), int(up[i] if rest > 0 else down[i])) * (1 if rest > 0 else -1)
        more[i] += times
        rest -= times * int(size[i])
    while rest:
        moves = [(i, sign) for sign in (1, -1) for i in np.flatnonzero(more < up if sign > 0 else more > -down)]
        if not moves:
            break
        words = np.array([0] + [sign * int(size[i]) for i, sign in moves])
        left = np.abs(rest - words[:, None] - words)
        np.fill_diagonal(left, np.iinfo(np.int64).max)  # a size may have room for one more copy only
        a, b = np.unravel_index(left.argmin(), left.shape)
        if left[a, b] >= abs(rest):
            break
        for k in (a, b):
            if k:
                more[moves[k - 1][0]] += moves[k - 1][1]
        rest -= int(words[a] + words[b])
    return pd.DataFrame({"sid": rows["sid"].to_numpy(), "size": size, "more": more})


def dealt_copies(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, h, source, size, source_size, target, rate, copies), a row each document: the copies of its (source, size) dealt evenly.

    Odd copies go to the documents of least hash. A size's documents are split by hash into parts of about ``RANKED``;
    each part gets its share of the odd copies by running sums, and ranks its own documents.
    """
    s, p = sizes.alias("s"), plan.alias("p")
    rows = s.join(p, F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.size") == F.col("p.size")))
    rows = rows.select("doc_id", "h", "s.source", "s.size", "p.sid", "p.source_size", "p.target", "p.rate", "p.n", F.expr("p.copies div p.n").alias("each"), (F.col("p.copies") % F.col("p.n")).alias("odd"), F.pmod("h", F.expr(f"p.n div {RANKED} + 1")).alias("salt"))
    held = written(rows.groupBy("sid", "size", "salt", "n", "odd").agg(F.count("*").alias("here")), "mix-salts")
    upto = cumulated(held, ["sid", "size", "salt"], ["here"], "mix-shares")
    share = lambda upto: f"cast({upto} as decimal(19,0)) * cast(odd as decimal(19,0)) div cast(n as decimal(19,0))"
    start = "pmod(here_upto - here, n)"
    quota = upto.select("sid", "size", "salt", (F.expr(share(f"({start} + here)")) - F.expr(share(f"({start})"))).alias("quota"))
    ranked = rows.join(quota, ["sid", "size", "salt"]).withColumn("rank", F.row_number().over(Window.partitionBy("sid", "size", "salt").orderBy("h", "doc_id")))
    copies = F.col("each") + (F.col("rank") <= F.col("quota")).cast("long")
    return ranked.select("doc_id", "h", "source", "size", "source_size", "target", "rate", copies.alias("copies"))


def mix(docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, h, source, size, source_size, target, rate, copies): how often the mix takes each document.

    One row for each row of docs, whose other columns play no part. A null text has no words, null is a source of its
    own, null or repeated ids are rows like others (rows equal in id, source and text are told apart by nothing, so
    which of them gets an odd copy is open, the rows as a whole are not). No document has more than ``cap`` copies; one
    without words keeps about one. An empty table gives no rows.
    """
    sizes = document_sizes(docs, id_col=id_col, source_col=source_col, text_col=text_col)
    counts = written(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counted")
    plan = copy_plan(counts, multipliers(counts, source_targets(counts, weights=weights, cap=cap), cap=cap), cap=cap)
    return dealt_copies(sizes, plan)


def mixed_documents(docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with each row as often as ``mix`` takes it: the mix itself, columns as they were."""
    taken = mix(docs, weights=weights, cap=cap, id_col=id_col, source_col=source_col, text_col=text_col)
    alike = taken.groupBy(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("h").alias("__mix_h")).agg(F.count("*").alias("__mix_n"), F.sum("copies").alias("__mix_copies"))
    same = F.col(id_col).eqNullSafe(F.col("__mix_id")) & F.col(source_col).eqNullSafe(F.col("__mix_source")) & (row_hash(id_col, text_col) == F.col("__mix_h"))
    both = docs.join(alike, same)
    one = both.where("__mix_n = 1").withColumn("__mix_times", F.col("__mix_copies"))
    at = F.row_number().over(Window.partitionBy("__mix_id", "__mix_source", "__mix_h").orderBy(F.lit(1)))
    many = both.where("__mix_n > 1").withColumn("__mix_times", F.expr("__mix_copies div __mix_n") + (at <= F.col("__mix_copies") % F.col("__mix_n")).cast("long"))
    out = one.unionByName(many).where("__mix_times > 0")
    return out.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_times")))).select(*docs.columns)
