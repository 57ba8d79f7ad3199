"""Running sums and row numbers over a whole table in the order of a key, without gathering it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most keys of the sample that sets the blocks.
SAMPLE = 4096


def running(df: DataFrame, key: str, values: Sequence[str], *, descending: bool = False, blocks: int | None = None) -> DataFrame:
    """df with ``<value>_upto`` for each value: the sum over all rows up to this one in the order of the key, this one included.

    Keys must be distinct; a null key ranks first (last when descending). Blocks of neighbouring keys, as many as
    shuffle partitions unless told, are cut at the quantiles of a bounded sample of keys; each is summed apart, one
    row a block meets in a window, and rows are summed inside their block.
    """
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = [r[0] for r in df.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(SAMPLE).collect()]
    sample.sort()
    cuts = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
    bounds = F.array(*[F.lit(c) for c in cuts]).cast(f"array<{df.schema[key].dataType.simpleString()}>")
    block = F.coalesce(F.size(F.filter(bounds, lambda c: c <= F.col(key))), F.lit(0)) if cuts else F.lit(0)
    rows = df.withColumn("__block", -block if descending else block)
    totals = rows.groupBy("__block").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__block", *[F.coalesce(F.sum(f"__{v}").over(before), F.lit(0)).alias(f"__{v}") for v in values])
    inside = Window.partitionBy("__block").orderBy(F.col(key).desc() if descending else F.col(key).asc()).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(bases), "__block")
    return out.withColumns({f"{v}_upto": F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"__{v}") for v in values}).drop("__block", *[f"__{v}" for v in values])


def numbered(df: DataFrame, key: str, *, name: str = "row") -> DataFrame:
    """df with the row's number in the order of the key, from 0; keys must be distinct."""
    return running(df.withColumn("__one", F.lit(1).cast("long")), key, ["__one"]).withColumn(name, F.col("__one_upto") - 1).drop("__one", "__one_upto")


def zipped(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """(row, …): the rows of two tables side by side, each in the order of its key; the longer one's rest goes."""
    return numbered(left, left_key).join(numbered(right, right_key), "row")
