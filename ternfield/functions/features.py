"""Expressions over feature arrays and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def set_bits(values: Column) -> Column:
    """Ids of the positive entries, from 0, ascending."""
    marked = F.transform(values, lambda v, i: F.when(v > 0, i))
    return F.filter(marked, lambda i: i.isNotNull())


def soft_bits(values: Column, base: int, scale: float = 1) -> Column:
    """(idx, val) of the entries whose fixed-point value is above 0."""
    cells = F.transform(values, lambda v, i: F.struct(i.alias("idx"), F.least(F.lit(base), F.floor(F.greatest(v.cast("double"), F.lit(0.0)) * scale * base)).cast("int").alias("val")))
    return F.filter(cells, lambda c: c["val"] > 0)


def with_bias(ids: Column, dim: int) -> Column:
    return F.array_append(ids, F.lit(dim))


def clamp(p: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(p, F.lit(high)), F.lit(low))


def path_id(path: Column, suffix: str) -> Column:
    """The last three parts of a path, joined by _, without the suffix."""
    return F.regexp_replace(F.array_join(F.slice(F.split(path, "/"), -3, 3), "_"), suffix + "$", "")


def mirrored(i: Column, n: Column) -> Column:
    """An index beyond either end, reflected at that end."""
    return F.when(i < 0, -i).when(i > n - 1, 2 * n - 2 - i).otherwise(i)
