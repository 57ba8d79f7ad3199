"""Exact bounded samples and keyed orders: the rows of least keyed hash, found in parts, and places in a permutation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ternfield.operators.positions import numbered
from ternfield.sources.scratch import written

#: A prime; ids below it are permuted without ties, those above share keys and are told apart by id.
PRIME = 2_147_483_647
#: Parts that a class is split into before its own least rows are sought.
PARTS = 64


def keyed(row_id: Column, seed: int) -> Column:
    """A permutation of the ids below ``PRIME``, another for each seed; the same in any engine."""
    once = (F.pmod(row_id, F.lit(PRIME)) * 48_271 + 1_000_003 * (seed + 1)) % PRIME
    return (once * 69_621 + 7_919 * (seed + 1)) % PRIME


def capped_sample(rows: DataFrame, row_id: str, cls: str, *, per_class: int, total: int, seed: int = 0) -> DataFrame:
    """rows of least keyed order: at most ``per_class`` of a class, and of those at most ``total``; ids break ties.

    Both caps are exact. A class is searched in parts, each of which hands on its own least rows, so no class meets in
    one task; what the classes keep is bounded by their number, and of it each task hands on at most ``total``. A null
    class is a class; rows without an id are left out. Other columns stay as they are.
    """
    key, part, at = "__sample_key", "__sample_part", "__sample_at"
    held = rows.where(F.col(row_id).isNotNull()).withColumns({key: keyed(F.col(row_id), seed), part: F.pmod(F.xxhash64(row_id), F.lit(PARTS))})
    first = held.withColumn(at, F.row_number().over(Window.partitionBy(cls, part).orderBy(key, row_id))).where(F.col(at) <= per_class)
    second = first.withColumn(at, F.row_number().over(Window.partitionBy(cls).orderBy(key, row_id))).where(F.col(at) <= per_class)
    return second.orderBy(key, row_id).limit(total).select(*rows.columns)


def cursor(rows: DataFrame, row_id: str, *, seed: int = 0) -> DataFrame:
    """rows with ``place``: each row's number, from 0, in the keyed order of its distinct ids below ``PRIME``.

    Numbers come from running sums over ranges of keys, not from one sort. A learner that takes rows a to b of the
    order, and starts over at its end, reads those whose ``place`` is in that window modulo the number of rows.
    """
    held = written(rows.where(F.col(row_id).isNotNull()).withColumn("__cursor_key", keyed(F.col(row_id), seed)), "cursor")
    return numbered(held, "__cursor_key", name="place").select(*rows.columns, F.col("place").cast("long").alias("place"))


def window(placed: DataFrame, n: int, *, start: int, size: int) -> DataFrame:
    """The rows of a cursor from ``start`` on, ``size`` of them, wrapping round after the n-th."""
    return placed.where(F.pmod(F.col("place") - start, F.lit(n)) < size)
