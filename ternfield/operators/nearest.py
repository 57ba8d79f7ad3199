"""Exact nearest neighbours of stated queries among all rows, by Hamming distance of packed bits: by blocks, or by an index of bands."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ternfield.sources.scratch import written

#: Rows that a task compares with all queries of a block at once.
ROWS_AT_ONCE = 256


def packed(idx: Column, dim: int) -> Column:
    """Feature ids as an array of 64-bit words."""
    word = lambda w: F.aggregate(F.filter(idx, lambda i: F.floor(i / 64) == w), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))))
    return F.transform(F.sequence(F.lit(0), F.lit((dim - 1) // 64)), word)


def nearest(rows: DataFrame, queries: DataFrame, *, k: int, block: int = 16_384) -> DataFrame:
    """(q, t, dist, r): the k nearest rows (id, words) of each query (id, words), ranked by distance and then id; not the query itself.

    Queries go out in blocks of at most ``block``, so what a task holds is bounded; each block passes over all rows
    once, and each task hands on only its own k best of each query. No pair of row and query is ever a Spark row.
    """
    places = queries.where(F.col("id").isNotNull()).select("id", "words")
    n = places.count()
    parts = max(1, -(-n // block))
    found = None
    for part in range(parts):
        mine = places if parts == 1 else places.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        got = [(r["id"], r["words"]) for r in mine.collect()]  # about block rows
        out = _block(rows, got, k)
        found = out if found is None else found.unionAll(out)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("dist", "t"))
    return found.withColumn("r", rank).where(F.col("r") <= k)


def _block(rows: DataFrame, queries: list[tuple[int, list[int]]], k: int) -> DataFrame:
    if not queries:
        return rows.sparkSession.createDataFrame([], "q bigint, t bigint, dist int")
    ids = np.array([i for i, _ in queries], np.int64)
    words = np.array([w for _, w in queries], np.int64).reshape(len(queries), -1).view(np.uint64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), k), np.iinfo(np.int64).max)  # distance in the high bits, then the row's place
        ts = np.full((len(ids), k), np.iinfo(np.int64).max)
        far = np.iinfo(np.int64).max
        for b in batches:
            t_ids = b.column("id").to_numpy(zero_copy_only=False)
            t_words = np.array(b.column("words").to_pylist(), np.int64).reshape(len(b), -1).view(np.uint64)
            for at in range(0, len(b), ROWS_AT_ONCE):
                t = t_ids[at : at + ROWS_AT_ONCE]
                dist = sum(np.bitwise_count(words[:, w, None] ^ t_words[None, at : at + ROWS_AT_ONCE, w]).astype(np.int64) for w in range(words.shape[1]))
                dist[ids[:, None] == t[None]] = far
                both, named = np.hstack([best, dist]), np.hstack([ts, np.broadcast_to(t, dist.shape)])
                order = np.lexsort((named, both), axis=1)[:, :k]
                best, ts = np.take_along_axis(both, order, 1), np.take_along_axis(named, order, 1)
        ok = best < far
        q = np.broadcast_to(ids[:, None], best.shape)
        yield pa.RecordBatch.from_arrays([pa.array(q[ok], pa.int64()), pa.array(ts[ok], pa.int64()), pa.array(best[ok].astype(np.int32))], ["q", "t", "dist"])

    return rows.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), "words").mapInArrow(each, "q bigint, t bigint, dist int")


def banded(rows: DataFrame, dim: int, bands: int) -> DataFrame:
    """(id, words, keys): the bits of each row in ``bands`` bands of equal width, which divides 64."""
    width = dim // bands
    if width * bands != dim or 64 % width or width == 64:
        raise ValueError(f"{dim} bits do not fall into {bands} bands of a width that divides 64")
    key = lambda b: F.shiftrightunsigned(F.get("words", b * width // 64), b * width % 64).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
    return rows.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), "words", F.array(*[key(b) for b in range(bands)]).alias("keys"))


def candidates(rows: DataFrame, queries: DataFrame, *, dim: int, bands: int, reach: int, share: float) -> tuple[DataFrame, DataFrame]:
    """(q, t, dist) of the pairs that agree in some band but for ``reach`` bits at most, each pair once, and the ids of the queries
    left out, as those bands together hold more than ``share`` times the number of rows (so no large bucket is joined with its queries)."""
    width = dim // bands
    masks = [sum(1 << i for i in c) for n in range(reach + 1) for c in combinations(range(width), n)]
    near = lambda keys: F.flatten(F.transform(keys, lambda x, b: F.transform(F.array(*map(F.lit, masks)), lambda m: F.struct(b.alias("band"), x.bitwiseXOR(m).alias("key")))))
    all_rows, asked = banded(rows, dim, bands), banded(queries, dim, bands)
    at = all_rows.select("id", "words", "keys", F.posexplode("keys").alias("band", "key"))
    probes = asked.select(F.col("id").alias("q"), F.inline(near("keys")))
    size = at.groupBy("band", "key").agg(F.count("*").alias("n"))
    most = all_rows.agg((F.count("*") * F.lit(share)).alias("most"))
    cost = written(probes.join(size, ["band", "key"]).groupBy("q").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(most)).select("q", (F.col("n") > F.col("most")).alias("left")), "cost")
    able = asked.join(cost.where("not left").select(F.col("q").alias("id")), "id").select(F.col("id").alias("q"), F.col("words").alias("q_words"), F.col("keys").alias("q_keys"))
    probes = able.select("*", F.inline(near("q_keys")))
    apart = F.zip_with("keys", "q_keys", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    first = F.size(F.filter(F.slice(apart, 1, F.col("band")), lambda n: n <= reach)) == 0  # else an earlier band gives the pair
    dist = F.aggregate(F.zip_with("words", "q_words", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)
    met = probes.join(at, ["band", "key"]).where((F.col("id") != F.col("q")) & first).select("q", F.col("id").alias("t"), dist.alias("dist"))
    return met, cost.where("left").select("q")


def nearest_by_bands(rows: DataFrame, queries: DataFrame, *, k: int, dim: int, bands: int = 4, reach: int = 1, share: float = 0.02, block: int = 16_384) -> DataFrame:
    """As ``nearest``, through an index: what is within bands * (reach + 1) - 1 bits agrees in some band but for ``reach`` bits.

    A query whose k-th candidate is that near is settled, as no row outside its candidates can be nearer. The others, those
    with fewer candidates and those whose buckets together hold over ``share`` times the number of rows go the exact way, by blocks. Rows and queries that
    repeat an id are not told apart; null ids are left out; without rows or queries there are no pairs.
    """
    met, _ = candidates(rows, queries, dim=dim, bands=bands, reach=reach, share=share)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("dist", "t"))
    best = written(met.withColumn("r", rank).where(F.col("r") <= k), "nearest")
    settled = best.where((F.col("r") == k) & (F.col("dist") < bands * (reach + 1))).select("q")
    rest = queries.join(settled.select(F.col("q").alias("id")), "id", "left_anti")
    return best.join(settled, "q", "left_semi").select("q", "t", "dist", "r").unionByName(nearest(rows, rest, k=k, block=block))


def local_scale(rows: DataFrame, queries: DataFrame, *, scale_at: int = 7, block: int = 16_384, side: int = 1024) -> DataFrame:
    """(q, t, k): dist * s(q) * s(t) for all pairs of two queries q and t, s being a query's ``scale_at``-th least distance
    to any row; queries without one are left out.

    The result is quadratic in the queries. They are dealt into blocks of about ``side``, and blocks into pairs of blocks, by which
    the work is spread; a task holds one pair of blocks and hands on the cells of ``ROWS_AT_ONCE`` rows of it at a time.
    """
    scale = nearest(rows, queries, k=scale_at, block=block).where(F.col("r") == scale_at).select(F.col("q").alias("id"), F.col("dist").cast("long").alias("s"))
    mine = written(queries.select(F.col("id").cast("long").alias("id"), "words").join(scale, "id"), "scaled")
    parts = max(1, -(-mine.count() // side))
    blocks = mine.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("a")).agg(*[F.collect_list(F.struct("id", "s", "words")).alias("qs")])
    blocks = written(blocks, "blocks")
    met = blocks.crossJoin(blocks.select(F.col("a").alias("b"), F.col("qs").alias("ts"))).repartition(min(parts * parts, 4096), "a", "b")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                sides = []
                for c in ("qs", "ts"):
                    cells = b.column(c).slice(i, 1).flatten()
                    ids, s = (cells.field(x).to_numpy(zero_copy_only=False) for x in ("id", "s"))
                    sides.append((ids, s, cells.field("words").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).view(np.uint64)))
                (q, qs, qw), (t, ts, tw) = sides
                for at in range(0, len(q), ROWS_AT_ONCE):
                    now = slice(at, at + ROWS_AT_ONCE)
                    dist = sum(np.bitwise_count(qw[now, w, None] ^ tw[None, :, w]).astype(np.int64) for w in range(qw.shape[1]))
                    other = q[now, None] != t[None]
                    pair = [np.broadcast_to(x, other.shape)[other] for x in (q[now, None], t[None], dist * qs[now, None] * ts[None])]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pair], ["q", "t", "k"])

    return met.mapInArrow(each, "q bigint, t bigint, k bigint")
