"""Prefix trie of conversations, as a table of nodes numbered in preorder.

A node is a sequence of first turns. A conversation's prefixes are told apart by two running xors of hashes of
(place, turn), which split at any place, so a long conversation is worked on in blocks. Distinct conversations are
ranked in lexicographic order: turns are digests of fixed width, ``NAMED`` of them side by side sort as the turns do,
and longer conversations are named in rounds, each of which turns ``NAMED`` ranks into one. The nodes, in the order of
their first conversation's rank and then their depth, are in preorder, and a subtree ends where its last
conversation's nodes end. Leaves and savings of a subtree are differences of running sums over that order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ternfield.llm.common import cumulated, shuffle_partitions, small_batches, words, written

#: Turns, then ranks, that one name holds; turns of a conversation that are hashed in one run; ids joined in one row.
NAMED, RUN, JOINED = 16, 1024, 1024


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, token, words), written: every conversation's turns by place from 0.

    Turns ascend by ``turn``, null first, those of one number by role and a digest of the text. A null role or text is
    an empty one. Rows without a conv_id belong to no conversation and are left out. Other columns play no part.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    token = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), token.alias("token"), words(text).alias("words"), F.lit(1).cast("long").alias("one"))
    placed = cumulated(written(rows, "trie-turns"), ["conv_id", "turn", "role", "token"], ["one"], "trie-placed")
    first = placed.groupBy("conv_id").agg(F.min("one_upto").alias("first"))
    return written(placed.join(first, "conv_id").select("conv_id", (F.col("one_upto") - F.col("first")).alias("i"), "token", "words"), "trie-own")


def rebuilt(own: DataFrame, *, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """((conv_id, i, token, words), (conv_id, len)), written: conversations whose heads come from their group's first one.

    Of conversation c, the first h = crc32(c) mod ``most`` turns are those of conversation c - c mod ``group`` (all if
    it has fewer, none if there is no such one), followed by c's own turns after its first h.
    """
    sizes = written(own.groupBy("conv_id").agg(F.count("*").alias("n")), "trie-sizes")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h"), "n")
    lent = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(lent, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))
    convs = written(convs.select("conv_id", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))).alias("len")), "trie-convs")
    heads = own.where(F.col("i") < most - 1).select(F.col("conv_id").alias("base"), "i", "token", "words")
    taken = convs.where("lent > 0").select("conv_id", "base", "lent").join(heads, "base").where("i < lent").select("conv_id", "i", "token", "words")
    rest = own.join(convs.select("conv_id", "h", "lent"), "conv_id").where("i >= h").select("conv_id", (F.col("i") - F.col("h") + F.col("lent")).alias("i"), "token", "words")
    return written(taken.unionByName(rest), "trie-rebuilt"), convs.select("conv_id", "len")


def lexicographic_ranks(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, rank), written: the place of each conversation among the distinct ones, a prefix before what continues it."""
    names = rows.select("conv_id", "i", F.hex("token").alias("name"))
    longest = convs.agg(F.max("len")).first()[0] or 0
    while True:
        block = F.expr(f"i div {NAMED}")
        joined = names.groupBy("conv_id", block.alias("i")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]), "").alias("name"))
        longest = -(-longest // NAMED)
        if longest <= 1:
            empty = convs.where("len = 0").select("conv_id", F.lit(0).cast("long").alias("i"), F.lit("").alias("name"))
            joined = joined.unionByName(empty)
        joined = written(joined, "trie-names")
        distinct = written(joined.select("name").distinct().withColumn("one", F.lit(1).cast("long")), "trie-distinct")
        ranks = cumulated(distinct, ["name"], ["one"], "trie-ranks").select("name", F.col("one_upto").alias("rank"))
        ranked = joined.join(ranks, "name").select("conv_id", "i", "rank")
        if longest <= 1:
            return written(ranked.select("conv_id", "rank"), "trie-ranked")
        names = written(ranked.select("conv_id", "i", F.lpad(F.hex("rank"), 16, "0").alias("name")), "trie-named")


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words): every prefix of every conversation, its key and the key without its last turn."""
    hashed = rows.select("conv_id", "i", "words", *[F.xxhash64(F.lit(s), F.col("i"), F.col("token")).alias(f"h{s}") for s in (1, 2)], F.expr(f"i div {RUN}").alias("run"))
    inside = Window.partitionBy("conv_id", "run").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    here = hashed.withColumns({f"x{s}": F.bit_xor(f"h{s}").over(inside) for s in (1, 2)})
    # runs before this one matter in long conversations only
    long = convs.where(F.col("len") > RUN).select("conv_id")
    sums = hashed.join(long, "conv_id", "left_semi").groupBy("conv_id", "run").agg(*[F.bit_xor(f"h{s}").alias(f"t{s}") for s in (1, 2)])
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("conv_id", "run", *[F.bit_xor(f"t{s}").over(before).alias(f"b{s}") for s in (1, 2)])
    zero = F.lit(0).cast("long")
    keyed = here.join(bases, ["conv_id", "run"], "left").withColumns({f"k{s}": F.col(f"x{s}").bitwiseXOR(F.coalesce(f"b{s}", zero)) for s in (1, 2)})
    keyed = keyed.select("conv_id", (F.col("i") + 1).alias("depth"), "k1", "k2", *[F.col(f"k{s}").bitwiseXOR(F.col(f"h{s}")).alias(f"p{s}") for s in (1, 2)], "words")
    roots = convs.select("conv_id", *[zero.alias(c) for c in ("depth", "k1", "k2", "p1", "p2", "words")])
    return keyed.unionByName(roots)


def joined_ids_digest(ends: DataFrame, key: list[str]) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): the digest of each key's ids, ascending, comma-joined.

    Ids are joined by ranges of ``JOINED`` ids; a task then hashes the ranges of its keys as they stream by, in order,
    so the ids of one key never meet.
    """
    small_batches(ends.sparkSession)
    chunks = ends.groupBy(*key, F.shiftright("conv_id", JOINED.bit_length() - 1).alias("range")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    dealt = chunks.repartition(shuffle_partitions(ends.sparkSession), *key).sortWithinPartitions(*key, "range")
    names = [*key, "ends_sha256"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            out = []
            for *k, ids in zip(*[b.column(c).to_pylist() for c in [*key, "ids"]], strict=True):
                if k == at:
                    state.update(b",")
                else:
                    if at is not None:
                        out.append([*at, state.hexdigest()])
                    at, state = k, hashlib.sha256()
                state.update(ids.encode())
            yield packed(out)
        if at is not None:
            yield packed([[*at, state.hexdigest()]])

    def packed(out: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64()] * len(key) + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], names=names)

    return dealt.mapInArrow(hashed, ", ".join([f"{c} long" for c in key] + ["ends_sha256 string"]))


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, i, token, words) and (conv_id, len), turnless ones included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder, subtree_end):
    the smallest conversation that starts with the node's turns and its parent's, how many do, children, childless
    nodes below (itself, if it has none), words read once in place of n_convs times over the subtree, the digest of
    the conversations that end here, the node's number in preorder and that after its subtree's last. Without
    conversations there is no node.
    """
    key = ["depth", "k1", "k2"]
    every = written(prefixes(rows, convs).join(lexicographic_ranks(rows, convs), "conv_id"), "trie-prefixes")
    low = [F.min(c).alias(c) for c in ("conv_id", "p1", "p2", "words")]
    nodes = written(every.groupBy(*key).agg(F.count("*").alias("n_convs"), *low, F.min("rank").alias("first"), F.max("rank").alias("last")), "trie-nodes")
    over = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = nodes.where("depth > 0").select(*over).groupBy(*key).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(children, key, "left").join(parents, ["depth", "p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    full = full.select(*key, "conv_id", "parent_conv_id", "n_convs", "n_children", "first", "last", F.lit(1).cast("long").alias("one"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    sums = ["one", "leaf", "saved"]
    placed = cumulated(written(full, "trie-full"), ["first", "depth"], sums, "trie-preorder")
    stops = placed.groupBy(F.col("first").alias("last")).agg(*[F.max(f"{v}_upto").alias(f"{v}_end") for v in sums])
    ends = every.join(convs, "conv_id").where("depth = len").select(*key, "conv_id")
    out = placed.join(stops, "last").join(joined_ids_digest(ends, key), key, "left")
    under = lambda v: F.col(f"{v}_end") - F.col(f"{v}_upto") + F.col(v)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", under("leaf").alias("n_leaves"), under("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), (F.col("one_upto") - 1).alias("preorder"), F.col("one_end").alias("subtree_end"))
