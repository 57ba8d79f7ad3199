"""Merkle manifest of a table: a tree of digests for each source, a tree over the sources, and proofs for every row.

Leaves of a source are numbered by running sums over ranges, so no source is gathered. A traversal cuts a tree's nodes
into aligned blocks of ``FANOUT`` ^ ``HEIGHT`` and walks each in postorder inside one task: a visit returns its
subtree's digest and, while it unwinds, appends the siblings at that height to the leaves below. The blocks' digests
are the nodes of the next traversal, until each tree has one node; the same walk then goes over the sources' digests.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternfield.llm.common import cumulated, small_batches, written

FANOUT, HEIGHT = 3, 6
BLOCK = FANOUT**HEIGHT
SIDES = "array<struct<left:binary,right:binary>>"


def field(value: Column) -> Column:
    """A value as a part of a leaf: ``-`` if null, else its length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def walk(digests: list[str], block: int, *, alone: bool) -> tuple[str, list[list[tuple[str, str]]]]:
    """(digest, sides by leaf) of one block's nodes: ``sides`` are the siblings left and right, from below.

    ``alone``: the block is a whole tree, which ends at its first single node; else it is as high as all its
    neighbours, ``block`` leaves wide, with runs of one node where it ends early.
    """
    n, sides = len(digests), [[] for _ in digests]

    def visit(lo: int, width: int) -> str:
        if width == 1:
            return digests[lo]
        step = width // FANOUT
        starts = range(lo, min(lo + width, n), step)
        runs = [visit(at, step) for at in starts]
        for i, at in enumerate(starts):
            side = ("".join(runs[:i]), "".join(runs[i + 1 :]))
            for leaf in range(at, min(at + step, n)):
                sides[leaf].append(side)
        return hashlib.sha256("".join(runs).encode()).hexdigest()

    width = block
    if alone:
        width = 1
        while width < n:
            width *= FANOUT
    return visit(0, width), sides


def _traverse(nodes: DataFrame, name: str) -> DataFrame:
    """(tree, at, n, digest, sides, block_digest), written, of nodes (tree, at, n, digest); block_digest on a block's first node."""

    most = BLOCK

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        digest, sides = walk([bytes(d).hex() for d in rows["digest"]], most, alone=int(rows["n"].iloc[0]) <= most)
        out = rows[["tree", "at", "n"]].copy()
        out["sides"] = [[{"left": bytes.fromhex(a), "right": bytes.fromhex(b)} for a, b in s] for s in sides]
        out["block_digest"] = [bytes.fromhex(digest)] + [None] * (len(rows) - 1)
        return out

    dealt = nodes.withColumn("block", F.expr(f"at div {BLOCK}")).groupBy("tree", "block")
    return written(dealt.applyInPandas(block, f"tree long, at long, n long, sides {SIDES}, block_digest binary"), name)


def trees(nodes: DataFrame, most: int, name: str) -> tuple[DataFrame, DataFrame]:
    """((tree, at, sides), (tree, root)) of nodes (tree, at, n, digest): all siblings of a node up to its tree's root.

    ``most``: the size of the largest tree, which tells how many traversals there are.
    """
    passes = []
    while True:
        done = _traverse(nodes, f"{name}-{len(passes)}")
        passes.append(done)
        roots = done.where("block_digest is not null")
        if most <= BLOCK:
            break
        most = -(-most // BLOCK)
        nodes = roots.select("tree", F.expr(f"at div {BLOCK}").alias("at"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("block_digest").alias("digest"))
    sides = passes[-1].select("tree", "at", "sides")
    for below in passes[-2::-1]:
        upper = sides.select("tree", F.col("at").alias("block"), F.col("sides").alias("upper"))
        sides = below.withColumn("block", F.expr(f"at div {BLOCK}")).join(upper, ["tree", "block"]).select("tree", "at", F.concat("sides", "upper").alias("sides"))
    return sides, roots.select("tree", F.col("block_digest").alias("root"))


def manifest(leaves: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, other, subroot, root, sides) of leaves (source, doc_id, leaf, other), with digests as hex.

    In a source, leaves ascend by doc_id, nulls first, those of one id by their digests; sources ascend bytewise, null
    first. ``other`` (null: as leaf) is carried along, for a digest to be held against the proof. ``sides`` are the
    siblings (left, right) of every run up to the root. Rows that are equal stay apart. No leaves, no rows.

    A tree of n nodes is as high as its runs need: only the root of one node is not hashed again.
    """
    small_batches(leaves.sparkSession)
    kept = written(leaves.select("source", "doc_id", F.unhex("leaf").alias("leaf"), F.unhex("other").alias("other"), F.lit(1).cast("long").alias("one")), "merkle-leaves")
    placed = cumulated(kept, ["source", "doc_id", "leaf", "other"], ["one"], "merkle-placed")
    sources = written(placed.groupBy("source").agg(F.count("*").alias("n"), F.min("one_upto").alias("first"), F.lit(1).cast("long").alias("one")), "merkle-sources")
    sources = written(cumulated(sources, ["first"], ["one"], "merkle-order").select("source", "n", "first", (F.col("one_upto") - 1).alias("tree")), "merkle-trees")
    most = sources.agg(F.max("n"), F.count("*")).first()
    rows = placed.alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
    rows = written(rows.select("s.tree", (F.col("p.one_upto") - F.col("s.first")).alias("at"), "s.n", F.col("p.leaf").alias("digest"), "p.source", "p.doc_id", "p.other"), "merkle-rows")
    sides, subroots = trees(rows.select("tree", "at", "n", "digest"), most[0] or 0, "merkle-walk")
    top = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(most[1]).cast("long").alias("n"), F.col("root").alias("digest"))
    above, root = trees(top, most[1], "merkle-top")
    upper = above.select(F.col("at").alias("tree"), F.col("sides").alias("upper")).join(subroots.withColumnRenamed("root", "subroot"), "tree").crossJoin(F.broadcast(root.select("root")))
    out = rows.join(sides, ["tree", "at"]).join(upper, "tree")
    return out.select("source", "doc_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("other")).alias("other"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), F.concat("sides", "upper").alias("sides"))


def proof_digest(sides: Column) -> Column:
    """The digest of all siblings of a proof, from below, left to right."""
    return F.sha2(F.array_join(F.transform(sides, lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), ""), 256)


def folded(leaf: Column, sides: Column) -> Column:
    """The root that a leaf's digest and a proof's siblings give."""
    return F.aggregate(sides, leaf, lambda node, s: F.sha2(F.concat(_hex(s["left"]), node, _hex(s["right"])), 256))


def document_manifest(docs: DataFrame, *, changed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, n_siblings) of docs (doc_id, source, lang, n_chars, text).

    ``changed``: the text to hold against the proofs in place of the stored one (null where that is null); with none,
    every row verifies. Other columns play no part.
    """
    parts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    other = leaf_digest(*parts, changed) if changed is not None else F.lit(None).cast("string")
    m = manifest(docs.select("source", "doc_id", leaf_digest(*parts, F.col("text")).alias("leaf"), other.alias("other")))
    m = m.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("sides")))
    n = F.aggregate("sides", F.lit(0), lambda acc, s: acc + ((F.octet_length(s["left"]) + F.octet_length(s["right"])) / 32).cast("int"))
    return m.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("sides")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), n.cast("long").alias("n_siblings"))
