"""Near-duplicates by ProbMinHash signatures, banding, verification and connected classes.

A document is the weighted set of its five-word shingles (lower-cased words; weight 1 + ln of how often the
shingle occurs; all words are one shingle if there are fewer than five). ProbMinHash lets every shingle send
a Poisson process of arrivals at a rate of its weight, each to a random place of the signature; a place
keeps the shingle that arrives first. A shingle stops once its next arrival is later than every place's
first. Two signatures agree in a place with the probability Jaccard similarity of the weighted sets.

Texts equal in their words are one node; its class is that of the others. Nodes that agree in a whole band
are candidates. A pair is linked if its probability Jaccard similarity, computed on the shingles (32-bit
hashes), is ``similarity`` or more. Classes are the connected components of the links.

Buckets are never expanded into all pairs, nor gathered anywhere. In each round a few leaders of a bucket are
compared with its members; members already in a leader's class need no comparison, since a link would
change no class. A leader leaves the bucket once it has met all others; a bucket is done when its members
are all of one class. So every candidate pair is compared, known to be of one class, or impossible:

A shingle that only one class of the open buckets holds is foreign to all nodes of other classes. Let a node's
foreign weight be r times its other weight. Two nodes of different classes have a probability Jaccard
similarity of at most 1 / (1 + r1 + r2): a term of it is at most f(x, y) = 1 / (1 / x + u / y) for the two
shares x, y of a shingle and the other's foreign share u, and f is concave and homogeneous, so the terms' sum
is at most f of the sums. Nor can the other's shared weight exceed the number of this one's shared shingles
and its own weight in repeats.

Near copies of one text share most shingles and yet lack different ones. Hashes fall into BLOCKS blocks; two nodes share at
most the sum k of the lesser counts of each block, and hold at least the sum of the greater ones together. With e the greater
of their weights in repeats, f as above gives a similarity of at most (k + e) / (m + n - k) for m and n shingles. Nodes
and pairs that these bounds exclude are not compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ternfield.llm.common import free_name, small_batches, written

WORD = re.compile(r"\w+")
SHINGLE, BANDS, ROWS = 5, 20, 6
K = BANDS * ROWS
SIMILARITY = 0.8
#: Leaders of a bucket in the second round (MORE times as many in each after it).
LEADERS, MORE = 4, 8
#: Parts into which a bucket's members are dealt when they meet its leaders.
SALTS = 8
#: Shingles of a node that stay together when they are dealt out.
PART = 8
#: Blocks of hashes in which a node's shingles are counted.
BLOCKS = 128
#: Most words whose hashes a worker keeps.
CACHE_WORDS = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, counts) of a document's word hashes."""
    n = min(SHINGLE, len(ids))
    if not n:
        return ids, np.zeros(0, np.int64)
    h = np.full(len(ids) - n + 1, n, np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - n + 1 + i])
    return np.unique(h, return_counts=True)


def weight(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def signatures(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, k: int = K) -> np.ndarray:
    """[document, place]: the element that arrived first; 0 everywhere for a document without elements.

    All documents of a batch run together: a step is the next arrival of every element still in the race.
    """
    first = np.full(n_docs * k, np.inf)
    who = np.zeros(n_docs * k, np.uint64)
    live, time, step = np.arange(len(elements)), np.zeros(len(elements)), 0
    while len(live):
        x = mix(elements[live] + np.uint64((step * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))
        time[live] += -np.log1p(-(x >> np.uint64(11)).astype(np.float64) * 2.0**-53) / weights[live]
        slot = doc[live] * k + (mix(x ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(k)).astype(np.int64)
        t = time[live]
        np.minimum.at(first, slot, t)
        won = first[slot] == t
        who[slot[won]] = elements[live][won]
        last = first.reshape(n_docs, k).max(1)
        live = live[t < last[doc[live]]]
        step += 1
    return who.reshape(n_docs, k)


def bands(signature: np.ndarray) -> np.ndarray:
    """[document, band] hashes of the signature's bands."""
    h = np.zeros((len(signature), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + signature[:, i::ROWS][:, :BANDS])
    return h.astype(np.int64)


def similarity_of(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard similarity of two sorted sets with weights."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = wa[i], wb[j]
    rest_a, rest_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio = x / y
    total = 0.0
    for t in np.unique(ratio):
        of = ratio == t
        total += x[of].sum() / (np.maximum(x, t * y).sum() + rest_a + t * rest_b)
    return float(total)


NODES_SQL = "th bigint, key binary, words bigint, bands array<bigint>, shingles array<int>, counts array<int>"


def nodes(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, key, words, bands, shingles, counts): th is the text's hash, key stands for its words."""
    small_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            keys, sizes, sets, counts = [], [], [], []
            if len(known) > CACHE_WORDS:
                known.clear()
            for text in b.column("text").to_pylist():
                words = WORD.findall(text.lower()) if text else []
                ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                keys.append(xxhash.xxh3_128_digest(ids.tobytes()))
                sizes.append(len(words))
                s, c = shingles(ids)
                sets.append(s)
                counts.append(c)
            lengths = np.array([len(s) for s in sets])
            cut = np.concatenate([[0], np.cumsum(lengths)])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            times = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            sig = signatures(flat, weight(times), np.repeat(np.arange(len(sets)), lengths), len(sets))
            low = (flat >> np.uint64(32)).astype(np.uint32).view(np.int32)
            lists = lambda values: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values, pa.int32()))
            band = [x if n else [] for x, n in zip(bands(sig).tolist(), sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("th"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(band, pa.list_(pa.int64())), lists(low), lists(times)], ["doc", "th", "key", "words", "bands", "shingles", "counts"])

    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    return texts.mapInArrow(each, f"doc {docs.schema[id_col].dataType.simpleString()}, {NODES_SQL}")


def verify(pairs: DataFrame, sets: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) that are linked."""
    small_batches(pairs.sparkSession)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = {}
            for c in ("ha", "ca", "hb", "cb"):
                col = b.column(c)
                part[c] = (col.flatten().to_numpy(zero_copy_only=False), col.offsets.to_numpy())
            ok = np.zeros(len(b), bool)
            for i in range(len(b)):
                cut = {c: v[o[i] - o[0] : o[i + 1] - o[0]] for c, (v, o) in part.items()}
                sides = []
                for h, n in (("ha", "ca"), ("hb", "cb")):
                    order = np.argsort(cut[h], kind="stable")
                    s, at = np.unique(cut[h][order], return_index=True)
                    sides += [s, weight(cut[n][order][at])]
                ok[i] = similarity_of(*sides) >= similarity - 1e-12
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok))

    side = lambda n, *cols: sets.select(F.col("node").alias(n), *(F.col(c).alias(x) for c, x in cols))
    both = pairs.join(side("a", ("shingles", "ha"), ("counts", "ca")), "a").join(side("b", ("shingles", "hb"), ("counts", "cb")), "b")
    return both.mapInArrow(linked, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node in edges (a, b): root is the least node that it is connected with.

    Large-star and small-star steps: every node points at smaller ones until all point at their least. Each
    step is written to the shared folder; the number of steps grows with the logarithm of the longest chain.
    The loop ends with a step that leaves as many rows with the same sums of hashes as the one before.
    """

    def step(df: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        mark = F.xxhash64("v", "u")
        out = written(df.observe(seen, F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 16)).alias("s")), "links")
        return out, seen.get

    links, was = step(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v != u").distinct())
    while was["n"]:
        both = links.unionAll(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v != u")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").where("v != u").distinct()
        links, now = step(small)
        if now == was:
            break
        was = now
    return links.select(F.col("v").alias("node"), F.col("u").alias("root"))


def in_parts(sets: DataFrame) -> DataFrame:
    """(node, root, part, e): the shingles h of each node and their counts c, PART at a time."""
    n, part = F.size("shingles"), F.lit(PART)
    cut = lambda c, p: F.slice(c, p * part + 1, part)
    each = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / part).cast("int")), lambda p: F.struct(p.alias("part"), F.arrays_zip(cut("shingles", p).alias("h"), cut("counts", p).alias("c")).alias("e")))
    return sets.where(n > 0).select("node", "root", F.inline(each))


def measures(sets: DataFrame) -> DataFrame:
    """(node, n, w, m, blocks): shingles, their weight, how many of their hashes differ, and how many of these each block has."""
    small_batches(sets.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.diff(b.column("shingles").offsets.to_numpy()).astype(np.int64)
            row = np.repeat(np.arange(len(b)), n)
            h, c = (b.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("shingles", "counts"))
            w = np.bincount(row, weight(c), len(b))
            own = np.unique(row << 32 | h.view(np.uint32))
            blocks = np.bincount((own >> 32) * BLOCKS + own % BLOCKS, minlength=len(b) * BLOCKS)
            m = blocks.reshape(-1, BLOCKS).sum(1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * BLOCKS, pa.int32()), pa.array(blocks, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(n), pa.array(w), pa.array(m), lists], ["node", "n", "w", "m", "blocks"])

    return sets.select("node", "shingles", "counts").mapInArrow(each, "node bigint, n bigint, w double, m bigint, blocks array<int>")


def bounds(of: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, n, w, m, blocks, s, r) of the nodes in ``of`` (node, root) that share a shingle with another class there: their
    measures, how many of their shingles other classes hold too, and the weight of the rest over that of those.

    Each shingle of a node is taken apart and written once. Classes are joined to parts, and parts dealt out evenly, before
    that. The rest is what is counted: a shingle that one node holds is known by its group, and only those that several nodes
    of one class hold are looked up again."""
    mine = sets.join(of, "node")
    dealt = in_parts(mine).repartition("node", "part").select("node", "root", F.inline("e"))
    now = written(dealt.select("node", "root", "h", (1 + F.log("c")).alias("x")), "shingles")
    ends = [f(c).alias(f"{c}{i}") for c in ("root", "node") for i, f in enumerate((F.min, F.max))]
    foreign = written(now.groupBy("h").agg(*ends, F.count("*").alias("k"), F.sum("x").alias("x")).where("root0 = root1"), "foreign")
    own = foreign.where("node0 = node1").select(F.col("node0").alias("node"), "k", "x")
    wide = now.join(foreign.where("node0 != node1").select("h"), "h").select("node", F.lit(1).cast("bigint").alias("k"), "x")
    rest = own.unionAll(wide).groupBy("node").agg(F.sum("k").alias("k"), F.sum("x").alias("x"))
    whole = measures(mine).join(rest, "node", "left")
    shared, x = F.col("n") - F.coalesce("k", F.lit(0)), F.coalesce("x", F.lit(0.0))
    return whole.where(shared > 0).select("node", "n", "w", "m", "blocks", shared.alias("s"), (x / (F.col("w") - x)).alias("r"))


def link_classes(buckets: DataFrame, sets: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of the nodes that have links. buckets: (bucket, node, lead); sets: (node, shingles, counts).

    Bounds are taken once, with the classes of the first round: classes only grow, so what was foreign stays foreign."""
    spare, slip = 1 / similarity - 1, 1e-9
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first = buckets.where("node != lead")
    links = written(verify(first.select(*pair("node", "lead")).distinct(), sets, similarity=similarity), "links")
    roots = components(links)
    named = first.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = named.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1")
    todo = written(named.join(open_.select("bucket"), "bucket"), "open")
    if todo.isEmpty():
        return roots
    told = ["n", "w", "m", "blocks", "s", "q"]
    # A node stays if some weight and number of shingles in its bucket could be a partner's.
    bound = bounds(todo.select("node", "root").distinct(), sets).withColumn("q", spare - F.col("r")).where(F.col("q") >= -slip).drop("r")
    at = written(todo.select("bucket", "node").join(bound, "node"), "bounds")
    most = at.groupBy("bucket").agg(F.min("n").alias("n0"), F.max("w").alias("w1"))
    todo = at.join(most, "bucket").where(F.col("w1") * F.col("q") / (1 + F.col("q")) >= F.col("n0") - F.col("s") - slip).select("bucket", "node", *told)
    leaders, rank = LEADERS, 2
    while True:
        named = todo.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        of_root = named.groupBy("bucket", "root").agg(F.count("*").alias("members"))
        main = of_root.groupBy("bucket").agg(F.max(F.struct("members", "root"))["root"].alias("main"), F.count("*").alias("classes")).where("classes > 1")
        todo = written(named.join(main.select("bucket", "main"), "bucket"), "open")
        if todo.isEmpty():
            return roots
        ranked = todo.where((F.col("root") != F.col("main")) | F.lit(rank == 2))
        place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("q"), "node"))
        lead = written(ranked.withColumn("place", place).where(F.col("place") <= leaders).select("bucket", *(F.col(c).alias(f"l_{c}") for c in ("node", "root", *told))), "leaders")
        dealt = lead.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        fits = lambda q, s, w, n: F.col(w) * F.col(q) / (1 + F.col(q)) >= F.col(n) - F.col(s) - slip
        able = (F.col("q") + F.col("l_q") >= spare - slip) & fits("q", "s", "l_w", "l_n") & fits("l_q", "l_s", "w", "n")
        both = F.aggregate(F.zip_with("blocks", "l_blocks", lambda x, y: F.least(x, y)), F.lit(0), lambda a, k: a + k)
        repeats = F.greatest(F.col("w") - F.col("n"), F.col("l_w") - F.col("l_n"))
        able &= (1 + similarity) * both >= similarity * (F.col("m") + F.col("l_m")) - repeats - slip
        met = todo.withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int")).join(dealt, ["bucket", "salt"]).where("root != l_root").where(able)
        new = written(verify(met.select(*pair("node", "l_node")).distinct(), sets, similarity=similarity), "links")
        todo = todo.select("bucket", "node", *told).join(lead.select("bucket", F.col("l_node").alias("node")), ["bucket", "node"], "left_anti")
        if not new.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(new))
        leaders, rank = leaders * MORE, rank + 1


def row_classes(docs: DataFrame, *, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(doc, th, root) for each row of docs; root is null for those without words."""
    all_nodes = written(nodes(docs, id_col=id_col, text_col=text_col), "nodes")
    named = all_nodes.where("words > 0")
    keys = written(named.groupBy("key").agg(F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()), "keys")
    met = keys.select("node", F.posexplode("bands").alias("band", "h")).select("node", F.xxhash64("band", "h").alias("bucket"))
    sizes = met.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead != last").select("bucket", "lead")
    buckets = written(met.join(sizes, "bucket").select("bucket", "node", "lead"), "buckets")
    wanted = keys.select("key", "node").join(buckets.select("node").distinct(), "node")
    sets = written(named.select("key", "shingles", "counts").join(wanted, "key").groupBy("node").agg(*(F.first(c).alias(c) for c in ("shingles", "counts"))), "sets")
    roots = link_classes(buckets, sets, similarity=similarity)
    of = all_nodes.select("doc", "th", F.when(F.col("words") > 0, F.col("key")).alias("key")).join(keys.select("key", "node"), "key", "left")
    return of.join(roots, "node", "left").select("doc", "th", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, class_size): one row for each row of docs; class_id is the class's least id.

    Texts with equal words are of one class. Null and empty texts, and those without words, are alone. Rows
    that repeat an id each get a row, by their own text. Null ids rank after all others; a class of null ids has a
    null class_id. An empty table gives no rows; other columns are not read.
    """
    of = row_classes(docs, id_col=id_col, text_col=text_col, similarity=similarity)
    classes = of.where("root is not null").groupBy("root").agg(F.min("doc").alias("class_id"), F.count("*").alias("class_size"))
    alone = F.col("root").isNull()
    found = of.join(classes, "root", "left").select(F.col("doc").alias(id_col), F.when(alone, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))
    return found


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class; columns as they were.

    The row of the least id stays, of several texts with that id the one of least hash; null ids come last. Of
    rows that repeat both id and text one stays, any of them. Rows without words all stay, each being alone.
    """
    of = written(row_classes(docs, id_col=id_col, text_col=text_col, similarity=similarity).where("root is not null"), "classes")
    row = F.struct(F.col("doc").isNull().alias("last"), "doc", "th")
    first = of.groupBy("root").agg(F.min(row).alias("row"))
    marked = of.groupBy("root", "doc", "th").agg(F.count("*").alias("times")).join(first, "root").select("doc", "th", "times", (row != F.col("row")).alias("gone"))
    by_id, by_hash = free_name("__near_id", docs.columns), free_name("__near_hash", docs.columns)
    marked = written(marked.where("gone or times > 1").select(F.col("doc").alias(by_id), F.col("th").alias(by_hash), F.col("gone").alias("__near_gone")), "marked")
    at = F.col(id_col).eqNullSafe(F.col(by_id)) & (F.xxhash64(text_col) == F.col(by_hash))
    kept = docs.join(marked.drop("__near_gone"), at, "left_anti")
    again = marked.where("not __near_gone").drop("__near_gone")
    if again.isEmpty():
        return kept
    return kept.unionAll(docs.join(again, at, "left_semi").dropDuplicates([id_col, text_col]))
