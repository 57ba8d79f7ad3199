"""Line dedup: of a line that several documents hold, only the first document keeps it.

All work is DataFrame expressions. Lines travel as 128-bit hashes with (document, position). A range
partitioning on the hash with a secondary sort on document and position lets a window stream the first
holder of each hash. A very frequent line must not end in one task, so this is done twice: first within
(hash, salt of the document), which spreads any line over all partitions and settles every row but the
first document of each salt; then, for those few first documents, within the hash alone.

What comes back is not text but a bitmap for each document: 64-line words, stored only where a line goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ternfield.llm.common import shuffle_partitions

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def text_key(text: Column) -> Column:
    """Tells apart the texts of rows that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc_id, text_key, drops): for each document that loses lines, the words of its bitmap.

    ``drops`` is an array of (word, bits), ordered by word: bit i of a word is set if line 64*word+i goes.
    Words without a drop are left out, and so are documents that keep every line.

    A line goes if its key has ``min_chars`` code points or more and a document with a smaller id holds the
    key too. Repeated lines within the first holder all stay. Rows that repeat an id are one document for
    this test; each distinct text under that id gets its own bitmap. A null id ranks after all others.
    Null or empty texts have one empty line, which never goes. An empty table gives no rows.
    """
    n = shuffle_partitions(docs.sparkSession)
    lines = docs.select(F.col(id_col).alias("doc"), text_key(F.col(text_col)).alias("tk"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    keys = (
        lines.select("doc", "tk", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), F.pmod(F.xxhash64("doc"), F.lit(n)).cast("int").alias("salt"), "doc", "tk", "pos")
    )
    order = [F.col("doc").asc_nulls_last(), F.col("pos").asc()]
    dealt = keys.repartitionByRange(n, "h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", *order)
    near = dealt.withColumn("first", F.first("doc").over(Window.partitionBy("h1", "h2", "salt").orderBy(*order)))
    ahead = near.where(~F.col("doc").eqNullSafe(F.col("first"))).select("doc", "tk", "pos")
    heads = near.where(F.col("doc").eqNullSafe(F.col("first"))).select("h1", "h2", "doc", "tk", "pos")
    heads = heads.repartitionByRange(n, "h1", "h2").sortWithinPartitions("h1", "h2", *order)
    heads = heads.withColumn("first", F.first("doc").over(Window.partitionBy("h1", "h2").orderBy(*order)))
    later = heads.where(~F.col("doc").eqNullSafe(F.col("first"))).select("doc", "tk", "pos")
    words = (
        ahead.unionAll(later)
        .groupBy("doc", "tk", (F.col("pos") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    )
    drops = words.groupBy("doc", "tk").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("drops"))
    return drops.select(F.col("doc").alias(id_col), F.col("tk").alias("text_key"), "drops")


def dense(drops: Column) -> Column:
    """The bitmap's words up to the last stored one, with zeros where none is stored."""
    last = F.element_at(drops, -1)["word"]
    by_word = F.map_from_entries(drops)
    return F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(F.try_element_at(by_word, w), F.lit(0).cast("long")))


def drop_lines(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``__lines`` and ``__kept``: all lines of each text and those that its bitmap leaves."""
    b = bitmaps.select(F.col(id_col).alias("__id"), F.col("text_key").alias("__tk"), dense(F.col("drops")).alias("__words"))
    d = docs.withColumns({"__key": text_key(F.col(text_col))})
    both = d.join(b, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__tk")), "left")
    bit = lambda i: F.getbit(F.coalesce(F.get(F.col("__words"), (i / 64).cast("int")), F.lit(0).cast("long")), i % 64)
    both = both.withColumn("__lines", lines_of(F.col(text_col)))
    kept = F.when(F.col("__words").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda x, i: bit(i) == 0))
    return both.withColumn("__kept", kept).drop("__id", "__tk", "__key", "__words")


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """docs with the lines dropped from their texts; all other columns as they were, no row lost.

    A null text in becomes an empty one; rows, ids and clashing column names are handled as in
    ``line_keep_bitmaps``.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    mine = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest") if rest else F.lit(None).alias("rest"))
    out = drop_lines(mine, line_keep_bitmaps(mine, id_col="doc", min_chars=min_chars), id_col="doc")
    back = {id_col: F.col("doc"), text_col: F.array_join("__kept", "\n")} | {c: F.col("rest")[c] for c in rest}
    return out.select(*[back[c].alias(c) for c in docs.columns])
