"""Examples stored by class: a folder a class, a manifest, and readers that see the classes they ask for alone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ternfield.functions.features import with_bias


def write_by_class(examples: DataFrame, folder: str) -> None:
    """Writes examples (ex, cls, idx, …) below ``folder``; a class that is in them replaces what was stored of it, others stay.

    The manifest has a row a class: how many examples, how many features are on in all, and an order-free digest of
    the ids. Data go first, so a manifest never tells of a class that is not there. Examples of a null class are kept
    as a class; without examples nothing changes.
    """
    how = {"partitionOverwriteMode": "dynamic"}
    examples.write.mode("overwrite").options(**how).partitionBy("cls").parquet(f"{folder}/data")
    counts = examples.groupBy("cls").agg(F.count("*").alias("n"), F.sum(F.greatest(F.size("idx"), F.lit(0))).alias("on"), F.bit_xor(F.xxhash64("ex")).alias("ids"))
    counts.write.mode("overwrite").options(**how).partitionBy("cls").parquet(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(cls, n, on, ids) of what is stored."""
    return spark.read.parquet(f"{folder}/manifest").select(F.col("cls").cast("int").alias("cls"), "n", "on", "ids")


def read_by_class(spark: SparkSession, folder: str, *, classes: Sequence[int] | None = None, bias: int | None = None, reduced: Mapping[int, int] | None = None) -> DataFrame:
    """The stored examples, of ``classes`` alone if given (the others' files are not opened).

    ``bias`` adds that feature to every example, the column of ones; ``reduced`` maps classes to coarser ones in a
    column ``reduced``, null for those it has not.
    """
    rows = spark.read.parquet(f"{folder}/data").withColumn("cls", F.col("cls").cast("int"))
    rows = rows.where(F.col("cls").isin([int(c) for c in classes])) if classes is not None else rows
    rows = rows.withColumn("idx", with_bias(F.coalesce("idx", F.array().cast("array<int>")), bias)) if bias is not None else rows
    if reduced is not None:
        of = F.create_map(*[F.lit(int(x)) for pair in sorted(reduced.items()) for x in pair])
        rows = rows.withColumn("reduced", F.try_element_at(of, F.col("cls")))
    return rows


def unlike_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(cls): classes whose stored examples are not those of the manifest."""
    rows = read_by_class(spark, folder).groupBy("cls").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("ex")).alias("ids"))
    told = manifest(spark, folder).select("cls", F.col("n").alias("told"), F.col("ids").alias("told_ids"))
    both = rows.alias("r").join(told.alias("m"), F.col("r.cls").eqNullSafe(F.col("m.cls")), "full")
    return both.where(~(F.col("n").eqNullSafe(F.col("told")) & F.col("ids").eqNullSafe(F.col("told_ids")))).select(F.coalesce("r.cls", "m.cls").alias("cls"))
