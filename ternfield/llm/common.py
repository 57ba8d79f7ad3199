"""What the training-data operators share: inputs, the shared scratch folder, cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local-mode session (tests) that leaves it unset gets a fresh folder of its own; on a
    cluster an unset folder is an error, as a machine-local one would be lost with its machine.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    there = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", there)
    return there


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: lineage ends here and survives any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def posix_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one, for files that tasks open themselves.

    Memory-mapped files need a mounted path, so a shared folder in an object store is an error here.
    """
    path = scratch_path(spark, name)
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {path}")
    return "/" + path.removeprefix("file:").lstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches end at 4 MB, so that a run of very long texts does not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def free_name(stem: str, columns: Sequence[str]) -> str:
    """A column name like ``stem`` that none of the columns has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def words(text: Column) -> Column:
    """How many runs of characters other than blanks a text holds; 0 for a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cumulated(df: DataFrame, order: Sequence[str], values: Sequence[str], name: str) -> DataFrame:
    """df with ``<value>_upto`` for each value: its sum over all rows up to this one in the order of the columns.

    Rows are dealt by range of ``order`` (ascending, nulls first), summed as they stream through a task, and written;
    one row a range then meets in a window. Values are bigint without nulls. Rows that tie in ``order`` must differ in
    nothing that matters, and must not be many, as they share a range. df is read twice: write it first if it is dear.
    """
    values = list(values)
    rows = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    kinds = T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType()), *(T.StructField(f"__{v}", T.LongType()) for v in values)])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), dict.fromkeys(values, 0)
        for b in batches:
            sums = []
            for v in values:
                sums.append(pc.add(pc.cumulative_sum(b.column(v)), so_far[v]))
                so_far[v] = sums[-1][-1].as_py() if len(b) else so_far[v]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(b), pa.int32()), *sums], names=[f.name for f in kinds.fields])

    done = written(rows.mapInArrow(streamed, kinds), name)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = done.groupBy("__part").agg(*[F.max(f"__{v}").alias(v) for v in values])
    bases = parts.select("__part", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__base_{v}") for v in values])
    out = done.join(F.broadcast(bases), "__part")
    return out.select(*df.columns, *[(F.col(f"__{v}") + F.col(f"__base_{v}")).alias(f"{v}_upto") for v in values])
