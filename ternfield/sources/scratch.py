"""Tables written to the folder that driver and executors share: lineage ends there, and small models are read from there."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. A local-mode session that leaves it unset gets a folder of its own; elsewhere that is an error."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    there = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", there)
    return there


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def array_row(spark: SparkSession, name: str, **arrays: np.ndarray) -> DataFrame:
    """A written table of one row with an array (of arrays, for a matrix) of doubles in each column."""
    kinds = {1: pa.list_(pa.float64()), 2: pa.list_(pa.list_(pa.float64()))}
    row = pa.table({c: pa.array([np.asarray(a, float).tolist()], kinds[np.ndim(a)]) for c, a in arrays.items()})
    return written(spark.createDataFrame(row), name)
