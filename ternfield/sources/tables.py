"""Readers of tables, sound files, arrays, text matrices, transcripts, label maps and settings; writers of LIBSVM text."""

from __future__ import annotations

import ast
import configparser
import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sounds(spark: SparkSession, folder: str, *, pattern: str = "*.wav") -> DataFrame:
    """(path, rate, x): the 16-bit samples of every sound file below a folder whose name fits; first channel alone.

    Files that hold no such sound have null rate and x.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
                        x = np.frombuffer(w.readframes(w.getnframes()), "<i2")[::channels] if width == 2 else None
                except (wave.Error, EOFError):
                    rate = x = None
                rate = None if x is None else rate
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([rate], pa.int32()), pa.array([x], pa.list_(pa.int16()))], ["path", "rate", "x"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInArrow(each, "path string, rate int, x array<smallint>")


def samples(read: DataFrame) -> DataFrame:
    """(sig, n, x) of sounds: samples in units of full scale."""
    return read.select(F.col("path").alias("sig"), F.posexplode("x").alias("n", "x")).select("sig", F.col("n").cast("long").alias("n"), (F.col("x") / 32768.0).alias("x"))


def arrays(spark: SparkSession, folder: str, *, pattern: str = "*.npy") -> DataFrame:
    """(path, row, v): the rows of every saved matrix below a folder; a vector is a matrix of one column.

    A file that holds no such numbers gives one row with null row and v; one without bytes gives none.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    a = np.load(io.BytesIO(content), allow_pickle=False)
                    a = a.reshape(len(a), -1).astype(float)
                except (ValueError, EOFError, OSError, TypeError, AttributeError):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.float64()))], ["path", "row", "v"])
                    continue
                for start in range(0, len(a), 4096):
                    part = a[start : start + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(range(start, start + len(part)), pa.int64()), pa.array(list(part), pa.list_(pa.float64()))], ["path", "row", "v"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInArrow(each, "path string, row bigint, v array<double>")


def text_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(v) of each line of numbers between white space; blank lines and those after # are left out."""
    line = F.trim(F.regexp_replace("value", "#.*", ""))
    return spark.read.text(path).where(line != "").select(F.split(line, r"\s+").cast("array<double>").alias("v"))


def settings(text: str) -> dict[str, dict[str, object]]:
    """section -> name -> value of settings whose values are Python literals; others stay text."""
    parsed = configparser.ConfigParser()
    parsed.optionxform = str
    parsed.read_string(text)

    def value(raw: str) -> object:
        try:
            return ast.literal_eval(raw)
        except (ValueError, SyntaxError):
            return raw

    return {name: {k: value(v) for k, v in parsed[name].items()} for name in parsed.sections()}


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """(fine, coarse) from a text of two columns."""
    cells = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(cells[0].alias("fine"), cells[1].alias("coarse"))


def instances(lines: DataFrame, *, line_col: str = "value") -> DataFrame:
    """(path, ord, s, e) from lines ``path s e | s e | ...``; tokens are read three at a time."""
    parts = F.split(F.trim(line_col), r"\s+")
    spans = F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(3)), lambda i: F.struct(F.get(parts, i).cast("long").alias("s"), F.get(parts, i + 1).cast("long").alias("e")))
    return lines.where(F.size(parts) >= 3).select(parts[0].alias("path"), F.posexplode(spans).alias("ord", "span")).select("path", "ord", "span.s", "span.e")


def svm_line(label: Column, values: Column) -> Column:
    """One line of LIBSVM text: the label, then 1-based index:value cells."""
    cells = F.transform(values, lambda v, i: F.concat_ws(":", (i + 1).cast("string"), v.cast("string")))
    return F.concat_ws(" ", label.cast("string"), F.array_join(cells, " "))
