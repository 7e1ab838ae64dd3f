"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are neither space nor tab .. carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one on a single machine; on
    a cluster each machine would write to a disk of its own, so that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "orgwatch-checkpoints")
    return found.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What runs inside hands Python workers at most ``rows`` rows at a time (fewer where the session asks for fewer). A
    batch of texts lies in the JVM, in Arrow and in pandas at once, so its size is what workers need memory for."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    spark.conf.set(key, rows if before <= 0 else min(rows, before))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: a lost executor then costs a re-read, not a re-run."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orgwatch-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame) -> tuple[DataFrame, Column, Column]:
    """``df`` as rows of files, and two numbers that name a row: its file's and its place in the file. They are the same in
    every scan, however the files are split; a table that does not come from files is written first."""
    try:
        of_file = df.metadataColumn("_metadata")
        df.select(of_file["row_index"]).schema
    except AnalysisException:
        df = cut_lineage(df)
        of_file = df.metadataColumn("_metadata")
    return df, F.xxhash64(of_file["file_path"]), of_file["row_index"]


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    name = stem
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name
