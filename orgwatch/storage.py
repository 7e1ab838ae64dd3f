"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it names none, a temporary one on a single machine (elsewhere each
    machine would write to a disk of its own, so that is an error)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "orgwatch-checkpoints")
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: a lost executor then costs a re-read, not a re-run."""
    path = f"{shared_dir(df.sparkSession)}/orgwatch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
