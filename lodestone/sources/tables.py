"""Parquet tables, and results kept in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, of a few numbers each, that are sent to the rows of a large table instead of shuffling it.
SMALL_ROWS = 500_000


def read_table(spark: SparkSession, path: str, partitions: int = 0) -> DataFrame:
    """The Parquet table at ``path``, in as many tasks as its files split into, or dealt into ``partitions`` if that is given.

    Dealing out is for a small file with one row group, which is one task
    however much work its rows make.
    """
    df = spark.read.parquet(path)
    return df.repartition(partitions) if partitions > 0 else df


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; without the setting, in a local session only, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df``, computed once, written to the shared folder and read from there."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df``, stored rows of a few numbers, to be sent to what it is joined with if they are few."""
    return F.broadcast(df) if df.count() <= most else df
