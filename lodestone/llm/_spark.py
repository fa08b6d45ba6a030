"""Session helpers shared by the operators: shared folder, materialisation, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Bytes that a broadcast side may have; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent (a local session, as in tests) a folder under
    the temporary directory is used; a cluster without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = os.path.join(tempfile.gettempdir(), "checkpoints")
    os.makedirs(path, exist_ok=True)
    return f"file://{path}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts the lineage so that a lost executor costs a re-read instead of the
    whole job.  Shuffle files of the write go with its end, as nothing reads
    them again; the written files stay until :func:`clear_materialized`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def clear_materialized(spark: SparkSession) -> None:
    """Delete what :func:`materialize` wrote in this application; results still to be read from it are lost."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}")
    path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def _bytes(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        size = F.octet_length(value) + 16
    elif isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType)):
            size = F.aggregate(value, F.lit(16).cast("long"), lambda n, x: n + _bytes(x, kind.elementType))
        else:
            size = F.size(value) * 8 + 16
    elif isinstance(kind, StructType):
        size = sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("long"), F.lit(8).cast("long"))


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` when the sizes of its rows, summed first, show that it is small; ``df`` itself otherwise."""
    row = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))
    total = df.agg(F.sum(row)).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
