"""Session helpers shared by all operators: reading tables, cutting lineage, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The placeholder words of the works register.
PLACEHOLDERS = (
    "", "-", "--", ".", "?", "n/a", "n.a.", "na", "null", "none", "nil", "nan", "unknown",
    "not available", "not applicable", "no data", "0000-00-00", "00-00-0000", "9999-99-99",
)

#: Rows up to which a side is broadcast after its size was counted.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where that is unset a session in one process gets a folder of
    its own, removed at the end; a cluster is refused, as its executors would each write to a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallymark-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_WRITTEN: list[str] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as a table into the shared folder and read it back. ``forget`` removes such tables."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Remove all tables written by ``materialize``; results read from them must have been consumed. How many there were."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count proves it small, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it comes in fewer: for costly work on the rows of a small table."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def is_placeholder(column: Column) -> Column:
    return F.lower(F.trim(column)).isin(*PLACEHOLDERS)
