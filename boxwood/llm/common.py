"""Helpers that the training-data operators share.

A word is a run of bytes other than space and \\x09-\\x0D, which is what
``bytes.split()`` without arguments yields, so texts travel to Python as
UTF-8 bytes and are split there without decoding.
"""

from __future__ import annotations

import gc
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from boxwood.storage import shared_dir

#: Fixed value: the word pattern of the query contracts.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder (spark.checkpoint.dir) and read back.

    Cuts the lineage, survives lost executors, and lets several jobs read
    the same rows. The columns keep their types.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what durable wrote for these tables, which nothing reads any more; files of shuffles that only led to them go, too.

    Spark deletes a shuffle's files once the driver's JVM has collected what refers to it, so that is asked for.
    """
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._durable_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        let_go(tables[0].sparkSession)


def let_go(spark: SparkSession) -> None:
    gc.collect()
    spark._jvm.System.gc()


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
