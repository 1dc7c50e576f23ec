"""Where intermediate tables go: the folder of spark.checkpoint.dir, which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. A local session without the setting gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        set_to = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if set_to is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            set_to = tempfile.mkdtemp(prefix="boxwood-")
        sc.setCheckpointDir(set_to)
    return sc.getCheckpointDir()


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors. by: a column whose values get folders of their own."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    out._path = path
    return out


def released(table: DataFrame, part: str = "") -> None:
    """Deletes what written wrote for a table that nothing reads any more, or a folder of it."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table._path}/{part}".rstrip("/"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
