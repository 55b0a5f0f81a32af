"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode, and an error on a cluster, whose executors would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
    return have.get()


def drop_stored(spark: SparkSession) -> None:
    """Delete all tables of :func:`stored` that this application wrote. Call it when the results that read them are written."""
    target = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tessera/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, and survives lost executors.

    Unlike a checkpoint it is columnar: later readers prune columns, and the
    optimiser knows the size.
    """
    path = f"{_own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table of :func:`stored` that a newer one has replaced."""
    path = getattr(df, "_tessera_path", None)
    if path:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
