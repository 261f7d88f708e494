"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Only a local master, where there is one machine, may leave it unset.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="spark-millrace-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/millrace/{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}-{tag}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Spark's own Hadoop client has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _place(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Sorted names in a folder; none if there is no such folder."""
    fs, where = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _place(spark, path)
    fs.delete(where, True)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file; one that is there stays."""
    fs, where = _place(spark, path)
    if not fs.exists(where):
        fs.create(where, True).close()


def commit(spark: SparkSession, staged: str, path: str) -> bool:
    """Give what was staged its final name, in one step; False, and the staged files go, if the name is taken."""
    fs, target = _place(spark, path)
    _, source = _place(spark, staged)
    if not fs.exists(target):
        fs.mkdirs(target.getParent())
        if fs.rename(source, target):
            return True
        if not fs.exists(target):
            raise OSError(f"cannot rename {staged} to {path}")
    fs.delete(source, True)
    return False


def write_once(df: DataFrame, path: str, format: str = "parquet", by: list[str] = (), **options: str) -> bool:
    """Write a folder that is there as a whole or not at all; one that is there stays as it is."""
    spark = df.sparkSession
    if exists(spark, path):
        return False
    # No part of the folder's own name: Spark reads folders with a = in them, also those that begin with _.
    staged = f"{path.rstrip('/').rpartition('/')[0]}/_staged-{uuid.uuid4().hex}"
    df.write.options(**options).partitionBy(*by).format(format).save(staged)
    return commit(spark, staged, path)
