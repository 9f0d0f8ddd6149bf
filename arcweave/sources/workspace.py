"""The folder that all executors share, and tables kept in it for the length of a job."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What the cluster names in ``spark.checkpoint.dir``; a temporary folder where none is named and all runs on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    made = sc.getCheckpointDir()
    if not made:
        if not sc.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="arcweave-"))
        made = sc.getCheckpointDir()
    return made.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted at the latest when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/arcweave-{uuid.uuid4().hex}-{name}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df``, written and read back: its lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._arcweave_path = path
    return out


def drop(table: DataFrame) -> None:
    """Delete a table of :func:`keep` that nothing reads any more, and the shuffle files of passes that are over."""
    spark = table.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(table._arcweave_path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished passes now."""
    gc.collect()
    spark._jvm.System.gc()
