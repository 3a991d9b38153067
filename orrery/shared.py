"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder, which only a session on one machine may have."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="orrery-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession) -> str:
    """A path of one's own in the shared folder, removed when the session's Python ends."""
    path = f"{shared_dir(spark)}/orrery/{uuid.uuid4().hex}"

    def last() -> None:
        try:
            delete(spark, path)
        except Exception:  # the session has ended before
            pass

    atexit.register(last)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df, written once: what reads it reads the same rows, and lost executors cost nothing but a read."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
