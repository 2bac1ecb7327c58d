"""Folders for state and scratch tables, in the place that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone; the folder is scratch space
            continue


atexit.register(_clean)


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which goes when the process ends.

    Where that is unset, under /tmp/checkpoints in a local session; on a cluster it is an error, as executors would not
    share the folder.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: a folder that all executors share is needed")
    path = f"{(root or '/tmp/checkpoints').rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a new scratch table and read it: later steps share it, and it survives lost executors."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
