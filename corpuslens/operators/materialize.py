"""Cutting lineage where a plan's parts must see the same partitions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; one of our own only where none is set and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='corpuslens-')}"
    spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder that goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/corpuslens/{tag}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def fixed(rows: DataFrame) -> DataFrame:
    """rows from a checkpoint in the session's shared folder."""
    spark = rows.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return rows.checkpoint()
