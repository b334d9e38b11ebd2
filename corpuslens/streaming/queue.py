"""Streaming forms: the queue of pending snippets, and incremental roll-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpuslens.operators.materialize import scratch


def pending_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Unprocessed snippets as files arrive; each snippet once."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.filter(~F.col("processed")).dropDuplicates(["snippet_id"])


def work_queue(pending: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs handle on each micro-batch; the checkpoint resumes after a restart where it stopped."""
    return pending.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()


def rollup_stream(children: DataFrame, key: str) -> DataFrame:
    """key, open, processed by parent from a stream of child states: use with output mode update or complete."""
    is_open = F.when(F.coalesce("processed", F.lit(False)), 0).otherwise(1)
    return children.groupBy(key).agg(F.sum(is_open).cast("long").alias("open"), F.bool_and(F.coalesce("processed", F.lit(False))).alias("processed"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: events by tumbling window and type, with late data dropped after a watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def drained(stream: DataFrame, *keys: str) -> DataFrame:
    """Drains a finite aggregated stream: the last state of each key.

    Micro-batches write the groups they changed (output mode update, so state
    behind the watermark goes) as Parquet in the shared folder; a batch that is
    run again overwrites its own folder. Nothing is held by the driver.
    """
    spark = stream.sparkSession
    place = scratch(spark, "stream")

    def store(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/rows/batch={batch}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
    fields = list(stream.schema.names)
    states = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{place}/rows")
    last = states.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in fields if c not in keys]), "batch").alias("_state"))
    return last.select(*keys, "_state.*").select(*fields)
