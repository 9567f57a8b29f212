"""Structured Streaming forms: windowed coverage with a watermark, and a keyed last-write-wins sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.operators.trail import latest


def coverage(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Runs and gaps by event-time window and type of a stream of events (ts, event_type, gap)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("runs"), F.count_if("gap").alias("gaps"))


def upserting(path: str, keys: list[str], seq: str):
    """For foreachBatch: the table at path keeps the latest row of each key. Two folders take turns, so that a batch that is
    run again finds its input untouched."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, keys, seq)
        if number:
            new = latest(spark.read.parquet(f"{path}/{(number - 1) % 2}").unionByName(new), keys, seq)
        new.write.mode("overwrite").parquet(f"{path}/{number % 2}")

    return run
