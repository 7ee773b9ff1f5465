"""Mappings on Structured Streaming: they are row-local, so the same columns run on a stream without state.

Counts of failures over time are the one stateful part: a watermark bounds their state and says which late rows don't count.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..plans.mapping import Mapping
from ..sources.json_schema import Schema


def mapped_stream(stream: DataFrame, mapping: Mapping, input_column: str | None = None, source: Schema | None = None, target: Schema | None = None) -> DataFrame:
    return mapping.transform(stream, "report", input_column, source, target)


def error_rates(mapped: DataFrame, time_column: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """start, err, n: rows of each window by error code (null: none)."""
    timed = mapped.withColumn(time_column, F.col(time_column).cast("timestamp"))  # a watermark needs an instant
    counted = timed.withWatermark(time_column, late).groupBy(F.window(time_column, window), "err").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "err", "n")


def split_sink(mapped: DataFrame, good: str, bad: str, checkpoint: str) -> DataStreamWriter:
    """Good rows to one Parquet folder, bad ones with their issues to another; both are written from one read of a batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for rows, folder in ((batch.where("err is null"), good), (batch.where("err is not null"), bad)):
            # a batch that is run again replaces its own folder, so nothing is written twice
            rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        batch.unpersist()

    return mapped.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
