"""Distinct, groups and sorted batches over streams of records; beyond what bounded files need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sorting import sort_distinct


def distinct_within(stream: DataFrame, time: str, delay: str, *columns: str) -> DataFrame:
    """Each value once within the delay; state older than the watermark goes."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(columns))


def windowed_groups(stream: DataFrame, time: str, delay: str, width: str, keys: list[str], *aggregates: Column, slide: str | None = None) -> DataFrame:
    """Aggregates of tumbling or sliding windows of event time; late rows count up to the delay."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, delay).groupBy(window, *keys).agg(*aggregates)


def write_sorted_batches(stream: DataFrame, path: str, checkpoint: str, *columns: str):
    """A query that writes each micro-batch as a sorted, distinct run below ``path``, once also after a restart."""

    def batch(df: DataFrame, number: int) -> None:
        sort_distinct(df, *columns).write.mode("overwrite").parquet(f"{path}/run={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
