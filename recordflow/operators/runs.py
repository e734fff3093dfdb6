"""Runs: stretches of the sorted order, as a sort on little memory would make them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinals import with_ordinal


def run_stats(df: DataFrame, key: str, rows: int, *order: Column | str) -> DataFrame:
    """run_id, first and last key and rows of each run of ``rows`` rows of the order."""
    placed = with_ordinal(df, *order)
    run = F.floor((F.col("rn") - 1) / F.lit(rows)).cast("long")
    return placed.groupBy(run.alias("run_id")).agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("n_rows"))


def hash_partitions(df: DataFrame, key: Column, parts: int) -> DataFrame:
    """Rows of each partition of an integer key."""
    return df.groupBy(F.pmod(key, F.lit(parts)).cast("long").alias("part")).agg(F.count("*").alias("n_rows"))


def adjacent_distinct(df: DataFrame, column: str, *ties: str) -> DataFrame:
    """Of equal neighbours in the order of the column the first stays: exact, as the whole value is the order."""
    return df.groupBy(column).agg(F.min(F.struct(*ties)).alias("_first")).select(column, *[F.col(f"_first.{t}").alias(t) for t in ties])
