"""Positions in a total order, without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

LOW_BITS = (1 << 33) - 1  # monotonically_increasing_id() counts a partition's rows in these


def with_ordinal(df: DataFrame, *order: Column | str, name: str = "rn", parts: int | None = None) -> DataFrame:
    """The rows with their position, from 1, in an order that should be total.

    Rows are dealt by range and sorted where they land, on the exchange of a sort in
    this order where the frame ends with one; part and place within it are
    written with them, once, since another run would cut the ranges elsewhere. Only
    the sizes of the parts are then summed up.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys) if parts else df.orderBy(*keys)
    placed = written(dealt.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(LOW_BITS))}), "ordinals")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each part
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")
