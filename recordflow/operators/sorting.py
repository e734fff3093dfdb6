"""Sorts, alone and joined with distinct, groups and limits, in as few exchanges as can be."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _parts(df: DataFrame, parts: int | None) -> int:
    return parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sort_records(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows in order over the whole frame: one range exchange, spilling sorts."""
    return df.orderBy(*order)


def sort_distinct(df: DataFrame, *columns: str, mode: str = "range", parts: int | None = None) -> DataFrame:
    """The distinct values of the columns, in their order.

    ``range``: one exchange, by range of the columns; distinct and sort both work on
    it. ``hash``: duplicates go before a first exchange too, and a second one orders
    what is left: better where most rows repeat, or where one value has very many.
    ``adjacent``: one exchange by range, a sort, and a comparison of neighbours.
    All give the same rows: whole records are compared, so ties of a key can't hide
    a duplicate.
    """
    columns = columns or tuple(df.columns)
    own = df.select(*columns)
    if mode == "hash":
        return own.distinct().orderBy(*columns)
    dealt = own.repartitionByRange(_parts(df, parts), *columns)
    if mode == "range":
        return dealt.dropDuplicates(list(columns)).orderBy(*columns)
    if mode == "adjacent":
        return distinct_sorted(dealt.sortWithinPartitions(*columns))
    raise ValueError(f"mode {mode!r}")


def distinct_sorted(df: DataFrame) -> DataFrame:
    """In-stream distinct: of rows that stand together the first stays.

    The frame must be sorted within partitions, with equal rows in one partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = pa.array([last is None or [c[0].as_py() for c in batch.columns] != last] + [False] * (n - 1))
            if n > 1:
                differs = pa.array([False] * (n - 1))
                for c in batch.columns:
                    a, b = c.slice(1), c.slice(0, n - 1)
                    differs = pc.or_(differs, pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null())))
                new = pa.concat_arrays([new.slice(0, 1), differs.combine_chunks() if isinstance(differs, pa.ChunkedArray) else differs])
            last = [c[n - 1].as_py() for c in batch.columns]
            yield batch.filter(new)

    return df.mapInArrow(run, df.schema)


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """In-sort top: each task keeps k rows, and no full sort is made."""
    return df.orderBy(*order).limit(k)


def top_k_distinct(df: DataFrame, k: int, *columns: str) -> DataFrame:
    """The first k distinct values: duplicates go before rows are shuffled."""
    return df.select(*columns).distinct().orderBy(*columns).limit(k)


def group_sorted(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """In-sort group-by: groups in order of their keys. Rows are aggregated before the exchange, so a hot key is no load."""
    return df.groupBy(*keys).agg(*aggregates).orderBy(*keys)


def group_in_stream(df: DataFrame, keys: list[str], *aggregates: Column, parts: int | None = None) -> DataFrame:
    """Group-by over rows dealt by range: one exchange, whose order the groups keep."""
    return df.repartitionByRange(_parts(df, parts), *keys).groupBy(*keys).agg(*aggregates).sortWithinPartitions(*keys)


def merge_sorted(*frames: DataFrame, order: list[Column | str], distinct: bool = False) -> DataFrame:
    """Frames of one schema as a single one in order; with ``distinct`` equal rows are one."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return (out.distinct() if distinct else out).orderBy(*order)


def duplicates_removed(df: DataFrame, *columns: str) -> DataFrame:
    """n_rows, n_distinct and duplicates of the columns, in one pass: a row for each distinct value is shuffled."""
    each = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct")).withColumn("duplicates", F.col("n_rows") - F.col("n_distinct"))
