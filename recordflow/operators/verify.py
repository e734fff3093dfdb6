"""Checks of sorted output; each gives a frame of findings and changes nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..spec import RecordSpec

STRETCH = "file string, block long, first string, last string, n_rows long, violations long"


def verify_order(spark: SparkSession, path: str, spec: RecordSpec = RecordSpec()) -> DataFrame:
    """n_rows and violations of the key order of text files: within each, and from each to the next by name.

    Neighbours are compared where they are read; of each stretch of a file only its
    first and last key go on, so no order of the rows is made anew.
    """
    rows = spark.read.schema("value string").text(path).select(F.substring("value", 1, spec.key_size).alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block, key = (batch.column(c) for c in ("file", "block", "key"))
            at = 0
            while at < batch.num_rows:
                place = (file[at].as_py(), block[at].as_py())
                same = pc.and_(pc.equal(file, place[0]), pc.equal(block, place[1])).slice(at)
                length = pc.index(same, False).as_py()
                length = batch.num_rows - at if length < 0 else length
                own = key.slice(at, length)
                bad = pc.sum(pc.greater(own.slice(0, length - 1), own.slice(1))).as_py() or 0 if length > 1 else 0
                first, last = own[0].as_py(), own[length - 1].as_py()
                if now and (now[0], now[1]) == place:
                    now[5] += bad + (now[3] > first)
                    now[3], now[4] = last, now[4] + length
                else:
                    if now:
                        yield _row(now)
                    now = [*place, first, last, length, bad]
                at += length
        if now:
            yield _row(now)

    stretches = rows.mapInArrow(run, STRETCH)
    before = F.lag("last").over(Window.orderBy("file", "block"))  # a row for each block of a file
    told = stretches.withColumn("violations", F.col("violations") + F.coalesce((before > F.col("first")).cast("long"), F.lit(0)))
    return told.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("violations"), F.lit(0)).alias("violations"))


def _row(values: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["file", "block", "first", "last", "n_rows", "violations"])


def order_violations(df: DataFrame, key: str, *order: str) -> DataFrame:
    """violations: rows whose key is below that of the row before in the given order of positions.

    One range exchange: neighbours are compared where they are sorted, and of each
    part only its first and last key go on. Nulls are neither below nor above.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.col(key).alias("key"), F.spark_partition_id().alias("part"))
    kind = dealt.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = part = None
        bad = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("key")
            if part is None:
                first, part = own.slice(0, 1), batch.column("part")[0]
            else:
                bad += pc.sum(pc.greater(last, own.slice(0, 1))).as_py() or 0
            bad += pc.sum(pc.greater(own.slice(0, batch.num_rows - 1), own.slice(1))).as_py() or 0
            last = own.slice(batch.num_rows - 1)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), first, last, pa.array([bad], pa.int64())], ["part", "first", "last", "bad"])

    told = dealt.mapInArrow(run, f"part int, first {kind}, last {kind}, bad long")
    before = F.lag("last").over(Window.orderBy("part"))  # a row for each part
    each = told.withColumn("bad", F.col("bad") + F.coalesce((before > F.col("first")).cast("long"), F.lit(0)))
    return each.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("violations"))


def verify_subset(output: DataFrame, source: DataFrame, column: str = "rec") -> DataFrame:
    """missing: rows of the output whose 64-bit hash no row of the source has. Says nothing of rows that were lost or doubled."""
    h = F.xxhash64(column).alias("h")
    return output.select(h).join(source.select(h).distinct(), "h", "left_anti").agg(F.count("*").alias("missing"))


def verify_integrity(output: DataFrame, source: DataFrame, column: str = "rec") -> DataFrame:
    """Whether the output is the distinct rows of the source, exactly: invented, lost and doubled values, and row counts.

    Both sides are counted by value in one exchange; a value that repeats is added up
    before it is shuffled.
    """
    both = output.select(F.col(column).alias("v"), F.lit(1).alias("o"), F.lit(0).alias("s")).unionByName(source.select(F.col(column).alias("v"), F.lit(0).alias("o"), F.lit(1).alias("s")))
    each = both.groupBy("v").agg(F.sum("o").alias("o"), F.sum("s").alias("s"))
    count = lambda c: F.coalesce(F.sum(F.expr(c).cast("long")), F.lit(0))
    return each.agg(count("o > 0 and s = 0").alias("invented"), count("o = 0 and s > 0").alias("lost"), count("o > 1").alias("doubled"), count("s").alias("n_source"), count("o").alias("n_output"))


def is_sound(findings: DataFrame) -> bool:
    """Whether a one-row frame of findings reports none."""
    row = findings.first().asDict()
    return not any(v for k, v in row.items() if not k.startswith("n_"))
