"""Fixed-width record files as DataFrames, and ordered files of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.record import key
from ..shared import hadoop_path
from ..spec import RecordSpec


def file_sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Data files below a path, with their bytes; names that begin with _ or . are not data."""
    p, fs = hadoop_path(spark, path)
    status = fs.getFileStatus(p)
    if status.isFile():
        return {status.getPath().toString(): status.getLen()}
    found = {s.getPath(): s.getLen() for s in fs.listStatus(p) if s.isFile()}
    return {f.toString(): n for f, n in sorted(found.items(), key=lambda x: x[0].toString()) if f.getName()[0] not in "_."}


def check_alignment(spark: SparkSession, path: str, size: int) -> int:
    """The number of records below a path; a file that ends within a record is an error."""
    total = 0
    for name, n in file_sizes(spark, path).items():
        if n % size:
            raise ValueError(f"{name} has {n} bytes, not a multiple of {size}")
        total += n // size
    return total


def read_text_records(spark: SparkSession, path: str, spec: RecordSpec = RecordSpec(), check: bool = True) -> DataFrame:
    """rec and key of newline-terminated records."""
    if check:
        check_alignment(spark, path, spec.record_size)
    rec = spark.read.schema("value string").text(path).select(F.col("value").alias("rec"))
    return rec.withColumn("key", key("rec", spec.key_size))


def read_binary_records(spark: SparkSession, path: str, spec: RecordSpec = RecordSpec()) -> DataFrame:
    """rec and key, as binary, of records of any bytes; splits are aligned, and rows are made in the JVM."""
    check_alignment(spark, path, spec.record_size)
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    rdd = jsc.sc().binaryRecords(path, spec.record_size, jsc.hadoopConfiguration())
    frame = spark._jsparkSession.createDataset(rdd, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF()
    rec = DataFrame(frame, spark).select(F.col("value").alias("rec"))
    return rec.withColumn("key", key("rec", spec.key_size))


def write_records(df: DataFrame, path: str, column: str = "rec") -> None:
    """Text files, one for each partition; in order of name they keep the order of a sorted frame."""
    df.select(column).write.mode("overwrite").text(path)


def write_runs(df: DataFrame, path: str, parts: int, column: str = "rec") -> None:
    """Sorted runs: each file is in order, and so are the files one after another."""
    df.select(column).repartitionByRange(parts, column).sortWithinPartitions(column).write.mode("overwrite").parquet(path)


def join_files(spark: SparkSession, source: str, target: str) -> int:
    """The data files below ``source``, in order of name, as one file; gives its bytes.

    The copy is a stream through the driver, a buffer at a time: for results that must
    be one file, not for terabytes.
    """
    out_path, fs = hadoop_path(spark, target)
    out = fs.create(out_path, True)
    total = 0
    try:
        for name, n in file_sizes(spark, source).items():
            p, from_fs = hadoop_path(spark, name)
            part = from_fs.open(p)
            spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
            total += n
    finally:
        out.close()
    return total
