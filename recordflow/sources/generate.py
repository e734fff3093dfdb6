"""Seeded records: the same for a seed, however the work is dealt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.record import key
from ..shared import hadoop_path
from ..spec import RecordSpec
from .records import check_alignment, read_text_records, write_records

#: Fixed value: the characters of generated records, in byte order.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


#: Primes below 2**31, so that products of two remainders fit a long.
PRIMES = (2147483647, 2147483629)


def random_text(source: Column, size: int, seed: int) -> Column:
    """``size`` characters that depend on ``source`` (0 or more) and the seed alone.

    Two remainders of the source, which are apart until its square of both primes, and the
    place of four characters make a number whose square picks these. Plain integer arithmetic, so any SQL engine can do the same.
    """
    p, q = PRIMES
    n = len(ALPHABET)
    whole, rest = F.floor(source / F.lit(p)).cast("long"), F.pmod(source, F.lit(p))
    one = F.pmod(F.pmod(rest * 48271, F.lit(p)) * 69621 + whole * 40692 + F.lit(seed * 16807 + 1), F.lit(p))
    two = F.pmod(F.pmod(rest * 40014, F.lit(q)) * 39373 + whole * 30323 + F.lit(seed * 45991 + 7), F.lit(q))
    blocks = F.sequence(F.lit(0).cast("long"), F.lit(max(size - 1, 0) // 4).cast("long"))

    def drawn(pair: Column) -> Column:
        x = F.transform(blocks, lambda i: F.pmod(pair["one"] + i * 104729, F.lit(p)))
        y = F.transform(x, lambda x, i: F.pmod(x * x + pair["two"] * (i + 1), F.lit(q)))
        v = F.transform(y, lambda y: F.pmod(y * y, F.lit(p)))
        letter = lambda v, k: F.substring(F.lit(ALPHABET), (F.pmod(F.floor(v / F.lit(n**k)), F.lit(n)) + 1).cast("int"), F.lit(1))
        return F.substring(F.array_join(F.transform(v, lambda v: F.concat(*(letter(v, k) for k in range(4)))), ""), 1, max(size, 1))

    return F.transform(F.array(F.struct(one.alias("one"), two.alias("two"))), drawn)[0]  # so that both are worked out once a record


def duplicate_pairs(n: int, batch: int = 4096) -> int:
    """How many generated records repeat the one before: half of each full batch."""
    size = batch_size(n, batch)
    return n // size * (size // 2) if size else 0


def batch_size(n: int, batch: int = 4096) -> int:
    """Records of a batch: even, and no more than there are; 0 below two records."""
    return 0 if n <= 1 else min(batch, n) // 2 * 2


def generate(spark: SparkSession, n: int, spec: RecordSpec = RecordSpec(), seed: int = 100, duplicates: bool = True, batch: int = 4096) -> DataFrame:
    """id, rec and key of n records; with ``duplicates`` each record of a full batch comes twice in a row."""
    ids = spark.range(n)
    size = batch_size(n, batch)
    full = n // size * size if size else 0
    source = F.when(F.col("id") < full, F.floor(F.col("id") / 2) * 2).otherwise(F.col("id")) if duplicates else F.col("id")
    rec = random_text(source.cast("long"), spec.text_size, seed)
    return ids.withColumn("rec", rec).withColumn("key", key("rec", spec.key_size))


def open_or_generate(spark: SparkSession, path: str, n: int, spec: RecordSpec = RecordSpec(), seed: int = 100, duplicates: bool = True) -> DataFrame:
    """The records at ``path``; if there are none, n are generated and written there first. Another number is an error."""
    p, fs = hadoop_path(spark, path)
    if not fs.exists(p):
        write_records(generate(spark, n, spec, seed, duplicates), path)
    found = check_alignment(spark, path, spec.record_size)
    if found != n:
        raise ValueError(f"{path} has {found} records, not {n}")
    return read_text_records(spark, path, spec, check=False)
