"""Record and integer helpers as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key(rec: Column | str, size: int = 8) -> Column:
    """The leading ``size`` characters, or bytes of a binary column."""
    return F.substring(col(rec), 1, size)


def byte_key(rec: Column | str, size: int = 8) -> Column:
    """The leading ``size`` bytes, also of text with longer characters."""
    return F.substring(col(rec).cast("binary"), 1, size)


def is_valid(rec: Column | str) -> Column:
    """All characters are ASCII letters or digits."""
    return col(rec).rlike(r"\A[0-9A-Za-z]+\z")


def key_before(a: Column | str, b: Column | str, size: int = 8) -> Column:
    return key(a, size) < key(b, size)


def key_after(a: Column | str, b: Column | str, size: int = 8) -> Column:
    return key(a, size) > key(b, size)


def same_record(a: Column | str, b: Column | str) -> Column:
    return col(a) == col(b)


def record_hash(rec: Column | str) -> Column:
    """A 64-bit hash of the whole record."""
    return F.xxhash64(col(rec))


def round_down(x: Column | str, y: int) -> Column:
    """The largest multiple of y up to x."""
    return col(x) - F.pmod(col(x), F.lit(y))


def round_up(x: Column | str, y: int) -> Column:
    """The smallest multiple of y from x on."""
    return round_down(col(x) + F.lit(y - 1), y)


def divide_up(x: Column | str, y: int) -> Column:
    """x / y, rounded up."""
    return (round_up(x, y) / F.lit(y)).cast("long")


def is_power_of_2(x: Column | str) -> Column:
    return (col(x) > 0) & (col(x).bitwiseAND(col(x) - 1) == 0)


def lowest_bit(x: Column | str) -> Column:
    """The number of the lowest set bit, from 0; null for 0."""
    return F.when(col(x) != 0, F.bit_count(col(x).bitwiseAND(-col(x)) - F.lit(1).cast("long")).cast("int"))


def highest_bit(x: Column | str) -> Column:
    """The number of the highest set bit of a positive number, from 0; else null."""
    return F.when(col(x) > 0, F.length(F.bin(col(x))) - 1)


def is_odd(x: Column | str) -> Column:
    return F.pmod(col(x), F.lit(2)) == 1


def smaller(x: Column | str, y: Column | str) -> Column:
    """The smaller of two values; null if either is."""
    return F.when(col(x) <= col(y), col(x)).when(col(x) > col(y), col(y))


def larger(x: Column | str, y: Column | str) -> Column:
    """The larger of two values; null if either is."""
    return F.when(col(x) >= col(y), col(x)).when(col(x) < col(y), col(y))


def bit_mask(n: int) -> int:
    """A number with the n lowest bits set."""
    return (1 << n) - 1


def between(x: Column | str, low: Column | str, high: Column | str) -> Column:
    return (col(x) >= col(low)) & (col(x) <= col(high))
