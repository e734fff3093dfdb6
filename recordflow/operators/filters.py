"""Filters by a condition and by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.record import is_valid
from .ordinals import with_ordinal


def filter_where(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows that meet a condition; the scan gets what it can push down."""
    return df.where(condition)


def filter_alternate(df: DataFrame, *order: Column | str, name: str = "rn") -> DataFrame:
    """The 1st, 3rd, 5th and so on row in the given order, with its position."""
    return with_ordinal(df, *order, name=name).where(F.pmod(F.col(name), F.lit(2)) == 1)


def filter_valid(df: DataFrame, column: str = "rec") -> DataFrame:
    """Records of ASCII letters and digits only."""
    return df.where(is_valid(column))
