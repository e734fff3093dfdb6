"""A plan of records: scan, filter, sort, distinct, group, top, check and write, each a lazy step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators import filters, sorting, verify
from ..sources import generate, records
from ..spec import RecordSpec


@dataclass(frozen=True)
class RecordPlan:
    """A frame of records and what they look like; each step gives another plan."""

    frame: DataFrame
    spec: RecordSpec = RecordSpec()

    @staticmethod
    def scan(spark: SparkSession, path: str, spec: RecordSpec = RecordSpec(), binary: bool = False) -> RecordPlan:
        read = records.read_binary_records if binary else records.read_text_records
        return RecordPlan(read(spark, path, spec), spec)

    @staticmethod
    def generated(spark: SparkSession, n: int, spec: RecordSpec = RecordSpec(), seed: int = 100, duplicates: bool = True) -> RecordPlan:
        return RecordPlan(generate.generate(spark, n, spec, seed, duplicates), spec)

    def _next(self, frame: DataFrame) -> RecordPlan:
        return RecordPlan(frame, self.spec)

    def where(self, condition: Column | str) -> RecordPlan:
        return self._next(filters.filter_where(self.frame, condition))

    def alternate(self, *order: str) -> RecordPlan:
        return self._next(filters.filter_alternate(self.frame, *order))

    def sort(self, *order: Column | str) -> RecordPlan:
        return self._next(sorting.sort_records(self.frame, *(order or ("rec",))))

    def sort_distinct(self, *columns: str, mode: str = "range") -> RecordPlan:
        return self._next(sorting.sort_distinct(self.frame, *(columns or ("rec",)), mode=mode))

    def group(self, keys: list[str], *aggregates: Column) -> RecordPlan:
        return self._next(sorting.group_sorted(self.frame, keys, *aggregates))

    def top(self, k: int, *order: Column | str) -> RecordPlan:
        return self._next(sorting.top_k(self.frame, k, *(order or ("rec",))))

    def merge(self, *others: RecordPlan, order: list[Column | str], distinct: bool = False) -> RecordPlan:
        return self._next(sorting.merge_sorted(self.frame, *(o.frame for o in others), order=order, distinct=distinct))

    def check_against(self, source: RecordPlan) -> DataFrame:
        return verify.verify_integrity(self.frame, source.frame)

    def write(self, path: str) -> None:
        records.write_records(self.frame, path)

    def explain(self) -> None:
        self.frame.explain("formatted")
