"""Derived tables that are kept up to date: late rows touch some days, and only what depends on them is read and written.

Source and derived table are folders partitioned by ``day``. A derived row of a day depends on source rows up to ``back``
days before it, so rows of a day touch derived days up to ``back`` days after it. An update reads the source for those
days and the warm-up before them (partitions are pruned, older files aren't listed as inputs) and overwrites
the derived partitions of just these days. Operators must look back by days (range windows), not by rows of a key, which
sparse keys may have any time ago.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import stored

Span = tuple[datetime.date, datetime.date]


def _overwrite(df: DataFrame, path: str, mode: str = "dynamic") -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("day").parquet(path)


def merged(spans: list[Span]) -> list[Span]:
    """Spans of days that overlap or adjoin, as one each."""
    out: list[Span] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + datetime.timedelta(days=1):
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def within(spans: list[Span]) -> Column:
    return reduce(lambda a, b: a | b, (F.col("day").between(F.lit(lo), F.lit(hi)) for lo, hi in spans), F.lit(False))


class IncrementalTable:
    """``build`` makes the derived rows from source rows; both have the date column ``time``."""

    def __init__(self, spark: SparkSession, source: str, derived: str, build: Callable[[DataFrame], DataFrame], back: int, keys: list[str], time: str = "date"):
        self.spark, self.source, self.derived, self.build, self.back, self.keys, self.time = spark, source, derived, build, back, keys, time

    def _dated(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("day", F.to_date(self.time)).repartition("day")

    def create(self, rows: DataFrame) -> None:
        """Write both tables anew from all rows."""
        _overwrite(self._dated(rows), self.source, "static")
        _overwrite(self._dated(self.build(self.spark.read.parquet(self.source).drop("day"))), self.derived, "static")

    def merge(self, late: DataFrame) -> list[datetime.date]:
        """Rows take the place of those with their keys; returns the days touched. Only these days' partitions are read; what
        they become is stored before it is put in place."""
        late = stored(late.withColumn("day", F.to_date(self.time)), "late")
        days = sorted(r[0] for r in late.select("day").distinct().collect())
        if not days:
            return []
        old = self.spark.read.parquet(self.source).where(F.col("day").isin(days))
        kept = old.join(late.select(*self.keys).distinct(), self.keys, "left_anti")
        _overwrite(stored(kept.select(*late.columns).unionByName(late), "merged").repartition("day"), self.source)
        return days

    def spans(self, days: list[datetime.date]) -> tuple[list[Span], list[Span]]:
        """Derived days to write, and source days to read for them."""
        reach = datetime.timedelta(days=self.back)
        out = merged([(d, d + reach) for d in days])
        return out, merged([(lo - reach, hi) for lo, hi in out])

    def inputs(self, days: list[datetime.date]) -> DataFrame:
        return self.spark.read.parquet(self.source).where(within(self.spans(days)[1]))

    def recompute(self, days: list[datetime.date]) -> list[Span]:
        """Bring the derived days that depend on ``days`` up to date."""
        if not days:
            return []
        writes, _ = self.spans(days)
        rows = self.build(self.inputs(days).drop("day")).withColumn("day", F.to_date(self.time)).where(within(writes))
        _overwrite(rows.repartition("day"), self.derived)
        return writes

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.derived).drop("day")


def merge_bars(cached: DataFrame, fresh: DataFrame, keys: list[str], time: str = "ts", today: datetime.date | None = None) -> DataFrame:
    """Bars of a cache and newly fetched ones, one per key and time: fresh bars win, and of ``today`` none of the cache stays,
    as it may have been fetched before the day's end."""
    old = cached if today is None else cached.where(F.to_date(time) != F.lit(today))
    return old.join(fresh.select(*keys, time).distinct(), [*keys, time], "left_anti").unionByName(fresh.dropDuplicates([*keys, time]))
