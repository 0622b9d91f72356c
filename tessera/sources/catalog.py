"""Named datasets with schemas, quality gates, versions, upserts and freshness."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Dataset:
    """Where a dataset lies, what it holds, and how often it should change."""

    name: str
    path: str
    keys: tuple[str, ...]
    time: str | None = None
    frequency_days: int = 1
    schema: T.StructType | None = None
    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)


class Catalog:
    def __init__(self, spark: SparkSession, datasets: list[Dataset]):
        self.spark, self._known = spark, {d.name: d for d in datasets}

    def names(self) -> list[str]:
        return sorted(self._known)

    def schema_of(self, name: str) -> T.StructType:
        return self._known[name].schema or self.read(name).schema

    def read(self, name: str, start: str | None = None, end: str | None = None, columns: list[str] | None = None) -> DataFrame:
        """The dataset, clipped to [start, end]; unknown names raise KeyError. NaN reads as missing."""
        d = self._known[name]
        reader = self.spark.read.format(d.format).options(**d.options)
        df = (reader.schema(d.schema) if d.schema is not None else reader).load(d.path)
        if d.time and start is not None:
            df = df.where(F.col(d.time) >= F.lit(start).cast(df.schema[d.time].dataType))
        if d.time and end is not None:
            df = df.where(F.col(d.time) <= F.lit(end).cast(df.schema[d.time].dataType))
        df = df.select(*columns) if columns else df
        return nan_to_null(df)

    def latest(self, name: str, n: int) -> DataFrame:
        """The last n rows of every key."""
        d = self._known[name]
        keys = [k for k in d.keys if k != d.time]
        w = Window.partitionBy(*keys).orderBy(F.desc(d.time))
        return self.read(name).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")

    def freshness(self, today: str) -> DataFrame:
        """Rows, last date, age in days and a status for every dataset with a time column."""
        parts = []
        for d in self._known.values():
            if d.time:
                rows = self.read(d.name).agg(F.count("*").alias("rows"), F.max(F.to_date(d.time)).alias("last"))
                age = F.datediff(F.lit(today).cast("date"), F.col("last"))
                status = F.when(F.col("rows") == 0, "empty").when(age <= d.frequency_days, "fresh").otherwise("stale")
                parts.append(rows.select(F.lit(d.name).alias("dataset"), "rows", "last", age.alias("age_days"), status.alias("status")))
        return reduce(DataFrame.unionByName, parts)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is how files say missing; Spark would order and average it as a value."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns)) if floats else df


def require_columns(df: DataFrame, columns: list[str], what: str = "panel") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}_missing_columns:{','.join(missing)}")
    return df


def gate(df: DataFrame, keys: list[str], what: str = "panel") -> DataFrame:
    """Raise if a key is null or repeated; one aggregate decides."""
    require_columns(df, keys, what)
    bad = F.count_if(reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))).alias("nulls")
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    row = df.agg(bad).crossJoin(counts.agg(F.count_if(F.col("__n") > 1).alias("repeats"))).first()
    if row["nulls"]:
        raise ValueError(f"{what}_null_keys:{row['nulls']}")
    if row["repeats"]:
        raise ValueError(f"{what}_duplicate_keys:{row['repeats']}")
    return df


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in the given order."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key isn't in the new ones, and the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def increment(old: DataFrame, new: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Insert, or add to the count that is there."""
    return old.unionByName(new).groupBy(*keys).agg(F.sum(count).alias(count))


_NAME = re.compile(r"[A-Za-z_]\w*")


def quoted(name: str) -> str:
    """A safe identifier in backticks."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"bad identifier: {name!r}")
    return f"`{name}`"


class VersionedTable:
    """A folder of months, each with versions; readers see one version everywhere, never a mixture."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, df: DataFrame, version: str, time: str = "date") -> None:
        rows = df.withColumn("version", F.lit(version)).withColumn("year", F.year(time)).withColumn("month", F.month(time))
        rows.write.mode("append").partitionBy("version", "year", "month").option("compression", "zstd").parquet(self.path)

    def versions(self) -> list[str]:
        rows = self.spark.read.parquet(self.path).select(F.col("version").cast("string")).distinct()
        return sorted(r["version"] for r in rows.collect())

    def read(self, version: str | None = None) -> DataFrame:
        df = self.spark.read.option("basePath", self.path).parquet(self.path).withColumn("version", F.col("version").cast("string"))
        chosen = version if version is not None else self.versions()[-1]
        return df.where(F.col("version") == chosen).drop("version", "year", "month")
