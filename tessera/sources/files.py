"""Files as tables: mapped CSV, panels of mixed formats, text sinks, listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.text import report_date
from tessera.sources.catalog import nan_to_null, require_columns


def read_csv(spark: SparkSession, path: str, columns: dict[str, tuple[str, ...]], types: dict[str, str] | None = None) -> DataFrame:
    """A CSV file with a header, under our own names: ``columns`` has for each the headers that it may bear in files, the first
    one found counts, the name itself last. Values that aren't of the type in ``types`` (double unless named) read as missing."""
    raw = spark.read.option("header", True).csv(path)
    out = []
    for name, headers in columns.items():
        found = next((h for h in (*headers, name) if h in raw.columns), None)
        kind = (types or {}).get(name, "double")
        value = F.lit(None).cast("string") if found is None else F.trim(F.col(f"`{found}`"))
        out.append((value if kind == "string" else value.try_cast(kind)).alias(name))
    return nan_to_null(raw.select(*out))


def load_panel(spark: SparkSession, paths: list[str], columns: dict[str, tuple[str, ...]] | None = None, keys: tuple[str, ...] = ("code", "date"), needed: tuple[str, ...] = ("code", "date", "close")) -> DataFrame:
    """Rows of Parquet and CSV files (by their names' ends) as one panel with every column that any of them has; of rows with
    one key the last path's counts. Files without a needed column are an error; rows without a key go."""
    frames = []
    for k, path in enumerate(paths):
        rows = spark.read.option("header", True).csv(path) if path.rstrip("/").endswith((".csv", ".csv.gz")) else spark.read.parquet(path)
        renames = {h: name for name, headers in (columns or {}).items() for h in headers if h in rows.columns and name not in rows.columns}
        rows = require_columns(rows.withColumnsRenamed(renames), list(needed))
        texts = {c: (F.col(c).try_cast("date") if c == "date" else F.col(c).cast("string") if c == "code" else F.col(c).try_cast("double")).alias(c) for c in rows.columns}
        frames.append(rows.select(*texts.values()).withColumn("__path", F.lit(k)))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    every = every.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in keys)))
    last = Window.partitionBy(*keys).orderBy(F.desc("__path"))
    return nan_to_null(every.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__path"))


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; times as ISO text, so that what is read is what was written."""
    df.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line; missing values are written as null."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified, bytes, day) of files below a folder whose name matches; ``day`` is the date that the name bears. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), report_date(F.element_at(F.split("path", "/"), -1)).alias("day"))


def newest(spark: SparkSession, path: str, n: int, pattern: str = "*.parquet") -> list[str]:
    """The last ``n`` files by name."""
    return [r["path"] for r in files(spark, path, pattern).select("path").orderBy(F.desc("path")).limit(n).collect()]


def freshness(spark: SparkSession, path: str, today: str, tolerance: int = 2, pattern: str = "*") -> DataFrame:
    """One row: files, bytes, the latest day in a name (or else of a change), ``age_days``, ``status`` (ok, stale, missing)."""
    found = files(spark, path, pattern).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.coalesce(F.max("day"), F.max(F.to_date("modified"))).alias("last"))
    age = F.datediff(F.lit(today).cast("date"), F.col("last"))
    return found.withColumn("age_days", age).withColumn("status", F.when(F.col("files") == 0, "missing").when(F.col("age_days") <= tolerance, "ok").otherwise("stale"))


def delete_version(spark: SparkSession, path: str, version: str) -> bool:
    """Remove one version of a versioned table, in whatever store Spark reaches; false if there was none."""
    if not version or "/" in version or version in (".", ".."):
        raise ValueError(f"bad version: {version!r}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/version={version}")
    return bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True))
