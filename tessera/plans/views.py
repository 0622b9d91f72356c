"""A small filter language over tables and views, and the analytics views."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.catalog import quoted


def predicates(filters: Mapping[str, Any]) -> list[Column]:
    """``col`` equals (a list: is in; None: is missing; an empty list asks nothing), ``col__gte``, ``__lte``,
    ``__gt``, ``__lt``, and ``__between`` with a pair."""
    out = []
    for name, value in filters.items():
        column, _, how = name.partition("__")
        c = F.col(quoted(column))
        if how == "between":
            if not isinstance(value, (list, tuple)) or len(value) != 2:
                raise ValueError(f"{name} needs a pair")
            out.append(c.between(*value))
        elif how:
            tests = {"gte": c >= F.lit(value), "lte": c <= F.lit(value), "gt": c > F.lit(value), "lt": c < F.lit(value)}
            if how not in tests:
                raise ValueError(f"unknown filter {name}")
            out.append(tests[how])
        elif value is None:
            out.append(c.isNull())
        elif isinstance(value, (list, tuple, set)):
            if value:
                out.append(c.isin(list(value)))
        else:
            out.append(c == F.lit(value))
    return out


def query_view(df: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    for p in predicates(filters):
        df = df.where(p)
    return df


def factor_summary(df: DataFrame) -> DataFrame:
    """Per factor of (factor, symbol, date, value): counts, range of dates, moments."""
    return df.groupBy("factor").agg(
        F.count("value").alias("n"), F.countDistinct("symbol").alias("symbols"), F.min("date").alias("first"), F.max("date").alias("last"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"),
    )


def latest_factor(df: DataFrame) -> DataFrame:
    """Rows of each factor's last date."""
    last = df.groupBy("factor").agg(F.max("date").alias("date"))
    return df.join(last, ["factor", "date"], "left_semi")


def performance_view(df: DataFrame) -> DataFrame:
    """Per strategy: mean and summed return, benchmark, and their difference (summed, not compounded)."""
    return df.groupBy("strategy").agg(F.avg("ret").alias("mean_ret"), F.sum("ret").alias("sum_ret"), F.avg("bench").alias("mean_bench"), F.sum(F.col("ret") - F.col("bench")).alias("excess"))


def ic_summary_view(df: DataFrame) -> DataFrame:
    """Per factor of (factor, date, rank_ic, icir, n_stocks): periods, their range, and means."""
    return df.groupBy("factor").agg(
        F.count("*").alias("n_periods"), F.min("date").alias("first"), F.max("date").alias("last"),
        F.avg("rank_ic").alias("avg_rank_ic"), F.avg("icir").alias("avg_icir"), F.avg("n_stocks").alias("avg_n_stocks"),
    )


def latest_rows(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows of the table's last date."""
    return df.join(F.broadcast(df.agg(F.max(date).alias(date))), date, "left_semi")  # one row


def select(spark: SparkSession, text: str, tables: Mapping[str, DataFrame], args: list | tuple = ()) -> DataFrame:
    """Run a query with ``?`` parameters over named tables and views. Values only reach it as parameters."""
    if text.split(None, 1)[0].lower() not in ("select", "with"):
        raise ValueError("only queries are allowed")
    for name, rows in tables.items():
        rows.createOrReplaceTempView(quoted(name))
    return spark.sql(text, args=list(args)) if args else spark.sql(text)
