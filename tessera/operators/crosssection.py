"""Operators across keys at one time: ranks, scores, winsorising, neutralising, buckets, top lists, blends."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import average_rank, clip, pct_rank, safe_div, zscore


def ranked(df: DataFrame, value: str, time: str = "date", key: str = "code") -> DataFrame:
    """``pct`` (average ties), ``place`` (descending, ties by key) and ``decile`` (0..9 by floor of pct)."""
    place = F.row_number().over(Window.partitionBy(time).orderBy(F.col(value).desc_nulls_last(), key))
    out = df.withColumn("pct", pct_rank(value, [time])).withColumn("place", place)
    return out.withColumn("decile", F.when(F.col("pct").isNotNull(), F.floor(F.least(F.col("pct"), F.lit(0.999999)) * 10).cast("bigint")))


def quantile_groups(df: DataFrame, value: str, q: int, time: str = "date") -> DataFrame:
    """``group`` 0..q-1 by linear quantile edges, right-closed, equal edges merged."""
    edges = df.groupBy(time).agg(F.array_distinct(F.percentile(value, F.lit([k / q for k in range(q + 1)]))).alias("__edges"))
    rows = df.join(edges, time)
    below = F.size(F.filter("__edges", lambda e: e < F.col(value)))
    return rows.withColumn("group", F.when(F.col(value).isNotNull(), F.greatest(below - 1, F.lit(0)).cast("bigint"))).drop("__edges")


def even_groups(df: DataFrame, value: str, q: int, time: str = "date", key: str = "code") -> DataFrame:
    """Sizes that differ by one at most, larger groups first, as an array split makes them."""
    w = Window.partitionBy(time).orderBy(value, key)
    return df.where(F.col(value).isNotNull()).withColumn("group", F.ntile(q).over(w))


def mad_winsorize(df: DataFrame, value: str, n: float = 3.0, time: str = "date") -> DataFrame:
    """``value`` held to its date's median +- n * 1.4826 * MAD; unchanged where the MAD is 0."""
    middle = df.groupBy(time).agg(F.percentile(value, F.lit(0.5)).alias("__mid"))
    rows = df.join(middle, time)
    spread = rows.groupBy(time).agg(F.percentile(F.abs(F.col(value) - F.col("__mid")), F.lit(0.5)).alias("__mad"))
    rows = rows.join(spread, time)
    reach = F.col("__mad") * 1.4826 * n
    held = F.least(F.greatest(F.col(value), F.col("__mid") - reach), F.col("__mid") + reach)
    return rows.withColumn("winsorized", F.when(F.col(value).isNotNull(), F.when(F.col("__mad") > 0, held).otherwise(F.col(value)))).drop("__mid", "__mad")


def quantile_winsorize(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99, time: str = "date") -> DataFrame:
    ends = df.groupBy(time).agg(F.percentile(value, F.lit([low, high])).alias("__ends"))
    rows = df.join(ends, time)
    held = F.least(F.greatest(F.col(value), F.col("__ends")[0]), F.col("__ends")[1])
    return rows.withColumn("winsorized", F.when(F.col(value).isNotNull(), held)).drop("__ends")


def standardized(df: DataFrame, value: str, time: str = "date") -> DataFrame:
    """Population score held to +-3 (0 without spread), and one that is missing below three values."""
    return df.withColumn("z", zscore(value, [time], 0, 3.0)).withColumn("z_strict", zscore(value, [time], 0, None, 3, None))


def demeaned(df: DataFrame, value: str, group: str, time: str = "date", least: int = 3) -> DataFrame:
    """Less the mean of its group on its date; missing in groups below ``least``."""
    w = Window.partitionBy(time, group)
    return df.withColumn("neutral", F.when(F.count(value).over(w) >= least, F.col(value) - F.avg(value).over(w)))


def residual(df: DataFrame, value: str, size: str, group: str, time: str = "date", least: int = 5) -> DataFrame:
    """What is left of ``value`` after group dummies and ln(size), jointly, per date (both are demeaned by
    group, then one slope). Groups of one are dropped; missing on dates with fewer than ``least`` rows."""
    known = df.where(F.col(value).isNotNull() & (F.col(size) > 0) & F.col(group).isNotNull()).withColumn("__x", F.log(size))
    g, d = Window.partitionBy(time, group), Window.partitionBy(time)
    rows = known.withColumn("__n", F.count("*").over(g)).where("__n > 1")
    rows = rows.withColumn("__y", F.col(value) - F.avg(value).over(g)).withColumn("__x", F.col("__x") - F.avg("__x").over(g))
    slope = safe_div(F.sum(F.col("__x") * F.col("__y")).over(d), F.sum(F.col("__x") * F.col("__x")).over(d))
    left = F.when(F.count("*").over(d) >= least, F.col("__y") - F.coalesce(slope, F.lit(0.0)) * F.col("__x"))
    return rows.withColumn("residual", left).drop("__n", "__x", "__y")


def sequential_neutral(df: DataFrame, value: str, size: str, group: str, time: str = "date", least: int = 20) -> DataFrame:
    """Demean by group, then take a straight line in ln(1 + size) out, one after the other."""
    rows = df.withColumn("__y", F.col(value) - F.avg(value).over(Window.partitionBy(time, group))).withColumn("__x", F.log1p(size))
    d = Window.partitionBy(time)
    line = F.regr_intercept("__y", "__x").over(d) + F.regr_slope("__y", "__x").over(d) * F.col("__x")
    return rows.withColumn("neutral", F.when(F.count("__y").over(d) > least, F.col("__y") - line).otherwise(F.col("__y"))).drop("__x", "__y")


def orthogonalized(df: DataFrame, columns: list[str], time: str = "date", least: int = 30) -> DataFrame:
    """``<column>_orth``: each column less its least-squares fit on the ones before it, per date; unchanged on
    dates with fewer than ``least`` complete rows."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{c}_orth` double" for c in columns)])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows[columns].to_numpy(float)
        out = x.copy()
        whole = np.isfinite(x).all(1)
        if whole.sum() >= least:
            done = [np.ones(int(whole.sum()))]
            for k in range(len(columns)):
                base = np.column_stack(done)
                y = x[whole, k]
                left = y - base @ np.linalg.lstsq(base, y, rcond=None)[0]
                out[whole, k] = left if k else y
                done.append(out[whole, k])
        return rows.assign(**{f"{c}_orth": out[:, k] for k, c in enumerate(columns)})

    return df.groupBy(time).applyInPandas(run, schema)


def masked(df: DataFrame, columns: list[str], mask: Column) -> DataFrame:
    """Missing where ``mask`` holds (limit moves, suspensions)."""
    return df.withColumns({c: F.when(~F.coalesce(mask, F.lit(False)), F.col(c)) for c in columns})


def cooled(df: DataFrame, idle: Column, least_run: int, rest: int, key: str = "code", time: str = "date") -> DataFrame:
    """``resting`` on the ``rest`` rows after every run of at least ``least_run`` idle rows."""
    w = Window.partitionBy(key).orderBy(time)
    rows = df.withColumn("__idle", F.coalesce(idle, F.lit(False))).withColumn("__row", F.row_number().over(w))
    rows = rows.withColumn("__part", F.sum(F.when(F.col("__idle"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.sum(F.col("__idle").cast("int")).over(Window.partitionBy(key, "__part"))
    last = F.when(F.col("__idle") & (length >= least_run), F.col("__row"))
    ended = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("resting", F.coalesce(~F.col("__idle") & (F.col("__row") - ended <= rest), F.lit(False)))
    return rows.drop("__idle", "__row", "__part")


def top_n(df: DataFrame, score: str, n: int, group: str | None = None, cap: int | None = None, time: str = "date", key: str = "code") -> DataFrame:
    """The n best of each date, at most ``cap`` of a group; ties by key."""
    order = [F.col(score).desc(), F.col(key)]
    rows = df.where(F.col(score).isNotNull())
    if group is not None:
        rows = rows.withColumn("__in", F.row_number().over(Window.partitionBy(time, group).orderBy(*order))).where(F.col("__in") <= (cap or n)).drop("__in")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(time).orderBy(*order))).where(F.col("place") <= n)


def rank_blend(df: DataFrame, columns: dict[str, int], time: str = "date") -> DataFrame:
    """``blend``: mean of pct ranks, each turned by its direction; missing if any is."""
    parts = [pct_rank(F.col(c) * d, [time]) for c, d in columns.items()]
    return df.withColumn("blend", sum(parts[1:], parts[0]) / len(parts))


def z_blend(df: DataFrame, weights: dict[str, float], time: str = "date") -> DataFrame:
    """``blend``: population scores weighted by shares of the absolute weights; equal weights if all are 0."""
    total = sum(abs(w) for w in weights.values())
    share = {c: (w / total if total else 1 / len(weights)) for c, w in weights.items()}
    parts = [zscore(c, [time]) * w for c, w in share.items()]
    return df.withColumn("blend", sum(parts[1:], parts[0]))


def directed(df: DataFrame, meta: DataFrame, name: str = "factor", value: str = "value") -> DataFrame:
    """Values times the direction (+1 or -1) that ``meta`` (name, direction) gives their factor."""
    return df.join(meta, name, "left").withColumn(value, F.col(value) * F.coalesce("direction", F.lit(1))).drop("direction")


def processed(df: DataFrame, value: str, group: str, time: str = "date") -> DataFrame:
    """The usual chain: MAD winsorise, demean by group, score, and fill what is missing with the date's median."""
    rows = mad_winsorize(df, value, time=time)
    rows = demeaned(rows, "winsorized", group, time, least=1).withColumn("score", zscore("neutral", [time]))
    middle = rows.groupBy(time).agg(F.percentile("score", F.lit(0.5)).alias("__mid"))
    return rows.join(middle, time).withColumn("score", F.coalesce("score", "__mid")).drop("__mid")


def positive_scores(df: DataFrame, value: str, time: str = "date") -> DataFrame:
    """Percentile and score among positive values; 0 for the rest."""
    good = F.when(F.col(value) > 0, F.col(value))
    rows = df.withColumn("__good", good)
    return rows.withColumn("positive_pct", F.coalesce(pct_rank("__good", [time]), F.lit(0.0))).withColumn("positive_z", F.coalesce(clip(zscore("__good", [time]), -3.0, 3.0), F.lit(0.0))).drop("__good")


__all__ = [n for n, v in list(globals().items()) if callable(v) and getattr(v, "__module__", None) == __name__] + ["average_rank"]
