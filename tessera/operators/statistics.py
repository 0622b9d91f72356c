"""Statistics: outliers, quality scores, seasonality, regimes, transitions, similar days, volume profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import average_rank, corr, ordered, pct_change, rolling, safe_div, trailing


def outliers(df: DataFrame, value: str, by: str) -> DataFrame:
    """Score, MAD score (0.6745) and IQR fences (1.5) of each value in its group."""
    mid = df.groupBy(by).agg(F.percentile(value, F.lit([0.25, 0.5, 0.75])).alias("q"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    rows = df.join(mid, by)
    mad = rows.groupBy(by).agg(F.percentile(F.abs(F.col(value) - F.col("q")[1]), F.lit(0.5)).alias("mad"))
    rows = rows.join(mad, by)
    iqr = F.col("q")[2] - F.col("q")[0]
    beyond = (F.col(value) < F.col("q")[0] - 1.5 * iqr) | (F.col(value) > F.col("q")[2] + 1.5 * iqr)
    return rows.withColumn("z", safe_div(F.col(value) - F.col("mean"), "std")).withColumn("mad_z", 0.6745 * safe_div(F.col(value) - F.col("q")[1], "mad")).withColumn("beyond", beyond).drop("q", "mean", "std", "mad")


def quality_score(df: DataFrame, key: str = "code", time: str = "date", value: str = "close", gap: int = 21) -> DataFrame:
    """Per key: 1 less the share of failed checks: missing values, prices not above 0, moves beyond 30 %, gaps."""
    w = ordered(key, time)
    move, days = pct_change(value, w), F.datediff(time, F.lag(time).over(w))
    rows = df.select(key, F.col(value).isNull().alias("a"), (F.col(value) <= 0).alias("b"), (F.abs(move) > 0.3).alias("c"), (days > gap).alias("d"))
    issues = F.sum(sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in "bcd"), F.col("a").cast("int")))
    return rows.groupBy(key).agg(F.count("*").alias("rows"), issues.alias("issues")).withColumn("score", 1 - F.col("issues") / (F.col("rows") * 4))


def spikes(df: DataFrame, value: str, n: int, threshold: float, key: str = "code", time: str = "date") -> DataFrame:
    """Rows whose value is above ``threshold`` times the mean of the n before."""
    mean = F.avg(value).over(ordered(key, time).rowsBetween(-n, -1))
    return df.withColumn("ratio", safe_div(value, mean)).where(F.col("ratio") > threshold)


def calendar_effect(df: DataFrame, ret: str, bucket: Column) -> DataFrame:
    """Mean, win rate, deviation, median and count of returns per calendar bucket."""
    rows = df.where(F.col(ret).isNotNull()).withColumn("bucket", bucket)
    return rows.groupBy("bucket").agg(F.avg(ret).alias("mean"), F.avg((F.col(ret) > 0).cast("double")).alias("win_rate"), F.stddev_samp(ret).alias("std"), F.percentile(ret, F.lit(0.5)).alias("median"), F.count("*").alias("n"))


def regimes(df: DataFrame, value: str, n: int = 20, long: int = 40, by: str = "code", time: str = "date") -> DataFrame:
    """Trend (above or below the long mean), volatility (above its own trailing 80 % quantile) and both as a name."""
    w = ordered(by, time)
    rows = df.withColumn("__r", pct_change(value, w)).withColumn("mean", rolling(value, "mean", w, long)).withColumn("vol", rolling("__r", "std", w, n))
    edge = F.percentile("vol", F.lit(0.8)).over(trailing(w, long))
    rows = rows.withColumn("edge", F.when(F.count("vol").over(trailing(w, long)) >= n, edge))
    name = F.when(F.col("mean").isNull() | F.col("edge").isNull(), "unknown").when(F.col(value) > F.col("mean"), F.when(F.col("vol") <= F.col("edge"), "calm_up").otherwise("wild_up")).otherwise(F.when(F.col("vol") <= F.col("edge"), "calm_down").otherwise("wild_down"))
    return rows.withColumn("regime", name).drop("__r")


def stages(df: DataFrame) -> DataFrame:
    """Stage of each day from counts ``up``, ``top``, ``broken_share`` and ``losers``: the first rule that holds."""
    stage = (
        F.when((F.col("up") >= 100) & (F.col("top") >= 5), "climax").when(F.col("broken_share") >= 0.35, "divergence").when(F.col("losers") >= 15, "divergence")
        .when((F.col("up") <= 35) & (F.col("top") <= 2), "ice").when(F.col("up") <= 30, "ice").when(F.col("up") >= 60, "ferment").otherwise("repair")
    )
    return df.withColumn("stage", stage)


def transitions(df: DataFrame, state: str, time: str, by: str | None = None) -> DataFrame:
    """Share of each next state after each state."""
    w = Window.partitionBy(*([by] if by else [])).orderBy(time)
    rows = df.select(F.col(state).alias("now"), F.lead(state).over(w).alias("next")).where("next is not null")
    counts = rows.groupBy("now", "next").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("now")))


def similar_days(df: DataFrame, features: list[str], k: int, skip: int, time: str = "date") -> DataFrame:
    """The k past rows nearest to the last one in scored features, the last ``skip`` left out; one row per time."""
    stats = df.agg(*(F.avg(c).alias(f"m_{c}") for c in features), *(F.stddev_pop(c).alias(f"s_{c}") for c in features))
    last = df.orderBy(F.desc(time)).limit(1).select(F.col(time).alias("__now"), *(F.col(c).alias(f"x_{c}") for c in features))
    rows = df.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(last))  # one row each
    terms = [F.coalesce(F.pow(safe_div(F.col(c) - F.col(f"x_{c}"), f"s_{c}"), 2), F.lit(0.0)) for c in features]
    place = F.row_number().over(Window.orderBy(F.desc(time)))
    rows = rows.withColumn("__place", place).where(F.col("__place") > skip).withColumn("distance", sum(terms[1:], terms[0]))
    return rows.orderBy("distance", time).limit(k).select(time, "distance", (1 / (1 + F.col("distance"))).alias("similarity"))


def volume_profile(df: DataFrame, step: float, key: str = "code") -> DataFrame:
    """Volume per logarithmic price cell: a bar's volume is spread evenly over the cells that it touches; ``peak``
    marks the fullest cell of a key. Bars are dealt by key before they are spread, so that a task adds up its keys' cells at once."""
    width = F.log(F.lit(1.0 + step))
    low, high = F.floor(F.log("low") / width).cast("bigint"), F.floor(F.log("high") / width).cast("bigint")
    bars = df.select(key, low.alias("low"), high.alias("high"), (F.col("volume") / (high - low + 1)).alias("v")).repartition(key)
    cells = bars.select(key, F.explode(F.sequence("low", "high")).alias("cell"), "v")
    out = cells.groupBy(key, "cell").agg(F.sum("v").alias("volume"))
    w = Window.partitionBy(key)
    return out.withColumn("share", safe_div("volume", F.sum("volume").over(w))).withColumn("peak", F.row_number().over(w.orderBy(F.round("volume", 6).desc(), "cell")) == 1)


def relative_strength(df: DataFrame, n: int = 20, key: str = "code", time: str = "date") -> DataFrame:
    """Price over the mean price of its time, its mean over n rows, the slope of the last five means, new highs."""
    w = ordered(key, time)
    rows = df.withColumn("bench", F.avg("close").over(Window.partitionBy(time))).withColumn("rs", safe_div("close", "bench")).withColumn("rs_mean", rolling("rs", "mean", w, n)).withColumn("__k", F.row_number().over(w).cast("double"))
    slope = F.when(F.count("rs_mean").over(trailing(w, 5)) >= 5, F.regr_slope("rs_mean", "__k").over(trailing(w, 5)))
    return rows.withColumn("rs_slope", slope).withColumn("new_high", F.col("rs") >= F.max("rs").over(trailing(w, 60))).drop("__k")


def lagged_correlation(df: DataFrame, x: str, y: str, lags: int, key: str = "code", time: str = "date") -> DataFrame:
    """Correlation of x with y k rows later, over all keys."""
    w = ordered(key, time)
    rows = df.select(x, *(F.lead(y, k).over(w).alias(f"y{k}") for k in range(lags + 1)))
    out = rows.agg(*(corr(x, f"y{k}").alias(f"y{k}") for k in range(lags + 1)))
    return out.unpivot([], [f"y{k}" for k in range(lags + 1)], "lag", "corr").withColumn("lag", F.substring("lag", 2, 3).cast("int"))


def drift(df: DataFrame, right: str, recent: int, by: str, time: str, threshold: float = -0.05) -> DataFrame:
    """Accuracy of the last ``recent`` predictions less that of all before them."""
    rows = df.withColumn("__p", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(time))))
    hit = F.col(right).cast("double")
    out = rows.groupBy(by).agg(F.avg(F.when(F.col("__p") <= recent, hit)).alias("recent"), F.avg(F.when(F.col("__p") > recent, hit)).alias("prior"), F.count("*").alias("n"))
    change = F.col("recent") - F.col("prior")
    status = F.when(F.col("n") < 2 * recent, "insufficient_samples").when(change < threshold, "drift").otherwise("stable")
    return out.withColumn("change", change).withColumn("status", status)


def bootstrap_mean(df: DataFrame, value: str, by: str, draws: int, seed: int = 7) -> DataFrame:
    """Percentile interval of the mean from Poisson resampling: each row counts Poisson(1) times in each draw."""
    reps = df.where(F.col(value).isNotNull()).select(by, value, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    u = F.rand(seed)
    times = sum(((F.col("__u") > edge).cast("int") for edge in (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941)), F.lit(0))
    drawn = reps.withColumn("__u", u).withColumn("__n", times)
    means = drawn.groupBy(by, "draw").agg(safe_div(F.sum(F.col(value) * F.col("__n")), F.sum("__n")).alias("m"))
    return means.groupBy(by).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.count("m").alias("draws"))


def ladder(df: DataFrame, board: str, time: str, broken: str, later: str) -> DataFrame:
    """Per time: names, highest board, broken share, mean later move, big losses, and mean of three times."""
    out = df.groupBy(time).agg(F.count("*").alias("n"), F.max(board).alias("top"), F.avg(F.col(broken).cast("double")).alias("broken_share"), F.avg(later).alias("premium"), F.count_if(F.col(later) < -0.5).alias("losses"))
    return out.withColumn("n_3", F.avg("n").over(Window.orderBy(time).rowsBetween(-2, 0)))  # one row per time


__all__ = [n for n, v in list(globals().items()) if callable(v) and getattr(v, "__module__", None) == __name__] + ["average_rank"]


def price_anomalies(df: DataFrame, close: str = "close", key: str = "code", time: str = "date", limit: float = 4.0, error: float = 15.0, least: int = 10) -> DataFrame:
    """Returns in percent that are over ``limit`` deviations (ddof 0) from their key's mean, and whether they are
    so large that an error is likely; keys with fewer than ``least`` prices are left out."""
    rows = df.where(F.col(close).isNotNull()).withColumn("__before", F.lag(close).over(ordered(key, time))).withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    rows = rows.where((F.col("__n") >= least) & F.col("__before").isNotNull()).withColumn("pct", F.coalesce((safe_div(close, "__before") - 1) * 100, F.lit(0.0)))
    everything = Window.partitionBy(key)
    spread = F.stddev_pop("pct").over(everything)
    z = (F.col("pct") - F.avg("pct").over(everything)) / F.when(spread > 0, spread).otherwise(1.0)
    return rows.select(key, time, "pct", z.alias("z")).where(F.abs("z") > limit).withColumn("likely_error", F.abs("pct") > error)
