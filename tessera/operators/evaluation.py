"""How good a factor is: information coefficients, quantile spreads, turnover, decay, calibration, regressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import average_rank, corr, ordered, pct_rank, safe_div, trailing, zscore
from tessera.operators.rolled import Tables, in_tables


#: Parts that rows are dealt to by time before they are ranked: a task holds a few times at once. Up to 200 parts Spark writes
#: a shuffle straight to a file a part, with nothing held or spilled.
TIMES = 200


def rank_ic(df: DataFrame, factor: str, label: str, time: str = "date", least: int = 30, by: tuple[str, ...] = ()) -> DataFrame:
    """Per time (and ``by``): correlation of average ranks over jointly known rows, and their number."""
    group = [*by, time]
    rows = df.where(F.col(factor).isNotNull() & F.col(label).isNotNull()).select(*group, factor, label).repartition(TIMES, *group)
    rows = rows.withColumn("__f", average_rank(factor, group)).withColumn("__l", average_rank(label, group))
    return rows.groupBy(*group).agg(corr("__f", "__l").alias("ic"), F.count("*").alias("n")).where(F.col("n") >= least)


def _ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks; NaN are equal and the largest."""
    order = np.argsort(x)
    y = x[order]
    new = np.concatenate(([True], (y[1:] != y[:-1]) & ~(np.isnan(y[1:]) & np.isnan(y[:-1]))))
    first = np.flatnonzero(new)
    ends = np.append(first[1:], len(x))
    out = np.empty(len(x))
    out[order] = ((first + 1 + ends) / 2)[np.cumsum(new) - 1]
    return out


#: A missing value among doubles, as NaN is a value.
MISSING = 0x7FF8_0000_0000_DEAD


def dealt(sets: list[list[str]], time: str, kind: str, known: str | None = None, signs: dict[str, int] | None = None) -> tuple[Callable[[Tables], Tables], str]:
    """Tables to one row per time and set of columns, and their schema: the columns' doubles one after the other as bytes, the first byte of
    all before the second, which packs better. So a shuffle by time moves blocks instead of rows. Rows without ``known`` are left out;
    columns are multiplied by their ``signs``."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    places = [[columns.index(c) for c in s] for s in sets]

    def run(tables: Tables) -> Tables:
        for table in tables:
            if known:
                table = table.filter(table.column(known).is_valid())
            if not table.num_rows:
                continue
            times = table.column(time).combine_chunks()
            codes = times.dictionary_encode(null_encoding="encode").indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(order)]))
            values = np.empty((len(columns), len(order)))
            for k, c in enumerate(columns):
                column = table.column(c)
                x = column.to_numpy().astype(float) * (signs or {}).get(c, 1)
                x.view(np.int64)[~column.is_valid().to_numpy()] = MISSING
                values[k] = x[order]
            packed = [values[at, a:b].ravel().view(np.uint8).reshape(-1, 8).T.tobytes() for at in places for a, b in cuts]
            yield pa.table({
                time: times.take(pa.array(np.tile(order[starts], len(sets)))), "set": pa.array(np.repeat(np.arange(len(sets), dtype=np.int32), len(cuts))), "values": pa.array(packed, pa.binary())})

    return run, f"`{time}` {kind}, `set` int, `values` binary"


def _taken(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of a time's blocks, a row for each of ``width`` columns, and which are known."""
    parts = [np.ascontiguousarray(np.frombuffer(v, np.uint8).reshape(8, -1).T).view(float).reshape(width, -1) for v in (x.as_buffer() for x in table.column("values"))]
    x = np.concatenate(parts, 1)
    return x, x.view(np.int64) != MISSING


def _rank_corr(a: np.ndarray, b: np.ndarray) -> float | None:
    a, b = a - a.mean(), b - b.mean()
    spread = np.sqrt(np.mean(a * a)) * np.sqrt(np.mean(b * b))
    return float(np.mean(a * b) / spread) if spread else None


def _ranked(df: DataFrame, columns: list[str], time: str, to: tuple[Callable[[Tables], Tables], str]) -> DataFrame:
    stage, schema = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in stage(in_tables(batches)):
            yield from table.to_batches()

    return df.select(time, *(F.col(c).cast("double").alias(c) for c in columns)).mapInArrow(run, schema)


def sets_of(factors: list[str], label: str, width: int) -> list[list[str]]:
    """``width`` factors at a time, and the label."""
    return [[*factors[k : k + width], label] for k in range(0, len(factors), width)]


def rank_ics(df: DataFrame, factors: list[str], label: str, time: str = "date", least: int = 30, width: int = 25, parts: int = TIMES) -> DataFrame:
    """``rank_ic`` of many columns, by ``factor``. ``width`` columns of a time go to one task side by side with the label, so
    that every value moves once, in eight bytes; a group holds one time's rows of these columns."""
    sets = sets_of(factors, label, width)
    return rank_ics_of(_ranked(df, [label, *factors], time, dealt(sets, time, df.schema[time].dataType.simpleString(), known=label)), sets, time, least, parts)


def rank_ics_of(blocks: DataFrame, sets: list[list[str]], time: str = "date", least: int = 30, parts: int = TIMES) -> DataFrame:
    """``rank_ics`` of what ``dealt`` made of sets whose last column is the label."""

    def run(table: pa.Table) -> pa.Table:
        names = sets[table.column("set")[0].as_py()]
        x, known = _taken(table, len(names))
        found, rows, ranks = [], None, None
        for k, name in enumerate(names[:-1]):
            on = known[k] & known[-1]
            n = int(on.sum())
            if n < least:
                continue
            if rows is None or not np.array_equal(on, rows):  # factors of one horizon mostly know the same rows
                rows, ranks = on, _ranks(x[-1, on])
            found.append((name, _rank_corr(_ranks(x[k, on]), ranks), n))
        return pa.table({time: table.column(time)[:1].take(pa.array([0] * len(found), pa.int64())), "factor": pa.array([f[0] for f in found], pa.string()), "ic": pa.array([f[1] for f in found], pa.float64()), "n": pa.array([f[2] for f in found], pa.int64())})

    kind = blocks.schema[time].dataType.simpleString()
    return blocks.repartition(parts, time, "set").groupBy(time, "set").applyInArrow(run, f"`{time}` {kind}, factor string, ic double, n bigint")


def rank_correlations(blocks: DataFrame, columns: list[str], time: str = "date", parts: int = TIMES) -> DataFrame:
    """(time, a, b, rho, n) of what ``dealt`` made of one set of columns, the last one the label: for each pair of factors the correlation
    of their ranks among all rows, as ``factor_correlation`` has it, and for each factor and the label that of their ranks among the n
    rows that know both, as ``rank_ic`` has it. A group holds one time's rows. Without spread there is no row."""

    def run(table: pa.Table) -> pa.Table:
        x, known = _taken(table, len(columns))
        ranks = np.full(x.shape, np.nan)
        for k in range(len(columns) - 1):
            if known[k].any():
                ranks[k, known[k]] = _ranks(x[k, known[k]])
        found = []
        for k, a in enumerate(columns[:-1]):
            for j, b in enumerate(columns[k + 1 :], k + 1):
                on = known[k] & known[j]
                n = int(on.sum())
                two = (_ranks(x[k, on]), _ranks(x[j, on])) if n and j == len(columns) - 1 else (ranks[k, on], ranks[j, on])
                rho = _rank_corr(*two) if n else None
                if rho is not None:
                    found.append((a, b, rho, n))
        kinds = (pa.string(), pa.string(), pa.float64(), pa.int64())
        return pa.table({time: table.column(time)[:1].take(pa.array([0] * len(found), pa.int64()))} | {c: pa.array([f[k] for f in found], kind) for k, (c, kind) in enumerate(zip(("a", "b", "rho", "n"), kinds))})

    kind = blocks.schema[time].dataType.simpleString()
    return blocks.repartition(parts, time).groupBy(time).applyInArrow(run, f"`{time}` {kind}, a string, b string, rho double, n bigint")


def pearson_ic(df: DataFrame, factor: str, label: str, time: str = "date", least: int = 30) -> DataFrame:
    rows = df.where(F.col(factor).isNotNull() & F.col(label).isNotNull())
    return rows.groupBy(time).agg(corr(factor, label).alias("ic"), F.count("*").alias("n")).where(F.col("n") >= least)


def ic_summary(ic: DataFrame, by: tuple[str, ...] = (), periods: int = 252) -> DataFrame:
    """Mean, sample deviation, ratio, annualised ratio (0 below five values), share above zero, t-value."""
    out = ic.where("ic is not null").groupBy(*by).agg(F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.count("*").alias("n"), F.avg((F.col("ic") > 0).cast("double")).alias("win_rate"))
    ratio = safe_div("mean", "std")
    return out.withColumn("ir", ratio).withColumn("ir_annual", F.when(F.col("n") >= 5, ratio * float(np.sqrt(periods))).otherwise(0.0)).withColumn("t", ratio * F.sqrt("n"))


def rolling_ic(ic: DataFrame, n: int = 60, least: int = 30, time: str = "date") -> DataFrame:
    """Trailing mean and t-value of a series of coefficients: one row per time."""
    frame = trailing(Window.orderBy(time), n)
    count, mean, std = F.count("ic").over(frame), F.avg("ic").over(frame), F.stddev_samp("ic").over(frame)
    return ic.withColumn("rolling_mean", F.when(count >= least, mean)).withColumn("rolling_t", F.when(count >= least, safe_div(mean, std) * F.sqrt(count)))


def quantile_returns(df: DataFrame, factor: str, label: str, q: int = 5, time: str = "date") -> DataFrame:
    """Mean label of each bucket of the factor's pct rank per time."""
    rows = df.where(F.col(factor).isNotNull() & F.col(label).isNotNull())
    rows = rows.withColumn("bucket", F.floor(F.least(pct_rank(factor, [time]), F.lit(0.999999)) * q).cast("bigint"))
    return rows.groupBy(time, "bucket").agg(F.avg(label).alias("mean"), F.count("*").alias("n"))


def spread(df: DataFrame, factor: str, label: str, q: int = 5, time: str = "date") -> DataFrame:
    """Top bucket less bottom bucket per time."""
    buckets = quantile_returns(df, factor, label, q, time)
    top, bottom = (F.max(F.when(F.col("bucket") == k, F.col("mean"))) for k in (q - 1, 0))
    return buckets.groupBy(time).agg((top - bottom).alias("spread"))


def decay(df: DataFrame, factor: str, ret: str, lags: int, key: str = "code", time: str = "date", least: int = 30) -> DataFrame:
    """Mean rank coefficient of the factor with the return k rows later, k = 1..lags."""
    w = ordered(key, time)
    ahead = df.select(time, factor, *(F.lead(ret, k).over(w).alias(f"r{k}") for k in range(1, lags + 1)))
    long = ahead.unpivot([time, factor], [f"r{k}" for k in range(1, lags + 1)], "horizon", "later").withColumn("lag", F.substring("horizon", 2, 3).cast("int"))
    return rank_ic(long, factor, "later", time, least, ("lag",)).groupBy("lag").agg(F.avg("ic").alias("mean_ic"), F.count("*").alias("n"))


def turnover(df: DataFrame, factor: str, share: float = 0.2, key: str = "code", time: str = "date") -> DataFrame:
    """Part of the top share that wasn't in it at the time before, among names known at both."""
    times = df.select(time).distinct().withColumn("__before", F.lag(time).over(Window.orderBy(time)))
    rows = df.where(F.col(factor).isNotNull()).withColumn("__top", pct_rank(factor, [time]) > 1 - share).select(key, time, "__top")
    then = rows.select(key, F.col(time).alias("__before"), F.col("__top").alias("__was"))
    both = rows.join(times, time).join(then, [key, "__before"]).where("__top")
    return both.groupBy(time).agg((1 - F.avg(F.col("__was").cast("double"))).alias("turnover"), F.count("*").alias("n"))


def factor_correlation(df: DataFrame, factors: list[str], time: str = "date", least: int = 20) -> DataFrame:
    """Mean over times of the rank correlation of each pair of factors."""
    ranks = df.select(time, *(average_rank(c, [time]).alias(c) for c in factors))
    pairs = [(a, b) for k, a in enumerate(factors) for b in factors[k + 1 :]]
    each = ranks.groupBy(time).agg(*(corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    long = each.unpivot([time], [F.col(f"`{a}|{b}`") for a, b in pairs], "pair", "rho").where("rho is not null")
    out = long.groupBy("pair").agg(F.avg("rho").alias("rho"), F.count("*").alias("times")).where(F.col("times") >= least)
    return out.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "rho", "times")


def coverage(df: DataFrame, factors: list[str], key: str = "code", time: str = "date", least: int = 5) -> DataFrame:
    """Per factor: usable times, median and smallest number of keys, and PASS or BLOCK."""
    counts = df.groupBy(time).agg(*(F.count(c).alias(c) for c in factors)).unpivot([time], factors, "factor", "n")
    out = counts.groupBy("factor").agg(F.count_if(F.col("n") >= least).alias("usable"), F.percentile("n", F.lit(0.5)).alias("median_n"), F.min("n").alias("min_n"), F.count("*").alias("times"))
    return out.withColumn("status", F.when(F.col("usable") >= F.col("times") * 0.8, "PASS").otherwise("BLOCK"))


def holdout_diagnostics(df: DataFrame, factor: str, label: str, q: int = 5, split: float = 0.7, time: str = "date") -> DataFrame:
    """Bucket means before and after the split date, and how monotonic they are (rank correlation with the bucket)."""
    buckets = quantile_returns(df, factor, label, q, time)
    place = buckets.select(time).distinct().withColumn("__p", F.percent_rank().over(Window.orderBy(time)))
    rows = buckets.join(place, time).withColumn("part", F.when(F.col("__p") < split, "in").otherwise("out"))
    means = rows.groupBy("part", "bucket").agg(F.avg("mean").alias("mean")).withColumn("__r", average_rank("mean", ["part"]))
    return means.groupBy("part").agg(corr("__r", F.col("bucket").cast("double")).alias("monotonicity"), F.max(F.when(F.col("bucket") == q - 1, F.col("mean"))).alias("top"), F.max(F.when(F.col("bucket") == 0, F.col("mean"))).alias("bottom"))


def trailing_calibration(df: DataFrame, factor: str, label: str, known_on: str, q: int = 10, least: int = 20, time: str = "date") -> DataFrame:
    """Expected label per bucket as known at each realised date: the running mean of the bucket's daily means
    over dates whose label was known by then; missing before ``least`` of them. No look ahead."""
    rows = df.where(F.col(factor).isNotNull() & F.col(label).isNotNull() & F.col(known_on).isNotNull())
    rows = rows.withColumn("bucket", F.floor(F.least(pct_rank(factor, [time]), F.lit(0.999999)) * q).cast("bigint"))
    daily = rows.groupBy(time, "bucket").agg(F.avg(label).alias("m"), F.max(known_on).alias("realized"))
    known = daily.groupBy("realized", "bucket").agg(F.avg("m").alias("m"))
    frame = Window.partitionBy("bucket").orderBy("realized").rowsBetween(Window.unboundedPreceding, 0)
    return known.select("realized", "bucket", F.when(F.count("m").over(frame) >= least, F.avg("m").over(frame)).alias("expected"))


def fama_macbeth(df: DataFrame, label: str, factors: list[str], time: str = "date", least: int = 10) -> DataFrame:
    """Premium of each factor per time, from one least-squares fit of the label on all factors."""
    schema = ", ".join([f"`{time}` {df.schema[time].dataType.simpleString()}", "factor string, premium double, n bigint"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        good = rows[[label, *factors]].apply(pd.to_numeric).dropna()
        if len(good) < max(least, len(factors) + 2):
            return pd.DataFrame(columns=[time, "factor", "premium", "n"], dtype=object)
        x = np.column_stack([np.ones(len(good)), good[factors].to_numpy(float)])
        beta = np.linalg.lstsq(x, good[label].to_numpy(float), rcond=None)[0]
        return pd.DataFrame({time: rows[time].iloc[0], "factor": ["const", *factors], "premium": beta, "n": len(good)})

    return df.select(time, label, *factors).groupBy(time).applyInPandas(run, schema)


def premium_summary(premia: DataFrame, lags: int | None = None, time: str = "date") -> DataFrame:
    """Mean premium and its Newey-West t-value (Bartlett weights, 4 (T/100)^(2/9) lags unless given, however many
    these are). A factor's premia are one ordered array: one value per time."""
    series = premia.groupBy("factor").agg(F.avg("premium").alias("mean"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(time, "premium"))).alias("__all"))
    rows = series.withColumn("__e", F.transform("__all", lambda r: F.coalesce(r["premium"] - F.col("mean"), F.lit(0.0))))
    n, e = F.col("n"), F.col("__e")
    depth = (F.floor(4 * F.pow(n / 100, 2 / 9)) if lags is None else F.lit(lags)).cast("int")

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def at_lag(k: Column) -> Column:
        products = F.zip_with(F.slice(e, F.lit(1), n.cast("int") - k), F.slice(e, k + 1, n.cast("int") - k), lambda x, y: x * y)
        return total(products) * 2 * (1 - k / (depth + 1))

    used = F.filter(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda k: (k <= depth) & (k < n))
    omega = total(F.transform(e, lambda x: x * x)) + total(F.transform(used, at_lag))
    variance = F.greatest(omega / (n * n), F.lit(1e-12))
    return rows.select("factor", "mean", "n", (F.col("mean") / F.sqrt(variance)).alias("t"))


def four_gates(stats: DataFrame) -> DataFrame:
    """``status`` from n, ic, icir, win_rate and psi: the last matching rule of the ladder wins."""
    status = (
        F.when(F.col("psi") > 0.4, "inactive").when(F.col("n") < 30, "inactive").when(F.col("ic").isNull() | F.col("icir").isNull(), "inactive")
        .when((F.abs("ic") < 0.02) & (F.col("icir") < 0.3), "weak").when((F.col("win_rate") < 0.55) | (F.col("psi") > 0.25), "watch").otherwise("active")
    )
    return stats.withColumn("status", status)


def factor_return_volatility(df: DataFrame, factor: str, ret: str, window: int = 60, least: int | None = None, time: str = "date", names: int = 20) -> DataFrame:
    """Per date the mean of standardised factor times return (at least ``names`` rows), and its rolling deviation."""
    rows = df.where(F.col(factor).isNotNull() & F.col(ret).isNotNull())
    daily = rows.groupBy(time).agg(F.count("*").alias("n"), safe_div(F.covar_pop(factor, ret), F.stddev_samp(factor)).alias("spread")).where((F.col("n") >= names) & F.col("spread").isNotNull())
    w = Window.orderBy(time).rowsBetween(1 - window, 0)  # one row per date
    enough = F.count("spread").over(w) >= (least or max(5, window // 2))
    return daily.withColumn("volatility", F.when(enough, F.stddev_samp("spread").over(w))).select(time, "spread", "volatility")


def long_short_turnover(df: DataFrame, factor: str, share: float = 0.2, key: str = "code", time: str = "date", names: int = 15) -> DataFrame:
    """Per date: names that entered or left the top and bottom ``share`` since the date before, over the leg's
    size, both legs averaged. Dates with fewer than ``names`` names have no legs."""
    rows = df.where(F.col(factor).isNotNull()).select(key, time, factor)
    dates = rows.groupBy(time).agg(F.count("*").alias("n"), F.percentile(factor, F.lit(1 - share)).alias("top"), F.percentile(factor, F.lit(share)).alias("bottom"))
    dates = dates.withColumn("before", F.lag(F.when(F.col("n") >= names, F.col(time))).over(Window.orderBy(time)))  # one row per date
    legs = rows.join(dates.where(F.col("n") >= names), time).select(key, time, "before", (F.col(factor) >= F.col("top")).alias("long"), (F.col(factor) <= F.col("bottom")).alias("short")).where("long or short")
    past = legs.select(F.col(key), F.col(time).alias("before"), F.col("long").alias("was_long"), F.col("short").alias("was_short"))
    kept = legs.join(past, [key, "before"], "left")
    both = kept.groupBy(time, "before").agg(*(F.count_if(c).alias(n) for n, c in (("longs", F.col("long")), ("shorts", F.col("short")), ("same_longs", F.col("long") & F.col("was_long")), ("same_shorts", F.col("short") & F.col("was_short")))))
    sizes = both.select(F.col(time).alias("before"), F.col("longs").alias("were_longs"), F.col("shorts").alias("were_shorts"))
    turn = lambda leg: safe_div(F.col(f"{leg}s") + F.col(f"were_{leg}s") - 2 * F.col(f"same_{leg}s"), F.greatest(f"{leg}s", F.lit(1)))
    return both.join(sizes, "before").select(time, ((turn("long") + turn("short")) / 2).alias("turnover"))


def crowding(df: DataFrame, factors: list[str], threshold: float = 0.7) -> DataFrame:
    """One row: the mean correlation of all pairs of factors, its level, and the pairs beyond ``threshold``."""
    pairs = [F.corr(a, b) for k, a in enumerate(factors) for b in factors[k + 1 :]]
    rows = df.agg(F.array(*pairs).alias("r")).select(F.expr("aggregate(r, 0D, (a, x) -> a + x) / size(r)").alias("avg_correlation"), F.size(F.filter("r", lambda x: F.abs(x) > threshold)).cast("bigint").alias("n_high_pairs"))
    level = F.when(F.col("avg_correlation") > 0.7, "high").when(F.col("avg_correlation") > 0.4, "medium").otherwise("low")
    return rows.withColumn("level", level)


def factor_weights(ic: DataFrame, how: str = "icir", half_life: float = 20, time: str = "date") -> DataFrame:
    """(factor, weight), weights summing to 1, from coefficients by (factor, time): ``icir``, mean over deviation, and
    ``decay``, mean with half the weight every ``half_life`` times back, count only above zero; ``ic`` is the size of the mean.
    Where no factor has any, all weigh the same. Give rows known at the decision only: every row counts."""
    age = F.row_number().over(Window.partitionBy("factor").orderBy(F.col(time).desc())) - 1
    rows = ic.withColumn("__fade", F.pow(F.lit(0.5), age / F.lit(float(half_life))))
    score = {
        "icir": F.greatest(safe_div(F.avg("ic"), F.greatest(F.stddev_samp("ic"), F.lit(1e-12))), F.lit(0.0)),
        "ic": F.abs(F.avg("ic")),
        "decay": F.greatest(safe_div(F.sum(F.coalesce("ic", F.lit(0.0)) * F.col("__fade")), F.sum("__fade")), F.lit(0.0)),
    }[how]
    each = rows.groupBy("factor").agg(F.coalesce(score, F.lit(0.0)).alias("__score"))
    total = each.agg(F.sum("__score").alias("__total"), F.count("*").alias("__n"))
    return each.crossJoin(F.broadcast(total)).select("factor", F.when(F.col("__total") > 0, F.col("__score") / F.col("__total")).otherwise(1 / F.col("__n")).alias("weight"))  # one row


def combined(df: DataFrame, factors: list[str], weights: DataFrame, key: str = "code", time: str = "date", limit: float = 5.0) -> DataFrame:
    """(key, time, score): weighted sum of each time's standard scores (sample deviation; 0 without spread), held to
    ``limit``. A row that lacks one of the factors has no score; a factor without a weight counts nothing."""
    scores = df.select(key, time, *factors).repartition(TIMES, time).select(key, time, *(F.when(F.col(c).isNotNull(), F.coalesce(zscore(c, [time], ddof=1, limit=limit), F.lit(0.0))).alias(c) for c in factors))
    named = weights.groupBy().agg(*(F.sum(F.when(F.col("factor") == c, F.col("weight"))).alias(f"__w_{c}") for c in factors))
    total = sum((F.col(c) * F.coalesce(F.col(f"__w_{c}"), F.lit(0.0)) for c in factors), F.lit(0.0))
    return scores.crossJoin(F.broadcast(named)).select(key, time, total.alias("score"))  # one row


def redundant_groups(pairs: DataFrame, factors: list[str], threshold: float = 0.7) -> dict[str, str]:
    """Each factor's representative: the first factor, in order, that it correlates with by ``threshold`` or more and
    that isn't itself represented. Takes (a, b, corr) with one row per pair of factors, so few rows reach the driver."""
    close = {frozenset((r["a"], r["b"])) for r in pairs.where(F.abs("corr") >= threshold).select("a", "b").collect()}
    chosen: dict[str, str] = {}
    for f in factors:
        chosen[f] = next((g for g in factors[: factors.index(f)] if chosen[g] == g and frozenset((f, g)) in close), f)
    return chosen
