"""Tests of series: normality, autocorrelation, unit roots, cointegration, breaks, collinearity, spanning.

A test needs moments of a key's rows (lag products, products of regressors), which Spark sums for all keys in one pass, map-side
first. What is solved per key is one small system. Sums of products are taken about the key's means, so that they keep
their digits; coefficients then equal least squares.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import corr, ordered, safe_div

#: MacKinnon's response surfaces for p-values of unit-root tests with a constant, for one series and for the
#: residuals of two: the statistic between the two polynomials, below and above which p is 0 and 1, and these (ascending powers).
SURFACES = {
    1: (-1.61, -18.83, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    2: (-2.62, -18.86, 0.92, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
}


def unit_root_p(statistic: float, series: int = 1) -> float:
    middle, low, high, below, above = SURFACES[series]
    if not math.isfinite(statistic):
        return math.nan
    if statistic > high or statistic < low:
        return 1.0 if statistic > high else 0.0
    return NormalDist().cdf(sum(c * statistic**k for k, c in enumerate(below if statistic <= middle else above)))


def t_two_sided(t: float, dof: float) -> float:
    """P(|T| >= |t|) by the continued fraction of the incomplete beta function."""
    if not (math.isfinite(t) and dof > 0):
        return math.nan
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    if x >= 1:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.log(a) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))
    value = front * _fraction(a, b, x)
    return 1 - value if flip else value


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction, from its end."""
    out = 1.0
    for k in range(400, 0, -1):
        m = k // 2
        step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        out = 1 + step / out
    return 1 / out


def chi_square_tail(x: Column, dof: int) -> Column:
    """P(X >= x) for an even number of degrees of freedom, a finite sum."""
    if dof % 2 or dof < 2:
        raise ValueError("degrees of freedom must be even")
    half = x / 2
    term, total = F.lit(1.0), F.lit(1.0)
    for k in range(1, dof // 2):
        term = term * half / k
        total = total + term
    return F.exp(-half) * total


def _known(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c)


def normality(df: DataFrame, value: str, key: str = "code") -> DataFrame:
    """Jarque-Bera: n, skewness, kurtosis (excess), statistic and p."""
    x = F.col(value)
    out = df.where(x.isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"))
    stat = F.col("n") / 6.0 * (F.col("skewness") * F.col("skewness") + F.col("kurtosis") * F.col("kurtosis") / 4)
    out = out.withColumn("statistic", stat)
    return out.withColumn("p", chi_square_tail(F.col("statistic"), 2)).withColumn("normal", F.col("p") > 0.05)


def autocorrelation(df: DataFrame, value: str, lags: int = 20, key: str = "code", time: str = "date") -> DataFrame:
    """Ljung-Box over an even number of lags: n, statistic and p. Missing values are left out first; needs more rows than lags."""
    w = ordered(key, time)
    rows = df.where(F.col(value).isNotNull()).select(key, time, value)
    rows = rows.withColumn("__d", F.col(value) - F.avg(value).over(Window.partitionBy(key)))
    rows = rows.select(key, "__d", *(F.lag("__d", k).over(w).alias(f"__l{k}") for k in range(1, lags + 1)))
    sums = rows.groupBy(key).agg(F.count("*").cast("double").alias("n"), F.sum(F.col("__d") * F.col("__d")).alias("__v"), *(F.sum(F.col("__d") * F.col(f"__l{k}")).alias(f"__s{k}") for k in range(1, lags + 1)))
    r = [safe_div(f"__s{k}", "__v") for k in range(1, lags + 1)]
    total = sum((c * c / (F.col("n") - k) for k, c in enumerate(r[1:], 2)), r[0] * r[0] / (F.col("n") - 1))
    out = sums.where(F.col("n") > lags).withColumn("statistic", F.col("n") * (F.col("n") + 2) * total)
    return out.select(key, F.col("n").cast("bigint").alias("n"), "statistic", chi_square_tail(F.col("statistic"), lags).alias("p"))


def _fit(n: float, means: list[float], gram: list[float]) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Coefficients with the constant last, their t-values, R2 and residual sum; missing where the regressors don't determine them.
    ``means`` and ``gram`` (upper triangle, centred) have the regressors and then the explained variable."""
    k = len(means) - 1
    m = np.zeros((k + 1, k + 1))
    m[np.triu_indices(k + 1)] = gram
    m += np.triu(m, 1).T
    xx, xy, yy = m[:k, :k], m[:k, k], m[k, k]
    bad = np.full(k + 1, np.nan)
    scale = np.sqrt(np.maximum(np.diag(xx), 0.0))
    if n <= k + 1 or not (scale > 0).all():
        return bad, bad, math.nan, math.nan
    unit = xx / np.outer(scale, scale)
    if np.linalg.cond(unit) > 1e12:
        return bad, bad, math.nan, math.nan
    inverse = np.linalg.inv(unit) / np.outer(scale, scale)
    beta = inverse @ xy
    rss = max(yy - beta @ xy, 0.0)
    x_mean = np.array(means[:k])
    noise = rss / (n - k - 1)
    constant = means[k] - x_mean @ beta
    errors = np.sqrt(np.append(np.diag(inverse) * noise, noise * (1 / n + x_mean @ inverse @ x_mean)))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.append(beta, constant) / errors
    return np.append(beta, constant), t, 1 - rss / yy if yy > 0 else math.nan, rss


def _fits(kind: str, make: Callable) -> Callable:
    def run(n: pd.Series, means: pd.Series, gram: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([make(float(a), [float(x) for x in b], [float(x) for x in c]) for a, b, c in zip(n, means, gram)], columns=[f.split(" ")[0] for f in kind.split(", ")])

    return F.pandas_udf(run, kind)


def _each(f: Callable[[float], float]) -> Callable[[pd.Series], pd.Series]:
    def run(x: pd.Series) -> pd.Series:
        return x.map(f)

    return run


def _p_values(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) for a, b in zip(t, dof)])


_FIT = "coefficients array<double>, t array<double>, r2 double, rss double"


def regressions(df: DataFrame, y: str, xs: list[str], key: str | list[str] = "code") -> DataFrame:
    """Least squares of y on xs and a constant for every key: n, coefficients and t (xs, then the constant), r2, rss. Rows with a
    missing value are left out."""
    keys = [key] if isinstance(key, str) else key
    columns = [*xs, y]
    rows = df.select(*keys, *(F.col(c).cast("double").alias(f"__v{k}") for k, c in enumerate(columns))).dropna(subset=[f"__v{k}" for k in range(len(columns))])
    names = [f"__v{k}" for k in range(len(columns))]
    every = Window.partitionBy(*keys)
    rows = rows.select(*keys, *(F.avg(c).over(every).alias(f"__m{k}") for k, c in enumerate(names)), *names)
    d = [F.col(c) - F.col(f"__m{k}") for k, c in enumerate(names)]
    pairs = [(i, j) for i in range(len(d)) for j in range(i, len(d))]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*(F.first(f"__m{k}") for k in range(len(d)))).alias("__means"), F.array(*(F.sum(d[i] * d[j]) for i, j in pairs)).alias("__gram"))
    found = _fits(_FIT, lambda n, m, g: tuple(x.tolist() if isinstance(x, np.ndarray) else x for x in _fit(n, m, g)))
    return sums.withColumn("__f", found(F.col("n").cast("double"), "__means", "__gram")).select(*keys, "n", "__f.*")


def unit_root(df: DataFrame, value: str, lags: int = 1, key: str = "code", time: str = "date", series: int = 1) -> DataFrame:
    """Augmented Dickey-Fuller with a constant and ``lags`` lagged changes: n, statistic, p, stationary (p < 0.05). ``series`` 2 reads p
    as for the residuals of one series on another."""
    w = ordered(key, time)
    rows = df.where(F.col(value).isNotNull()).select(key, time, F.col(value).cast("double").alias("__x"))
    rows = rows.withColumn("__before", F.lag("__x").over(w)).withColumn("__d", F.col("__x") - F.col("__before"))
    rows = rows.select(key, "__before", "__d", *(F.lag("__d", k).over(w).alias(f"__d{k}") for k in range(1, lags + 1)))
    fits = regressions(rows, "__d", ["__before", *(f"__d{k}" for k in range(1, lags + 1))], key)
    p = F.pandas_udf(_each(lambda x: unit_root_p(x, series)), "double")
    out = fits.select(key, "n", F.col("t")[0].alias("statistic")).where(_known("statistic"))
    return out.withColumn("p", p("statistic")).withColumn("stationary", F.col("p") < 0.05)


def cointegration(df: DataFrame, a: str, b: str, lags: int = 1, key: str = "code", time: str = "date") -> DataFrame:
    """Engle-Granger: the unit-root test of what a's regression on b leaves; ``slope``, n, statistic, p, ``cointegrated``."""
    fits = regressions(df, a, [b], key).where(_known("r2")).select(key, F.col("coefficients")[0].alias("slope"), F.col("coefficients")[1].alias("__c"))
    rows = df.join(fits, key).withColumn("__rest", F.col(a) - F.col("slope") * F.col(b) - F.col("__c"))
    out = unit_root(rows, "__rest", lags, key, time, 2)
    return out.join(fits.select(key, "slope"), key).withColumn("cointegrated", F.col("p") < 0.05).drop("stationary")


def structural_break(df: DataFrame, value: str, key: str = "code", time: str = "date", least: int = 30) -> DataFrame:
    """Chow: two trends, split in the middle, against one: n, statistic, p (of F with 2 and n - 4)."""
    w = ordered(key, time)
    rows = df.where(F.col(value).isNotNull()).select(key, F.col(value).alias("y"), F.row_number().over(w).cast("double").alias("x"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    rows = rows.where(F.col("n") >= least).withColumn("__late", F.col("x") > F.floor(F.col("n") / 2))

    def rest(test: Column) -> Column:
        y, x = F.when(test, F.col("y")), F.when(test, F.col("x"))
        return F.regr_syy(y, x) - F.regr_sxy(y, x) * F.regr_sxy(y, x) / F.regr_sxx(y, x)

    sums = rows.groupBy(key).agg(F.first("n").alias("n"), rest(F.lit(True)).alias("one"), (rest(F.col("__late")) + rest(~F.col("__late"))).alias("two"))
    stat = safe_div((F.col("one") - F.col("two")) / 2, F.col("two") / (F.col("n") - 4))
    out = sums.select(key, "n", stat.alias("statistic")).where("statistic is not null")
    return out.withColumn("p", F.pow(1 + 2 * F.greatest("statistic", F.lit(0.0)) / (F.col("n") - 4), -(F.col("n") - 4) / 2))


def inflation(df: DataFrame, factors: list[str], by: list[str], most: float = 999.0) -> DataFrame:
    """Variance inflation of each factor given the others, in each group: 1 / (1 - R2), ``most`` where R2 is 0.999 or more or isn't
    determined. Missing values count as 0. One pass sums all products; the rest is the inverse of the correlations."""
    rows = df.select(*by, *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in factors))
    pairs = [(a, b) for k, a in enumerate(factors) for b in factors[k + 1 :]]
    sums = rows.groupBy(*by).agg(F.array(*(corr(a, b) for a, b in pairs)).alias("__c"))

    def run(corrs: pd.Series) -> pd.Series:
        out = []
        for c in corrs:
            m = np.eye(len(factors))
            m[np.triu_indices(len(factors), 1)] = [math.nan if v is None else v for v in c]
            m = np.triu(m) + np.triu(m, 1).T
            whole = np.isfinite(m).all(1) | (np.isfinite(m).sum(1) > 1)
            found = np.full(len(factors), most)
            ok = np.flatnonzero(whole)
            if len(ok):
                sub = m[np.ix_(ok, ok)]
                if np.isfinite(sub).all() and np.linalg.cond(sub) < 1e12:
                    found[ok] = np.diag(np.linalg.inv(sub))
            out.append(np.where(found < 1000.0, found, most).tolist())
        return pd.Series(out)

    found = sums.withColumn("__v", F.pandas_udf(run, "array<double>")("__c"))
    return found.select(*by, F.posexplode("__v").alias("__k", "vif")).select(*by, F.element_at(F.lit(factors), F.col("__k") + 1).alias("factor"), "vif")


def spanning(df: DataFrame, test: str, benchmarks: list[str], key: str = "code") -> DataFrame:
    """Whether a series has a mean return that the benchmarks don't give: alpha, its t and p, r2, ``has_alpha`` (p < 0.05)."""
    fits = regressions(df, test, benchmarks, key)
    k = len(benchmarks)
    p = F.pandas_udf(_p_values, "double")
    out = fits.select(key, "n", F.col("coefficients")[k].alias("alpha"), F.col("t")[k].alias("t"), "r2").where(_known("alpha"))
    return out.withColumn("p", p("t", (F.col("n") - k - 1).cast("double"))).withColumn("has_alpha", F.col("p") < 0.05)
