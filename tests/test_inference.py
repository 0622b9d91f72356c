"""Tests of series against least squares and direct sums."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import inference as nf

D = datetime.date


def ols(y, x):
    design = np.column_stack([x, np.ones(len(y))])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    rest = y - design @ beta
    noise = rest @ rest / (len(y) - design.shape[1])
    return beta, beta / np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * noise), 1 - rest @ rest / ((y - y.mean()) ** 2).sum(), rest


def adf(x, lags):
    d = np.diff(x)
    rows = range(lags, len(d))
    return ols(np.array([d[t] for t in rows]), np.array([[x[t], *(d[t - k] for k in range(1, lags + 1))] for t in rows]))[1][0]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    out = {}
    for k in range(4):
        walk = 500 + np.cumsum(rng.normal(size=200))
        out[f"k{k}"] = np.column_stack([walk, 3 + 0.8 * walk + rng.normal(size=200), rng.normal(size=200) + 2, rng.standard_t(4, size=200)])
    return out


@pytest.fixture(scope="module")
def df(spark, data):
    rows = [(k, D(2024, 1, 1) + datetime.timedelta(days=t), *map(float, v)) for k, x in data.items() for t, v in enumerate(x)]
    rows += [("flat", D(2024, 1, 1) + datetime.timedelta(days=t), 1.0, 1.0, 1.0, 1.0) for t in range(60)] + [("short", D(2024, 1, 1), 1.0, 2.0, 3.0, None), ("a null", D(2024, 1, 1), None, None, None, None)]
    return spark.createDataFrame(rows, "code string, date date, a double, b double, c double, d double").repartition(5)


def found(frame):
    return {r.code: r for r in frame.collect()}


def test_regressions_equal_least_squares(data, df):
    got = found(nf.regressions(df, "b", ["a", "c", "d"]))
    for k, x in data.items():
        beta, t, r2, rest = ols(x[:, 1], x[:, [0, 2, 3]])
        assert np.allclose(got[k].coefficients, beta, rtol=1e-9) and np.allclose(got[k].t, t, rtol=1e-9) and abs(got[k].r2 - r2) < 1e-12 and abs(got[k].rss - rest @ rest) < 1e-8
    assert got["flat"].r2 is None and "short" not in got and "a null" not in got


@pytest.mark.parametrize("lags", [1, 4])
def test_unit_roots_and_cointegration(data, df, lags):
    got, pairs = found(nf.unit_root(df, "a", lags)), found(nf.cointegration(df, "b", "a", lags))
    assert found(nf.unit_root(df, "c", lags))["k0"].stationary
    for k, x in data.items():
        assert abs(got[k].statistic - adf(x[:, 0], lags)) < 1e-9 and abs(got[k].p - nf.unit_root_p(got[k].statistic)) < 1e-12
        beta, *_, rest = ols(x[:, 1], x[:, :1])
        assert abs(pairs[k].slope - beta[0]) < 1e-10 and abs(pairs[k].statistic - adf(rest, lags)) < 1e-7 and pairs[k].cointegrated
    assert "flat" not in got and "short" not in got


def test_moments_lags_and_breaks(data, df):
    normal, lagged, breaks = found(nf.normality(df, "d")), found(nf.autocorrelation(df, "d", 6)), found(nf.structural_break(df, "a"))
    for k, x in data.items():
        v = x[:, 3] - x[:, 3].mean()
        s, kurt = (v**3).mean() / (v**2).mean() ** 1.5, (v**4).mean() / (v**2).mean() ** 2 - 3
        assert abs(normal[k].statistic - 200 / 6 * (s * s + kurt * kurt / 4)) < 1e-8
        r = [(v[j:] * v[:-j]).sum() / (v * v).sum() for j in range(1, 7)]
        q = 200 * 202 * sum(c * c / (200 - j) for j, c in enumerate(r, 1))
        assert abs(lagged[k].statistic - q) < 1e-8 and abs(lagged[k].p - np.exp(-q / 2) * (1 + q / 2 + q * q / 8)) < 1e-12
        t = np.arange(200.0)[:, None]
        rss = lambda lo, hi: (lambda e: e @ e)(ols(x[lo:hi, 0], t[lo:hi])[3])
        f = ((rss(0, 200) - rss(0, 100) - rss(100, 200)) / 2) / ((rss(0, 100) + rss(100, 200)) / 196)
        assert abs(breaks[k].statistic / f - 1) < 1e-7
    with pytest.raises(ValueError):
        nf.autocorrelation(df, "d", 3)


def test_inflation_and_spanning(data, df):
    got = {(r.code, r.factor): r.vif for r in nf.inflation(df, ["a", "b", "c", "d"], ["code"]).collect()}
    span = found(nf.spanning(df, "c", ["a", "d"]))
    for k, x in data.items():
        for j, name in enumerate("abcd"):
            r2 = ols(x[:, j], np.delete(x, j, 1))[2]
            assert abs(got[k, name] - (1 / (1 - r2) if r2 < 0.999 else 999.0)) < 1e-6 * got[k, name]
        beta, t, *_ = ols(x[:, 2], x[:, [0, 3]])
        assert abs(span[k].alpha - beta[-1]) < 1e-9 and abs(span[k].t - t[-1]) < 1e-7 and span[k].has_alpha == (span[k].p < 0.05)
    assert got["flat", "a"] == 999.0


def test_tails():
    assert abs(nf.t_two_sided(2.0, 10) - 0.07338803477074037) < 1e-12 and nf.t_two_sided(0.0, 5) == 1.0
    assert abs(nf.unit_root_p(-2.86) - 0.05) < 1e-3 and abs(nf.unit_root_p(-3.34, 2) - 0.05) < 1e-3 and nf.unit_root_p(-50) == 0.0 and nf.unit_root_p(9) == 1.0
