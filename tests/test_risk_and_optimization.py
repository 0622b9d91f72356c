"""Prefix scans, factor risk and optimisers against plain loops, numpy and optimality conditions."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import optimize as op
from tessera.operators import recursion as rc
from tessera.operators import risk as rk

D = datetime.date


def series(spark, n, keys=("a", "b", None), holes=0.1, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in keys:
        x = rng.normal(size=n)
        y = 1.3 * x + 0.2 * rng.normal(size=n)
        for t in range(n if k != "b" else 3):
            rows.append((k, D(2020, 1, 1) + datetime.timedelta(days=t), None if rng.random() < holes else float(x[t]), None if rng.random() < holes else float(y[t]), "kept"))
    order = rng.permutation(len(rows))
    return spark.createDataFrame([rows[i] for i in order], "code string, date date, x double, y double, beta_x string"), rows


def by_key(df):
    out = {}
    for r in df.orderBy("date").collect():
        out.setdefault(r.code, []).append(r)
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_kalman_equals_a_plain_filter(spark, parts):
    df, rows = series(spark, 120)
    got = by_key(rc.kalman_beta(df, "y", "x", parts=parts))
    assert set(got) == {"a", "b", None} and got["a"][0].beta_x == "kept"
    for k, mine in got.items():
        b, p = 1.0, 100.0
        for r, (_, _, x, y, _) in zip(mine, sorted((r for r in rows if r[0] == k), key=lambda r: r[1])):
            p += 1e-5
            if x is not None and y is not None:
                gain = p * x / (x * x * p + 1e-3)
                b, p = b + gain * (y - x * b), (1 - gain * x) * p
            assert abs(r.beta - b) < 1e-9 and abs(r.beta_std - p**0.5) < 1e-9


@pytest.mark.parametrize("parts", [1, 7])
def test_smoother_and_means(spark, parts):
    df, rows = series(spark, 150, holes=0.0, seed=3)
    got = by_key(rc.kalman_smooth(df, "y", parts=parts))
    for k, mine in got.items():
        y = [r[3] for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])]
        s, p, f = y[0], 10.0, []
        for v in y:
            q = p + 1e-5
            gain = q / (q + 1e-3)
            s, p = s + gain * (v - s), (1 - gain) * q
            f.append((s, p))
        smooth = [f[-1][0]]
        for s, p in f[-2::-1]:
            smooth.insert(0, s + p / (p + 1e-5) * (smooth[0] - s))
        assert np.allclose([r.state for r in mine], [s for s, _ in f], atol=1e-9) and np.allclose([r.smooth for r in mine], smooth, atol=1e-8)
    df, rows = series(spark, 100, seed=4)
    got = by_key(rc.scan(df, [rc.ewm_mean("x", 0.2, "m"), rc.ewm_adjusted("x", 0.3, "adj"), rc.ewm_deviation("x", 0.06, "dev")], parts=parts))
    for k, mine in got.items():
        x = pd.Series([r[2] for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])], dtype=float)
        for name, want in (("m", x.ewm(alpha=0.2, adjust=False, ignore_na=True).mean()), ("adj", x.ewm(alpha=0.3).mean()), ("dev", x.ewm(alpha=0.06, adjust=False, ignore_na=True).std())):
            have = pd.Series([getattr(r, name) for r in mine], dtype=float)
            assert np.allclose(have, want, atol=1e-9, equal_nan=True), (k, name)


def test_one_long_key_is_cut_and_nothing_is_nothing(spark):
    df, _ = series(spark, 2000, keys=("a",))
    assert rc.blocks(df, "code", "date", 8).where("code = 'a'").select("__block").distinct().count() >= 4
    assert rc.kalman_beta(df.limit(0), "y", "x").count() == 0


def test_jacobi_and_repair():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 12):
        m = rng.normal(size=(n, n))
        m = m + m.T
        values, vectors = rk.jacobi(m)
        assert np.allclose(values, np.linalg.eigvalsh(m), atol=1e-10) and np.allclose(vectors @ np.diag(values) @ vectors.T, m, atol=1e-10)
        fixed = rk.repaired(m @ m.T - 0.5 * np.eye(n))
        assert np.allclose(fixed, fixed.T) and np.linalg.eigvalsh(fixed).min() > 0
    kept = np.diag([5.0, 4.0, 0.1, 0.2])
    assert np.allclose(rk.repaired(kept), np.diag([5.0, 4.0, 0.15, 0.15]))


def test_factor_risk_equals_numpy(spark):
    rng = np.random.default_rng(2)
    t, n = 30, 12
    x = rng.normal(size=(t, n, 2))
    f = 0.02 * rng.normal(size=(t, 3))
    y = f[:, :1] + np.einsum("tnk,tk->tn", x, f[:, 1:]) + 0.01 * rng.normal(size=(t, n))
    rows = [(i, D(2024, 1, 1) + datetime.timedelta(days=d), float(y[d, i]) if (d, i) != (3, 4) else None, float(x[d, i, 0]), float(x[d, i, 1]), 1.0 / n) for d in range(t) for i in range(n)]
    df = spark.createDataFrame(rows, "code int, date date, ret double, a double, b double, weight double").repartition(5)
    returns = rk.factor_returns(df, ["a", "b"])
    got = {r.date: r.returns for r in returns.collect()}
    fitted = np.zeros((t, 3))
    resid = np.full((t, n), np.nan)
    for d in range(t):
        ok = np.array([(d, i) != (3, 4) for i in range(n)])
        design = np.column_stack([np.ones(n), x[d]])
        fitted[d] = np.linalg.lstsq(design[ok], y[d][ok], rcond=None)[0]
        resid[d, ok] = (y[d] - design @ fitted[d])[ok]
        assert np.allclose(got[rows[d * n][1]], fitted[d], atol=1e-10)
    w = 2.0 ** (-np.arange(t)[::-1] / 10)
    w /= w.sum()
    dev = fitted - w @ fitted
    want = (dev * w[:, None]).T @ dev
    for lag in (1, 2, 3):
        cross = (dev[lag:] * w[lag:, None]).T @ dev[:-lag]
        want += (1 - lag / 4) * (cross + cross.T)
    want *= t / (t - 1)
    cov = rk.factor_covariance(returns, 10.0, 3)
    have = np.zeros((3, 3))
    for r in cov.collect():
        have[r.i, r.j] = r.cov
    assert np.allclose(have, want, atol=1e-12)
    fixed = rk.repaired_covariance(cov)
    assert np.allclose([[r.cov for r in fixed.orderBy("i", "j").collect()]], [rk.repaired(want).ravel()], atol=1e-12)
    specific = rk.specific_variance(rk.residuals(df, returns, ["a", "b"]), 10.0, floor=1e-9)
    own = {r.code: r.variance for r in specific.collect()}
    for i in range(n):
        e = resid[:, i][~np.isnan(resid[:, i])]
        wi = 2.0 ** (-np.arange(len(e))[::-1] / 10)
        assert abs(own[i] - (wi * (e - e.mean()) ** 2).sum() / wi.sum() * len(e) / (len(e) - 1)) < 1e-12
    parts = {}
    for r in rk.decomposition(df, fixed, specific, ["a", "b"], ["date"]).collect():
        parts.setdefault(r.date, {})[r.factor] = r
    assert len(parts) == t
    for d in range(t):
        mine = parts[rows[d * n][1]]
        b = np.append(1.0, x[d].mean(0))
        factor = b @ rk.repaired(want) @ b
        alone = sum(own.values()) / n**2
        assert abs(mine["a"].total_var - factor - alone) < 1e-12 and abs(sum(r.share for r in mine.values()) - 1) < 1e-9
        assert abs(mine["a"].factor_var + mine["a"].specific_var - mine["a"].total_var) < 1e-15 and abs(mine["b"].exposure - b[2]) < 1e-12


def best_of(objective, g, h, n, tries, seed=0):
    """The least value over random weights within the limits."""
    rng = np.random.default_rng(seed)
    w = rng.dirichlet(np.full(n, 0.7), tries)
    w = w[(w @ g.T <= h + 1e-12).all(1)]
    return min(map(objective, w))


@pytest.mark.parametrize("seed", range(4))
def test_optimisers_meet_their_conditions(seed):
    rng = np.random.default_rng(seed)
    n, t = 6, 40
    r = rng.normal(0.001, 0.02, (t, n)) @ (np.eye(n) + 0.4 * rng.normal(size=(n, n)))
    cov, mean = np.cov(r, rowvar=False), r.mean(0)
    g, h = op.limits(n, 0.4, ["x", "x", "y", "y", None, None], 0.5)
    inside = lambda w: abs(w.sum() - 1) < 1e-8 and (g @ w <= h + 1e-8).all()
    w, error = op.mean_variance(cov, mean, 0.5, g, h)
    assert error < 1e-8 and inside(w) and w @ cov @ w / 2 - 0.5 * mean @ w <= best_of(lambda v: v @ cov @ v / 2 - 0.5 * mean @ v, g, h, n, 20_000) + 1e-12
    w, error = op.max_sharpe(cov, mean, 0.0, g, h)
    if mean.max() > 0:
        assert error < 1e-8 and inside(w) and -(mean @ w) / np.sqrt(w @ cov @ w) <= best_of(lambda v: -(mean @ v) / np.sqrt(v @ cov @ v), g, h, n, 20_000) + 1e-9
    w, error = op.equal_risk(cov)
    assert error < 1e-8 and np.allclose(w * (cov @ w) / (w @ cov @ w), 1 / n, atol=1e-8) and abs(w.sum() - 1) < 1e-12
    w, error = op.least_shortfall(r, 0.9, g, h)
    tail = lambda v: np.sort(-(r @ v))[-4:].mean()  # noqa: E731  0.1 * 40 losses
    assert error < 1e-8 and inside(w) and tail(w) <= best_of(tail, g, h, n, 20_000) + 1e-8
    middle = float(np.median(mean))
    w, error = op.target_return(cov, mean, middle, *op.limits(n, 1.0, None, 1.0))
    assert error < 1e-8 and abs(w @ mean - middle) < 1e-8
    assert op.target_return(cov, mean, mean.max() + 1, *op.limits(n, 1.0, None, 1.0))[1] > 1e-3


def test_views_move_what_they_say():
    cov = np.array([[0.04, 0.01, 0.0], [0.01, 0.09, 0.02], [0.0, 0.02, 0.16]])
    prior = np.array([0.5, 0.3, 0.2])
    implied, same = op.posterior(cov, prior, [])
    assert np.allclose(implied, 2.5 * cov @ prior) and same is cov
    views = [([1], True, 0.5), ([0, 2], False, 0.9)]
    pick = np.array([[0, 1, 0], [0.5, 0, 0.5]])
    noise = np.diag(np.maximum((1 - np.array([0.5, 0.9])) * np.diag(pick @ cov @ pick.T) * 0.05, 1e-10))
    base = pick @ implied
    said = base + np.array([1, -1]) * 0.5 * abs(base) * np.array([0.5, 0.9])
    inner = np.linalg.inv(np.linalg.inv(0.05 * cov) + pick.T @ np.linalg.inv(noise) @ pick)
    mean, spread = op.posterior(cov, prior, views)
    assert np.allclose(mean, inner @ (np.linalg.inv(0.05 * cov) @ implied + pick.T @ np.linalg.inv(noise) @ said)) and np.allclose(spread, cov + inner)
    assert mean[1] > implied[1]


def test_limits_that_do_not_fit_are_relaxed():
    g, h = op.limits(4, 0.1, None, 0.3)
    assert np.allclose(h[:4], 0.25) and len(g) == 8
    assert len(op.limits(4, 0.5, ["a", "a", "a", "b"], 0.3)[0]) == 8 and len(op.limits(4, 0.5, ["a", "a", None, None], 0.3)[0]) == 9


def test_weights_of_many_problems(spark):
    rng = np.random.default_rng(7)
    rows = [(k, f"s{k % 4}" if k else None, D(2024, 1, 1) + datetime.timedelta(days=d), None if rng.random() < 0.05 else float(rng.normal(0.001, 0.02))) for d in range(26) for k in range(12)]
    df = spark.createDataFrame(rows, "asset int, sector string, date date, ret double")
    out = op.weights(op.windows(df, 12, 6)).toPandas()
    assert set(out["method"]) == set(op.SOLVERS) and out["problem"].nunique() == 4 and (out["error"] < 1e-8).all()
    sums = out.groupby(["problem", "method"])["weight"].agg(["sum", "max", "count"])
    assert np.allclose(sums["sum"], 1) and (sums["count"] == 12).all() and (sums.drop("equal_risk", level=1)["max"] <= 0.1 + 1e-7).all()
    tight = op.weights(op.windows(df.withColumn("sector", F.when(F.col("asset") > 0, F.concat(F.lit("s"), (F.col("asset") % 3).cast("string")))), 12, 6)).toPandas()  # one point fits
    assert (tight["error"] < 1e-6).all() and np.allclose(tight.groupby(["problem", "method"])["weight"].sum(), 1, atol=1e-6)
    assert op.weights(op.windows(df.limit(0), 12, 6)).count() == 0
