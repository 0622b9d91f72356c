"""Portfolio weights that solve an optimisation, one small problem per group of rows, thousands side by side.

A problem is a window of asset returns. Its size is assets by dates of the window, whatever the table's size: longer
histories mean more problems. One interior-point solver serves mean-variance and expected shortfall, cyclic
coordinate steps serve equal risk; both stop at optimality conditions, not after a number of steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RISK_AVERSION, PRIOR_DOUBT = 2.5, 0.05


def quadratic(q: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray, g: np.ndarray, h: np.ndarray, tolerance: float = 1e-11) -> tuple[np.ndarray, float]:
    """The x that minimises x'qx / 2 + c'x under ax = b and gx <= h, and the largest error in its optimality conditions,
    by a primal-dual path with predictor and corrector. ``q`` may be zero (a linear problem)."""
    n, m, k = len(c), len(b), len(h)
    x, y = np.zeros(n), np.zeros(m)
    s, z = np.ones(k), np.ones(k)
    scale = 1 + max(np.abs(c).max(initial=0.0), np.abs(b).max(initial=0.0), np.abs(h).max(initial=0.0))
    best, error = x, np.inf
    for _ in range(200):
        dual, primal, gap = q @ x + c + a.T @ y + g.T @ z, a @ x - b, g @ x + s - h
        mu = s @ z / k
        now = max(np.abs(dual).max(), np.abs(primal).max(initial=0.0), np.abs(gap).max(), mu)
        if now < error:
            best, error = x, now
        if now < tolerance * scale or not now < 1e100 or s.min() < 1e-100 or z.max() > 1e100:
            break
        heavy = z / s
        kkt = np.block([[q + (g.T * heavy) @ g, a.T], [a, np.zeros((m, m))]])
        unit = np.abs(np.diag(kkt)[:n]).max()
        kkt[np.arange(n), np.arange(n)] += 1e-15 * unit
        kkt[np.arange(n, n + m), np.arange(n, n + m)] -= 1e-15 / unit

        def step(centre: np.ndarray) -> tuple[np.ndarray, ...]:
            right = np.concatenate([-dual - g.T @ (heavy * gap - centre / s), -primal])
            found = np.linalg.solve(kkt, right)
            found += np.linalg.solve(kkt, right - kkt @ found)  # refined once: the matrix is ill-conditioned near the end
            dx = found[:n]
            ds = -gap - g @ dx
            return dx, found[n:], ds, (-centre - z * ds) / s

        def reach(v: np.ndarray, d: np.ndarray) -> float:
            down = d < 0
            return min(1.0, (-v[down] / d[down]).min(initial=np.inf))

        _, _, ds, dz = step(s * z)
        far_p, far_d = reach(s, ds), reach(z, dz)
        ahead = (s + far_p * ds) @ (z + far_d * dz) / k
        dx, dy, ds, dz = step(s * z + ds * dz - (ahead / mu) ** 3 * mu)
        far_p, far_d = 0.995 * reach(s, ds), 0.995 * reach(z, dz)
        if np.any(q):
            far_p = far_d = min(far_p, far_d)
        x, s, y, z = x + far_p * dx, s + far_p * ds, y + far_d * dy, z + far_d * dz
    return best, float(error / scale)


def limits(n: int, cap: float, sectors: list | None, sector_cap: float) -> tuple[np.ndarray, np.ndarray]:
    """gx <= h for weights of at least 0 and at most ``cap``, a sector's sum at most ``sector_cap`` (null sectors have none).
    Where no weights that sum to 1 would fit, the cap becomes 1 / n, or the sectors' limits go."""
    cap = max(cap, 1.0 / n)
    rows, h = [np.eye(n), -np.eye(n)], [np.full(n, cap), np.zeros(n)]
    if sectors is not None:
        members = {s: np.array([x == s for x in sectors], float) for s in dict.fromkeys(sectors) if s is not None}
        free = sum(x is None for x in sectors) * cap
        if free + sum(min(m.sum() * cap, sector_cap) for m in members.values()) >= 1 - 1e-12:
            rows += [m[None, :] for m in members.values()]
            h += [np.full(len(members), sector_cap)]
    return np.concatenate(rows), np.concatenate(h)


def _sum_to_one(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.ones((1, n)), np.ones(1)


def mean_variance(cov: np.ndarray, mean: np.ndarray, appetite: float, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The least variance less ``appetite`` times the mean."""
    size = max(np.abs(cov).max(), 1e-300)
    return quadratic(cov / size, -appetite * mean / size, *_sum_to_one(len(mean)), g, h)


def target_return(cov: np.ndarray, mean: np.ndarray, target: float, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The least variance with the given mean; an error that stays large tells that no weights have it."""
    size = max(np.abs(cov).max(), 1e-300)
    a, b = _sum_to_one(len(mean))
    unit = max(np.abs(mean).max(), 1e-300)
    return quadratic(cov / size, np.zeros(len(mean)), np.concatenate([a, mean[None, :] / unit]), np.append(b, target / unit), g, h)


def max_sharpe(cov: np.ndarray, mean: np.ndarray, free_rate: float, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The highest (mean - free_rate) / deviation. With an excess above 0 that is the least variance of y = w / excess,
    a convex problem whose limits scale with sum(y); without one, the most mean."""
    n = len(mean)
    excess = mean - free_rate
    top, _ = quadratic(np.zeros((n, n)), -excess / max(np.abs(excess).max(), 1e-300), *_sum_to_one(n), g, h)
    if excess @ top <= 1e-12:
        return mean_variance(cov, mean, 0.0, g, h)
    unit, size = np.abs(excess).max(), max(np.abs(cov).max(), 1e-300)
    y, error = quadratic(cov / size, np.zeros(n), excess[None, :] / unit, np.ones(1), np.concatenate([g - h[:, None], -np.ones((1, n))]), np.zeros(len(h) + 1))
    return y / y.sum(), error


def equal_risk(cov: np.ndarray, tolerance: float = 1e-12) -> tuple[np.ndarray, float]:
    """Long weights of which each makes the same part of the variance: the minimum of w'cw / 2 - sum(log w) / n. Cyclic steps,
    each the positive root of a quadratic, come close; damped Newton steps finish, also where the covariance is nearly
    singular. The error is the largest difference between parts."""
    n = len(cov)
    cov = cov / max(np.abs(np.diag(cov)).max(), 1e-300)
    own = np.maximum(np.diag(cov), 1e-12)
    w = 1 / np.sqrt(own) / n
    for _ in range(30):
        for i in range(n):
            rest = cov[i] @ w - cov[i, i] * w[i]
            w[i] = (-rest + np.sqrt(rest * rest + 4 * own[i] / n)) / (2 * own[i])

    def spread() -> float:
        parts = w * (cov @ w)
        return float(np.abs(parts / parts.sum() - 1 / n).max())

    for _ in range(200):
        if spread() < tolerance:
            break
        slope = cov @ w - 1 / (n * w)
        step = np.linalg.solve(cov + np.diag(1 / (n * w * w)), -slope)
        decrement = np.sqrt(max(-slope @ step, 0.0) * n)
        w = w + step / (1 + decrement if decrement > 0.25 else 1.0)
    return w / w.sum(), spread()


def least_shortfall(returns: np.ndarray, level: float, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The least expected loss beyond the quantile ``level`` of the losses of dates x assets: linear in the weights, the
    quantile and each date's loss beyond it."""
    t, n = returns.shape
    unit = max(np.abs(returns).max(), 1e-300)
    c = np.concatenate([np.zeros(n), [1.0], np.full(t, 1 / ((1 - level) * t))])
    beyond = np.concatenate([-returns / unit, -np.ones((t, 1)), -np.eye(t)], 1)
    positive = np.concatenate([np.zeros((t, n + 1)), -np.eye(t)], 1)
    bounds = np.concatenate([g, np.zeros((len(g), t + 1))], 1)
    one = np.concatenate([np.ones(n), np.zeros(t + 1)])[None, :]
    x, error = quadratic(np.zeros((n + 1 + t,) * 2), c, one, np.ones(1), np.concatenate([bounds, beyond, positive]), np.concatenate([h, np.zeros(2 * t)]))
    return x[:n], error


def posterior(cov: np.ndarray, prior: np.ndarray, views: list[tuple[list[int], bool, float]], aversion: float = RISK_AVERSION, doubt: float = PRIOR_DOUBT) -> tuple[np.ndarray, np.ndarray]:
    """Expected returns and covariance after views (assets, upwards, confidence) on the returns that make ``prior``
    weights optimal. A view says that its assets' mean return is half its size, times the confidence, above or below."""
    implied = aversion * cov @ prior
    if not views:
        return implied, cov
    pick = np.zeros((len(views), len(prior)))
    for k, (assets, _, _) in enumerate(views):
        pick[k, assets] = 1 / len(assets)
    base = pick @ implied
    sign, sure = np.array([1.0 if up else -1.0 for _, up, _ in views]), np.array([c for _, _, c in views])
    said = base + sign * 0.5 * np.abs(base) * sure
    noise = np.maximum((1 - sure) * np.einsum("ki,ij,kj->k", pick, cov, pick) * doubt, 1e-10)
    shared = doubt * cov @ pick.T
    gain = np.linalg.solve(pick @ shared + np.diag(noise), shared.T).T
    return implied + gain @ (said - base), cov + doubt * cov - gain @ shared.T


SOLVERS = ("min_variance", "max_sharpe", "equal_risk", "least_shortfall", "black_litterman")


def solve(returns: np.ndarray, method: str, cap: float, sectors: list | None, sector_cap: float, level: float = 0.95) -> tuple[np.ndarray, float]:
    """Weights from a window of returns, dates x assets. ``black_litterman`` starts from equal weights and holds one view:
    the assets with the highest mean of the window, a fifth of all, go up, half surely."""
    n = returns.shape[1]
    cov, mean = np.atleast_2d(np.cov(returns, rowvar=False)), returns.mean(0)
    cov = cov + np.eye(n) * (1e-10 + 1e-8 * np.trace(cov) / n)
    g, h = limits(n, cap, sectors, sector_cap)
    if method == "min_variance":
        return mean_variance(cov, mean, 0.0, g, h)
    if method == "max_sharpe":
        return max_sharpe(cov, mean, 0.0, g, h)
    if method == "equal_risk":
        return equal_risk(cov)
    if method == "least_shortfall":
        return least_shortfall(returns, level, g, h)
    if method == "black_litterman":
        best = np.argsort(-mean, kind="stable")[: max(1, n // 5)].tolist()
        after, spread = posterior(cov, np.full(n, 1 / n), [(best, True, 0.5)])
        return mean_variance(spread, after, 1 / RISK_AVERSION, g, h)
    raise ValueError(f"no method {method}; there are {', '.join(SOLVERS)}")


def windows(returns: DataFrame, length: int, every: int, time: str = "date") -> DataFrame:
    """Each row once per problem that it is part of, with ``problem``, the problem's last date. Dates are numbered (one
    row per date); a problem ends at every ``every``-th and has ``length`` dates, the first ones fewer."""
    dates = returns.select(time).distinct().withColumn("__at", F.row_number().over(Window.orderBy(time)))
    ends = dates.where(F.col("__at") % every == 0).select((F.col("__at") / every).cast("long").alias("__problem"), F.col(time).alias("problem"))
    first = F.ceil(F.col("__at") / every)
    last = F.floor((F.col("__at") + length - 1) / every)
    rows = returns.join(dates, time).withColumn("__problem", F.explode(F.when(last >= first, F.sequence(first, last))))
    return rows.join(ends, "__problem").drop("__problem", "__at")


def weights(df: DataFrame, methods: tuple[str, ...] = SOLVERS, problem: str = "problem", asset: str = "asset", sector: str | None = "sector", time: str = "date", value: str = "ret", cap: float = 0.10, sector_cap: float = 0.30, least: int = 3) -> DataFrame:
    """(problem, method, asset, weight, error) for each problem with at least ``least`` dates; a missing return counts as 0.
    ``error`` is how far the optimality conditions are from met."""
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        grid = rows.pivot_table(index=time, columns=asset, values=value, aggfunc="mean", dropna=False).fillna(0.0)
        if len(grid) < least:
            return pd.DataFrame(columns=["problem", "method", "asset", "weight", "error"])
        group = None
        if sector:
            of = rows.drop_duplicates(asset).set_index(asset)[sector]
            group = [None if pd.isna(of[a]) else of[a] for a in grid.columns]
        out = []
        for method in methods:
            w, error = solve(grid.to_numpy(float), method, cap, group, sector_cap)
            out.append(pd.DataFrame({"problem": rows[problem].iloc[0], "method": method, "asset": grid.columns, "weight": w, "error": error}))
        return pd.concat(out)

    chosen = df.select(problem, asset, time, F.col(value).cast("double").alias(value), *([sector] if sector else []))
    return chosen.groupBy(problem).applyInPandas(run, f"problem {kinds[problem]}, method string, asset {kinds[asset]}, weight double, error double")
