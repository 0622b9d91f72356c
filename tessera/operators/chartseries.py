"""More named series of bars: momenta, deviations, oscillators, volume lines and channels, of a key's ordered bars.

The recursive ones (MACD, stochastic lines with weights that sum to 1 from the start, running sums) and all windows are taken from
the same sorted rows in one pass, so that the bars are dealt once. A quotient by zero is missing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import safe_div
from tessera.operators import recursion as rc
from tessera.operators.rolled import quotient, rolled, sorted_by

TECHNICAL = (
    "tech_mom_3_10", "tech_mom_10", "tech_mom_20", "tech_mom_60", "tech_mom_120", "tech_ret_week", "tech_ret_250", "tech_cum_ret_10", "tech_ret_ytd", "tech_ma5_dev", "tech_ma20_dev", "tech_ma60_dev", "tech_close_ma250",
    "tech_rsi6", "tech_rsi14", "tech_rsi_diff", "tech_kdj_j", "tech_macd_hist", "tech_macd_gold", "tech_vol20", "tech_vol_skew", "tech_drawdown_60", "tech_calmar_60", "tech_cci20", "tech_vol_ma20", "tech_vol_std20",
    "tech_turnover_z", "tech_obv_slope", "tech_obv_trend", "tech_gap_up", "tech_high_52w_pos",
)
CLASSIC = (
    "mom20", "mom1m", "mom3m", "mom6m", "mom12m", "rev5", "macd_cross", "macd_hist", "macd_div", "cci_20", "high_low_pos", "volume_surge", "volume_ratio", "obv_slope", "atr_ratio", "amihud_illiq", "spread_approx", "kdj",
    "williams", "boll_width", "boll_pos", "rsi14",
)


def chart_series(panel: DataFrame, key: str = "code", time: str = "date") -> DataFrame:
    """Key, time, TECHNICAL and CLASSIC. ``panel`` has open, high, low, close, volume, amount and turnover. What has no full window is
    missing, except that flags are 0, ``tech_cci20`` 0, ``rsi14`` 50 and places in a channel 0.5. ``tech_ret_ytd`` counts from the
    first of the last 300 rows."""
    bars = ("open", "high", "low", "close", "volume", "amount", "turnover")
    before = {
        "__before": ("lag", "close", 1), "__low9": ("min", "low", 9), "__high9": ("max", "high", 9), "__ret": (lambda c, b: quotient(c, b) - 1, ("close", "__before"), 0), "__move": (np.subtract, ("close", "__before"), 0),
        "__r": ("lag", "__ret", 0), "__m": ("lag", "__move", 0), "__raw_": (lambda c, low, high: quotient(c - low, high - low) * 100, ("close", "__low9", "__high9"), 0), "__raw": ("lag", "__raw_", 0),
        "__signed_": (lambda m, v: np.nan_to_num(np.sign(m) * v), ("__move", "volume"), 0), "__signed": ("lag", "__signed_", 0),
    }
    lines = [rc.macd("close", ("__fast", "__slow", "__dea")), rc.ewm_adjusted("__raw", 1 / 3, "__k"), rc.ewm_adjusted("__k", 1 / 3, "__d"), rc.running_sum("__signed", "__obv")]
    after = {
        "__typ": (lambda h, low, c: (h + low + c) / 3, ("high", "low", "close"), 0), "__gain": (lambda m: np.maximum(m, 0.0), ("__m",), 0), "__loss": (lambda m: np.maximum(-m, 0.0), ("__m",), 0),
        "__range": (lambda h, low, b: np.fmax(h - low, np.fmax(abs(h - b), abs(low - b))), ("high", "low", "__before"), 0), "__spread": (lambda h, low, c: quotient(h - low, c), ("high", "low", "close"), 0),
        "__cost": (lambda r, a: quotient(abs(r), a), ("__r", "amount"), 0), "__hist": (lambda fast, slow, dea: fast - slow - dea, ("__fast", "__slow", "__dea"), 0), "__hist_lag_1": ("lag", "__hist", 1),
        "__gold": (lambda now, then: (now > 0) & (then <= 0), ("__hist", "__hist_lag_1"), 0), "__volume_lag_1": ("lag", "volume", 1), "__typ_mean_20": ("mean", "__typ", 20), "__off": (lambda x, m: abs(x - m), ("__typ", "__typ_mean_20"), 0),
    }
    named = lambda c: c if c in bars else f"__{c}"
    after |= {f"__{c}_{how}_{n}": (how, named(c), n) for c, how, sizes in (
        ("close", "lag", (3, 5, 10, 20, 21, 59, 60, 63, 120, 126, 250, 252)), ("close", "first", (300,)), ("close", "mean", (5, 20, 60, 250)), ("close", "pop", (20,)), ("close", "fall", (60,)), ("close", "min", (30, 250, 252)), ("close", "max", (30, 250, 252)),
        ("low", "min", (14,)), ("high", "max", (14,)), ("gain", "mean", (6, 14, 20, 50)), ("loss", "mean", (6, 14, 20, 50)), ("ret", "std", (20,)), ("ret", "skew", (60,)), ("volume", "mean", (20,)), ("volume", "std", (20,)), ("volume_lag_1", "mean", (5, 20)),
        ("turnover", "mean", (20,)), ("turnover", "std", (20,)), ("obv", "lag", (64, 299)), ("obv", "mean", (20, 60)), ("obv", "slope", (20, 25)), ("typ", "deviation", (20,)), ("off", "mean", (20,)), ("hist", "lag", (0,)), ("hist", "min", (30,)), ("hist", "max", (30,)),
        ("gold", "max", (3,)), ("range", "mean", (14,)), ("cost", "mean", (20,)), ("spread", "mean", (20,)), ("typ", "lag", (0,)),
    ) for n in sizes}
    after = {n: (how, "__r" if of == "__ret" else of, *rest) for n, (how, of, *rest) in after.items()}
    rows = rolled(sorted_by(panel.select(key, time, *bars), key, time), [before, lines, after], key, ["__before", "__k", "__d", *(n for n, s in after.items() if not callable(s[0]))])
    c, o, v = (F.col(x) for x in ("close", "open", "volume"))
    k, d, hist, typ, obv64 = F.col("__k"), F.col("__d"), F.col("__hist_lag_0"), F.col("__typ_lag_0"), F.col("__obv_lag_64")

    def of(name: str, how: str, n: int) -> Column:
        return F.col(f"__{name}_{how}_{n}")

    def mean(name: str, n: int) -> Column:
        return of(name, "mean", n)

    def change(n: int) -> Column:
        return safe_div(c, of("close", "lag", n)) - 1

    def place(x: Column, bottom: Column, top: Column) -> Column:
        return safe_div(x - bottom, top - bottom)

    def flag(test: Column) -> Column:
        return F.coalesce(test.cast("double"), F.lit(0.0))

    def strength(n: int) -> Column:
        """100 without losses, 0 without gains, 50 without either."""
        up, down = mean("gain", n), mean("loss", n)
        return F.when((down == 0) & (up > 0), 100.0).when((up == 0) & (down > 0), 0.0).when((up == 0) & (down == 0), 50.0).otherwise(100 - 100 / (1 + safe_div(up, down)))

    low14, high14 = of("low", "min", 14), of("high", "max", 14)
    mid, sd, off, fall = mean("close", 20), of("close", "pop", 20), of("typ", "deviation", 20), of("close", "fall", 60)
    j = 3 * k - 2 * d
    bottom252, top252 = of("close", "min", 252), of("close", "max", 252)
    top_div = flag((c >= of("close", "max", 30) * 0.98) & (hist < of("hist", "max", 30) * 0.9))
    bottom_div = flag((c <= of("close", "min", 30) * 1.02) & (hist > of("hist", "min", 30) * 1.1))
    made = {
        **{n: change(k) for n, k in (("tech_mom_3_10", 3), ("tech_mom_10", 10), ("tech_mom_20", 20), ("tech_mom_60", 60), ("tech_mom_120", 120), ("tech_ret_week", 5), ("tech_ret_250", 250), ("tech_cum_ret_10", 10))},
        "tech_ret_ytd": safe_div(c, of("close", "first", 300)) - 1,
        **{n: safe_div(c, mean("close", k)) - 1 for n, k in (("tech_ma5_dev", 5), ("tech_ma20_dev", 20), ("tech_ma60_dev", 60), ("tech_close_ma250", 250))},
        "tech_rsi6": strength(6),
        "tech_rsi14": strength(14),
        "tech_rsi_diff": strength(20) - strength(50),
        "tech_kdj_j": j,
        "tech_macd_hist": hist,
        "tech_macd_gold": F.coalesce(of("gold", "max", 3), F.lit(0.0)),
        "tech_vol20": of("ret", "std", 20),
        "tech_vol_skew": of("ret", "skew", 60),
        "tech_drawdown_60": fall,
        "tech_calmar_60": safe_div(change(59), F.abs(fall)),
        "tech_cci20": F.when(off >= 1e-9, safe_div(typ - mean("typ", 20), off * 0.015)).otherwise(0.0),
        "tech_vol_ma20": safe_div(v, mean("volume", 20)),
        "tech_vol_std20": safe_div(of("volume", "std", 20), mean("volume", 20)),
        "tech_turnover_z": safe_div(F.col("turnover") - mean("turnover", 20), of("turnover", "std", 20)),
        "tech_obv_slope": of("obv", "slope", 25),
        "tech_obv_trend": safe_div(mean("obv", 20) - obv64, F.abs(mean("obv", 60) - obv64)),
        "tech_gap_up": safe_div(o, "__before") - 1,
        "tech_high_52w_pos": place(c, of("close", "min", 250), of("close", "max", 250)),
        **{n: change(k) for n, k in (("mom20", 20), ("mom1m", 21), ("mom3m", 63), ("mom6m", 126), ("mom12m", 252))},
        "rev5": -change(5),
        "macd_cross": safe_div(hist - F.col("__hist_lag_1"), c) * 100,
        "macd_hist": hist * 2,
        "macd_div": bottom_div - top_div,
        "cci_20": safe_div(typ - mean("typ", 20), mean("off", 20) * 0.015),
        "high_low_pos": F.when(top252 > bottom252, place(c, bottom252, top252)).otherwise(0.5),
        "volume_surge": safe_div(v, mean("volume_lag_1", 20)),
        "volume_ratio": safe_div(v, mean("volume_lag_1", 5)),
        "obv_slope": of("obv", "slope", 20) / (F.abs(mean("obv", 20) - of("obv", "lag", 299)) + 1e-9),
        "atr_ratio": safe_div(mean("range", 14), c),
        "amihud_illiq": mean("cost", 20) * 1e6,
        "spread_approx": mean("spread", 20),
        "kdj": j,
        "williams": safe_div(high14 - c, high14 - low14) * 100,
        "boll_width": safe_div(sd, mid) * 4,
        "boll_pos": F.when(4 * sd >= 1e-9, (c - mid + 2 * sd) / (4 * sd)).otherwise(0.5),
        "rsi14": F.coalesce(F.when((mean("loss", 14) == 0) & (mean("gain", 14) > 0), 100.0).otherwise(100 - 100 / (1 + safe_div(mean("gain", 14), mean("loss", 14)))), F.lit(50.0)),
    }
    return rows.select(key, time, *(made[n].alias(n) for n in (*TECHNICAL, *CLASSIC)))
