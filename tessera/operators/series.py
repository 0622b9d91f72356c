"""Named factor series over one key's ordered bars: formulaic alphas, and series of bars.

A window can't hold another, so each set is built in layers of columns; all of them share one key and
order, thus one shuffle. Bars have open, high, low, close, volume, amount. A quotient by zero is missing, as
is a value whose window lacks a known row. Columns whose names begin with two underscores are dropped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.functions.expr import enough, ordered, pct_change, pct_rank, rolling, safe_div, trailing
from tessera.operators.rolled import quotient, rolled, sorted_by
from tessera.operators.timeseries import ts_rank

#: What is added to a divisor, decay of the smoothed range, and rows after which it is below rounding.
TINY = 1e-8
DECAY = 2 / 7
DECAY_ROWS = 128

BAR_SERIES = (
    "vwap_bias", "amt_trend", "volume_std_20", "high_low_range_20", "gap_up_5d", "mom_risk_adj", "res_mom_approx", "wma_mom", "skew_20", "kurt_20",
    "ofi_approx", "amihud_5d", "roll_spread", "alpha_rank_cm", "alpha_corr_cv", "alpha_tsrank_20", "alpha_delta_vol_5", "candle_strength",
)
ALPHAS = tuple(f"gtja_{n:03d}" for n in (1, 2, 3, 5, 6, 7, 8, 9, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20))


def layered(df: DataFrame, *layers: dict[str, Column]) -> DataFrame:
    for layer in layers:
        df = df.withColumns(layer)
    return df


def steady_corr(x: str, y: str, w: WindowSpec, n: int) -> Column:
    """Correlation in the last n rows, all known; missing where either varies by rounding only."""
    frame = trailing(w, n)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.stddev_pop(a).over(frame) * F.stddev_pop(b).over(frame)
    return enough(a, F.when(spread > 1e-12, F.covar_pop(a, b).over(frame) / spread), frame, n)


def smoothed(value: str, w: WindowSpec) -> Column:
    """Exponential mean that starts at the first known value; older rows than DECAY_ROWS weigh less than rounding.
    Unknown values are passed over."""
    seen = F.collect_list(value).over(trailing(w, DECAY_ROWS))
    return F.aggregate(seen, F.lit(None).cast("double"), lambda s, v: F.when(s.isNull(), v).otherwise(s * (1 - DECAY) + v * DECAY))


def _rolled(panel: DataFrame, bars: tuple[str, ...], specs: dict[str, tuple], key: str, time: str) -> tuple[DataFrame, dict[str, Column]]:
    """The bars with the columns of ``specs``, and these by name; their names begin with two underscores."""
    named = lambda c: c if c in bars else f"__{c}"
    under = {f"__{n}": (how, named(of) if isinstance(of, str) else tuple(map(named, of)), *rest) for n, (how, of, *rest) in specs.items()}
    return rolled(sorted_by(panel.select(key, time, *bars), key, time), under, key), {n: F.col(f"__{n}") for n, s in specs.items() if not callable(s[0])}


def bar_series(panel: DataFrame, key: str = "code", time: str = "date") -> DataFrame:
    """Key, time, and BAR_SERIES: value and trend of trading, ranges, adjusted momentum, moments, spreads."""
    c, a, v = F.col("close"), F.col("amount"), F.col("volume")
    bars = ("open", "high", "low", "close", "volume", "amount")
    specs = {
        "row": ("row", "close", 1), **{f"c_lag_{n}": ("lag", "close", n) for n in (1, 20)}, "v_lag_5": ("lag", "volume", 5), "c_mean": ("mean", "close", 20), "v_mean": ("mean", "volume", 20), "v_std": ("std", "volume", 20), "a_mean": ("mean", "amount", 20),
        "ret": (lambda c, b: quotient(c, b) - 1, ("close", "c_lag_1"), 0), "move": (np.subtract, ("close", "c_lag_1"), 0), "moved": ("lag", "move", 1), "pair": (np.multiply, ("move", "moved"), 0), "cost": (lambda r, a: quotient(abs(r), a), ("ret", "amount"), 0),
        "mom": (lambda c, b: quotient(c, b) - 1, ("close", "c_lag_20"), 0), "range": (lambda h, low, c: quotient(h - low, c), ("high", "low", "close"), 0), "gap": (lambda o, b: quotient(o, b) - 1 > 0.005, ("open", "c_lag_1"), 0),
        "side": (lambda c, o: np.sign(c - o), ("close", "open"), 0), "body": (lambda c, o, h, low: quotient(c - o, h - low), ("close", "open", "high", "low"), 0), "placed": (np.multiply, ("close", "row"), 0), "c_sum": ("sum", "close", 20), "p_sum": ("sum", "placed", 20),
        "wma": (lambda p, row, s: (p - (row - 20) * s) / 210, ("p_sum", "row", "c_sum"), 0), "w": ("lag", "wma", 0), "w_lag_5": ("lag", "wma", 5), "ret_std": ("std", "ret", 20), "skew": ("skew", "ret", 20), "kurt": ("kurt", "ret", 20),
        "mom_mean": ("mean", "mom", 60), "range_mean": ("mean", "range", 20), "gaps": ("sum", "gap", 5), "sides": ("sum", "side", 5), "cost_mean": ("mean", "cost", 5), "cov": ("mean", "pair", 20), "fit": ("corr", ("close", "volume"), 10), "below": ("below", "close", 20), "strength": ("mean", "body", 20),
    }
    rows, x = _rolled(panel, bars, specs, key, time)
    mom = safe_div(c, x["c_lag_20"]) - 1
    made = {
        "vwap_bias": (safe_div(c, safe_div(a, v)) - 1) * 100,
        "amt_trend": (safe_div(a, x["a_mean"]) - 1) * 100,
        "volume_std_20": safe_div(x["v_std"], x["v_mean"]),
        "high_low_range_20": x["range_mean"] * 100,
        "gap_up_5d": x["gaps"],
        "mom_risk_adj": safe_div(mom, x["ret_std"]),
        "res_mom_approx": mom - x["mom_mean"],
        "wma_mom": (safe_div(x["w"], x["w_lag_5"]) - 1) * 100,
        "skew_20": x["skew"],
        "kurt_20": x["kurt"],
        "ofi_approx": x["sides"],
        "amihud_5d": x["cost_mean"],
        "roll_spread": F.when(x["cov"] < 0, 2 * F.sqrt(-x["cov"])),
        "alpha_rank_cm": (safe_div(c, x["c_mean"]) - 1) * 100,
        "alpha_corr_cv": x["fit"],
        "alpha_tsrank_20": x["below"],
        "alpha_delta_vol_5": (safe_div(v, x["v_lag_5"]) - 1) * 100,
        "candle_strength": x["strength"],
    }
    return rows.select(key, time, *(made[n].alias(n) for n in BAR_SERIES))


def _end_places(rows: DataFrame, names: tuple[str, ...], w: WindowSpec) -> DataFrame:
    """The named values replaced by the share that the key's last one takes among all of them (ties averaged), by counting
    what is below it: no sort by value."""
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({f"{n}_end": F.last(n).over(whole) for n in names})
    below = lambda n: F.count_if(F.col(n) < F.col(f"{n}_end")).over(whole)
    same = lambda n: F.count_if(F.col(n) == F.col(f"{n}_end")).over(whole)
    places = {n: F.when(F.col(f"{n}_end").isNotNull(), (below(n) + (same(n) + 1) / 2.0) / F.count(n).over(whole)) for n in names}
    kept = [c for c in rows.columns if c not in names and c.removesuffix("_end") not in names]
    return rows.select(*kept, *(x.alias(n) for n, x in places.items()))


def alphas(panel: DataFrame, key: str = "code", time: str = "date") -> DataFrame:
    """Key, time, and ALPHAS. Alphas that rank a value in the key's whole history (6, 7, 8, 12 and 17) are known at
    its last row only; the others at every row with enough rows before it."""
    w = ordered(key, time)
    c, o, h, low = (F.col(x) for x in ("close", "open", "high", "low"))

    def delta(x: Column, n: int) -> Column:
        return x - F.lag(x, n).over(w)

    def known(x: Column, other: float = 0.0) -> Column:
        return F.coalesce(x, F.lit(other))

    def relative(x: Column, n: int) -> Column:
        return delta(x, n) / (F.lag(x, n).over(w) + TINY)

    before, typical, v = F.col("__before"), F.col("__typ"), F.col("__v")
    pressure = F.when(before.isNull() | (c == before), 0.0).when(c > before, c - F.least(low, before)).otherwise(c - F.greatest(h, before))
    rows = layered(
        panel,
        {"__v": F.when(F.col("volume") != 0, F.col("volume").cast("double")), "__typ": (h + low + c) / 3, "__before": F.lag(c).over(w), "__place": ((c - low) - (h - c)) / (h - low + TINY), "__last": F.lead(F.lit(1)).over(w).isNull()},
        {
            "__dv": F.round(delta(F.log(v), 1), 12), "__body": (c - o) / (o + TINY), "__pressure": pressure, "__flow": F.col("__place") * v, "__gap": typical - c,
            "__mix": (h + low) / 2 * 0.2 + typical * 0.8, "__opens": o * 0.85 + h * 0.15, "__from_open": o - typical,
            "__span": ((h + low) / 2 - (F.lag(h).over(w) + F.lag(low).over(w)) / 2) * (h - low) / (v + TINY), "__fall": typical - F.coalesce(rolling(typical, "max", w, 15), typical),
        },
        {
            "__rank_dv": ts_rank("__dv", 6, w), "__rank_body": ts_rank("__body", 6, w), "__rank_v": ts_rank("__v", 5, w), "__rank_h": ts_rank("high", 5, w), "__rank_typ": ts_rank("__typ", 5, w),
            "__sign": F.signum(known(delta(F.col("__opens"), 4))), "__least": known(rolling("__gap", "min", w, 3)), "__dv3": known(delta(v, 3)), "__dmix": -known(delta(F.col("__mix"), 4)),
        },
        {"__corr_vh": steady_corr("__rank_v", "__rank_h", w, 5), "__corr_vt": steady_corr("__rank_v", "__rank_typ", w, 5), "__both": known(rolling("__gap", "max", w, 3)) + pct_rank("__least", [key]) * pct_rank("__dv3", [key])},
    )
    change = delta(c, 5)
    made = {
        "gtja_001": -steady_corr("__rank_dv", "__rank_body", w, 6),
        "gtja_002": -delta(F.col("__place"), 1),
        "gtja_003": rolling("__pressure", "sum", w, 6),
        "gtja_005": -rolling("__corr_vh", "max", w, 3),
        "gtja_009": smoothed("__span", w),
        "gtja_011": rolling("__flow", "sum", w, 6),
        "gtja_013": F.sqrt(h * low) - typical,
        "gtja_014": change,
        "gtja_015": o / (before + TINY) - 1,
        "gtja_016": -rolling("__corr_vt", "max", w, 5),
        "gtja_018": c / (F.lag(c, 5).over(w) + TINY) - 1,
        "gtja_019": F.when(change > 0, safe_div(change, c)).otherwise(relative(c, 5)),
        "gtja_020": relative(c, 6) * 100,
    }
    ranked = ("__sign", "__both", "__dmix", "__from_open", "__below", "__fall")
    rows = rows.withColumn("__below", -F.col("__gap"))
    # values of the row first: lists of a window are folded here and go through no later sort
    rows = rows.select(key, time, "__last", *ranked, F.signum(known(change)).alias("__change"), *(made[n].alias(n) for n in made))
    place = _end_places(rows, ranked, w)
    at_end = {
        "gtja_006": -F.col("__sign"), "gtja_007": F.col("__both"), "gtja_008": F.col("__dmix"),
        "gtja_012": F.col("__from_open") * F.col("__below"), "gtja_017": F.col("__change") * F.col("__fall"),
    }
    return place.select(key, time, *(F.when(F.col("__last"), at_end[n]).alias(n) if n in at_end else F.col(n) for n in ALPHAS))


LEVEL_SERIES = (
    "tech_mom_accel", "tech_ret_20_60", "tech_ma_bull", "tech_ma20_slope", "tech_ma_cross_5_20", "tech_dmi_plus", "tech_sharpe_60", "tech_sortino_60", "tech_vol_contract", "tech_atr_pct",
    "tech_boll_pos", "tech_boll_width", "tech_williams_r", "tech_hl_range10", "tech_vol_ratio", "tech_amount_trend", "tech_amount_z", "tech_price_vol_div", "tech_candle_body", "tech_upper_shadow",
    "tech_high_20d", "tech_low_20d", "tech_close_pos", "tech_breakout_20", "tech_gap_fill", "tech_consec_up", "tech_up_down_ratio", "ma_cross", "bias12", "new_high_dist", "new_low_dist", "volume_trend",
    "vol_20d", "volume_price_fit", "realized_vol", "downside_vol", "max_dd_12m", "vol_change", "amount_liquidity", "turnover_stability", "dmi", "donchian", "ma_trend", "beta_60d", "downside_beta",
)
#: Fixed value: sessions of a year.
YEAR = 252


def level_series(panel: DataFrame, key: str = "code", time: str = "date") -> DataFrame:
    """Key, time, and LEVEL_SERIES: trends, channels, ranges, volumes and risks that windows alone can give. Flags are
    0 where their window is not full; places in a channel are 0.5 where it has no width."""
    c, o, h, low, v, a = (F.col(x) for x in ("close", "open", "high", "low", "volume", "amount"))

    def flag(test: Column) -> Column:
        return F.coalesce(test.cast("double"), F.lit(0.0))

    def channel(top: Column, bottom: Column) -> Column:
        return F.when(top > bottom, (c - bottom) / (top - bottom)).otherwise(0.5)

    bars = ("close", "open", "high", "low", "volume", "amount")
    specs = {f"{s}_lag_{n}": ("lag", x, n) for x, s, n in (("close", "c", 1), ("close", "c", 5), ("close", "c", 20), ("close", "c", 60), ("high", "h", 1), ("low", "l", 1), ("volume", "v", 1), ("volume", "v", 5), ("amount", "a", 5))}
    specs |= {f"{s}_{how}_{n}": (how, x, n) for x, s, how, sizes in (
        ("close", "c", "mean", (5, 12, 20, 60)), ("close", "c", "std", (20,)), ("close", "c", "min", (20,)), ("close", "c", "max", (20,)), ("high", "h", "max", (10, 14, 20, 60)), ("high", "h", "mean", (10,)), ("low", "l", "min", (10, 14, 20, 60)),
        ("volume", "v", "mean", (5, 20)), ("volume", "v", "sum", (5, 20)), ("volume", "v", "pop", (20,)), ("amount", "a", "mean", (5, 20)), ("amount", "a", "std", (20,)),
    ) for n in sizes}
    specs |= {
        "c_top_250": ("max", "close", 250, 2), "m5_before": ("lag", "c_mean_5", 1), "m20_before": ("lag", "c_mean_20", 1), "m20_lag_5": ("lag", "c_mean_20", 5),
        "v_before_5": ("mean", "v_lag_1", 5), "a_before_6": ("mean", "a_lag_5", 6), "h_before_20": ("max", "h_lag_1", 20), "l_before_20": ("min", "l_lag_1", 20),
    }
    moved = lambda ahead, behind: np.where((ahead > behind) & (ahead > 0), ahead, 0.0)
    specs |= {
        "ret": (lambda c, b: quotient(c, b) - 1, ("close", "c_lag_1"), 0), "dv": (lambda v, b: quotient(v, b) - 1, ("volume", "v_lag_1"), 0), "range": (lambda h, low, b: np.fmax(h - low, np.fmax(abs(h - b), abs(low - b))), ("high", "low", "c_lag_1"), 0),
        "rise": (np.subtract, ("high", "h_lag_1"), 0), "fall": (np.subtract, ("l_lag_1", "low"), 0), "up": (lambda x: np.maximum(x, 0.0), ("rise",), 0), "plus": (moved, ("rise", "fall"), 0), "minus": (moved, ("fall", "rise"), 0),
        "cross": (lambda a, b, c, d: (a > b) & (c <= d), ("c_mean_5", "c_mean_20", "m5_before", "m20_before"), 0), "rises": (lambda r: r > 0, ("ret",), 0), "falls": (lambda r: r < 0, ("ret",), 0),
        "loss": (lambda r: np.minimum(r, 0.0), ("ret",), 0), "square": (np.multiply, ("loss", "loss"), 0), "lost": (lambda x, down: np.where(np.isnan(x), np.nan, down), ("loss", "falls"), 0),
    }
    specs |= {f"{s}_{how}_{n}": (how, s, n) for s, how, sizes in (
        ("ret", "mean", (60,)), ("ret", "std", (5, 60)), ("ret", "pop", (20, 60)), ("up", "mean", (14,)), ("range", "mean", (14,)), ("range", "sum", (14,)), ("plus", "sum", (14,)), ("minus", "sum", (14,)), ("cross", "max", (3,)),
        ("rises", "sum", (20,)), ("falls", "sum", (20,)), ("loss", "sum", (60,)), ("loss", "mean", (60,)), ("square", "sum", (60,)), ("lost", "sum", (60,)),
    ) for n in sizes} | {"fit": ("corr", ("ret", "dv"), 20), "rising": ("streak", "ret", 1)}
    rows, x = _rolled(panel, bars, specs, key, time)
    n_loss = x["lost_sum_60"]
    sd_loss = F.sqrt(F.greatest(safe_div(x["square_sum_60"], n_loss) - F.pow(safe_div(x["loss_sum_60"], n_loss), 2), F.lit(0.0)))
    low_risk = F.when((n_loss < 2) | (sd_loss < 1e-9), 1.0).otherwise(sd_loss)
    sum_loss = x["loss_mean_60"] * 100
    change = {n: safe_div(c, x[f"c_lag_{n}"]) - 1 for n in (5, 20, 60)}
    pop20, mid, sd = x["ret_pop_20"], x["c_mean_20"], x["c_std_20"]
    made = {
        "tech_mom_accel": change[20] - change[60],
        "tech_ret_20_60": safe_div(change[20], F.abs(change[60])),
        "tech_ma_bull": F.greatest(flag(x["c_mean_5"] > mid), flag(mid > x["c_mean_60"]), flag(c > x["c_mean_5"])),
        "tech_ma20_slope": safe_div(mid, x["m20_lag_5"]) - 1,
        "tech_ma_cross_5_20": F.coalesce(x["cross_max_3"], F.lit(0.0)),
        "tech_dmi_plus": safe_div(x["up_mean_14"] * 100, x["range_mean_14"]),
        "tech_sharpe_60": safe_div(x["ret_mean_60"], x["ret_std_60"]) * YEAR**0.5,
        "tech_sortino_60": safe_div(x["ret_mean_60"], low_risk) * YEAR**0.5,
        "tech_vol_contract": safe_div(x["ret_std_5"], x["ret_std_60"]),
        "tech_atr_pct": safe_div(x["range_mean_14"], c),
        "tech_boll_pos": F.when(sd >= 1e-9, (c - mid + 2 * sd) / (4 * sd)).otherwise(0.5),
        "tech_boll_width": safe_div(sd, mid) * 4,
        "tech_williams_r": safe_div(x["h_max_14"] - c, x["h_max_14"] - x["l_min_14"]) * -100,
        "tech_hl_range10": safe_div(x["h_max_10"] - x["l_min_10"], x["h_mean_10"]),
        "tech_vol_ratio": safe_div(v, x["v_before_5"]),
        "tech_amount_trend": safe_div(x["a_mean_5"], x["a_before_6"]) - 1,
        "tech_amount_z": safe_div(a - x["a_mean_20"], x["a_std_20"]),
        "tech_price_vol_div": change[5] - (safe_div(v, x["v_lag_5"]) - 1),
        "tech_candle_body": safe_div(c - o, x["c_lag_1"]),
        "tech_upper_shadow": safe_div(h - F.greatest(c, o), h),
        "tech_high_20d": flag(h >= x["h_before_20"]),
        "tech_low_20d": flag(low <= x["l_before_20"]),
        "tech_close_pos": safe_div(c - x["c_min_20"], x["c_max_20"] - x["c_min_20"]),
        "tech_breakout_20": safe_div(c, x["h_before_20"]) - 1,
        "tech_gap_fill": flag((o > x["c_lag_1"] * 1.005) & (low <= x["c_lag_1"])),
        "tech_consec_up": x["rising"],
        "tech_up_down_ratio": safe_div(x["rises_sum_20"], x["falls_sum_20"]),
        "ma_cross": safe_div(x["c_mean_5"], mid) - 1,
        "bias12": (safe_div(c, x["c_mean_12"]) - 1) * 100,
        "new_high_dist": (safe_div(c, x["h_max_60"]) - 1) * 100,
        "new_low_dist": (safe_div(c, x["l_min_60"]) - 1) * 100,
        "volume_trend": safe_div(x["v_mean_5"], (x["v_sum_20"] - x["v_sum_5"]) / 15) - 1,
        "vol_20d": F.log1p(x["v_mean_20"]),
        "volume_price_fit": x["fit"],
        "realized_vol": pop20 * YEAR**0.5 * 100,
        "downside_vol": F.when(n_loss < 3, 0.0).otherwise(sd_loss * YEAR**0.5 * 100),
        "max_dd_12m": (safe_div(c, x["c_top_250"]) - 1) * 100,
        "vol_change": safe_div(pop20, x["ret_pop_60"]) - 1,
        "amount_liquidity": F.log1p(x["a_mean_20"]),
        "turnover_stability": -safe_div(x["v_pop_20"], x["v_mean_20"]),
        "dmi": safe_div((x["plus_sum_14"] - x["minus_sum_14"]) * 100, x["range_sum_14"]),
        "donchian": channel(x["h_max_20"], x["l_min_20"]),
        "ma_trend": safe_div(mid, x["c_mean_60"]) - 1,
        "beta_60d": x["ret_mean_60"] * 100,
        "downside_beta": F.when(sum_loss == 0, 1.0).otherwise(sum_loss),
    }
    return rows.select(key, time, *(made[n].alias(n) for n in LEVEL_SERIES))
