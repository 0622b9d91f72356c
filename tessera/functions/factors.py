"""A registry of factors: name, family, direction, and a builder of native columns over one key's ordered rows.

Most factors are families over horizons, so they are made from rules and not listed one by one. Users add
their own with ``register``; a name that is there is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tessera.functions.expr import enough, ordered, pct_change, rolling, rolling_pair, safe_div, trailing

Builder = Callable[[WindowSpec], Column]


@dataclass(frozen=True)
class Factor:
    name: str
    family: str
    direction: int
    build: Builder
    #: The same for ``operators.rolled``: a function of windows there (see ``ROLLED``), the last one under the factor's name.
    windows: Callable[[], dict[str, tuple]] | None = None


FACTORS: dict[str, Factor] = {}


def register(name: str, family: str, direction: int = 1, windows: Callable[[], dict[str, tuple]] | None = None) -> Callable[[Builder], Builder]:
    def add(build: Builder) -> Builder:
        FACTORS[name] = Factor(name, family, direction, build, windows)
        return build

    return add


def _families(n: int) -> dict[str, Builder]:
    """The builders of every family at horizon n; ``ret`` and ``rank`` columns are made by ``with_factors`` first."""
    ret, close, high, low, volume, amount = (F.col(c) for c in ("ret", "close", "high", "low", "volume", "amount"))

    def range_place(w: WindowSpec) -> Column:
        top, bottom = rolling(high, "max", w, n), rolling(low, "min", w, n)
        return safe_div(close - bottom, top - bottom)

    def part(keep: Column, w: WindowSpec) -> Column:
        return enough(ret, F.sqrt(F.avg(F.when(ret.isNotNull(), F.pow(F.when(keep, ret).otherwise(0.0), 2))).over(trailing(w, n))), trailing(w, n), n)

    return {
        "mom": lambda w: pct_change(close, w, n),
        "rev": lambda w: -pct_change(close, w, n),
        "ma_gap": lambda w: safe_div(close, rolling(close, "mean", w, n)) - 1,
        "place": range_place,
        "near_high": lambda w: safe_div(close, rolling(high, "max", w, n)),
        "near_low": lambda w: safe_div(close, rolling(low, "min", w, n)),
        "up_share": lambda w: enough(ret, F.avg(F.when(ret.isNotNull(), (ret > 0).cast("double"))).over(trailing(w, n)), trailing(w, n), n),
        "vol": lambda w: rolling(ret, "std", w, n),
        "down_vol": lambda w: part(ret < 0, w),
        "up_vol": lambda w: part(ret > 0, w),
        "skew": lambda w: rolling(ret, "skew", w, n),
        "kurt": lambda w: rolling(ret, "kurt", w, n),
        "max_ret": lambda w: rolling(ret, "max", w, n),
        "min_ret": lambda w: rolling(ret, "min", w, n),
        "range": lambda w: rolling(safe_div(high - low, close), "mean", w, n),
        "illiquid": lambda w: rolling(safe_div(F.abs(ret), amount) * 1e6, "mean", w, n),
        "volume_ratio": lambda w: safe_div(volume, rolling(volume, "mean", w, n)),
        "volume_cv": lambda w: safe_div(rolling(volume, "std", w, n), rolling(volume, "mean", w, n)),
        "amount_mean": lambda w: F.log(rolling(amount, "mean", w, n)),
        "price_volume": lambda w: rolling_pair(close, volume, "corr", w, n),
        "ret_volume": lambda w: rolling_pair(ret, volume, "corr", w, n),
        "vwap_gap": lambda w: safe_div(close, safe_div(F.sum(close * volume).over(trailing(w, n)), F.sum(volume).over(trailing(w, n)))) - 1,
        "sharpe": lambda w: safe_div(rolling(ret, "mean", w, n), rolling(ret, "std", w, n)),
        "gap": lambda w: rolling(safe_div(F.col("open"), F.lag("close").over(w)) - 1, "mean", w, n),
        "intraday": lambda w: rolling(safe_div(close, F.col("open")) - 1, "mean", w, n),
    }


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b == 0, np.nan, a / b)


def _square_where(test: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    return lambda ret: np.where(np.isnan(ret), np.nan, np.where(test(ret), ret, 0.0) ** 2)


#: Columns of a row and the one before it that windows of families are made of, as ``operators.rolled`` takes them.
ROLLED: dict[str, tuple] = {
    "__last": ("lag", "close", 1),
    "__ret": (lambda close, last: _over(close, last) - 1, ("close", "__last"), 0),
    "__open_gap": (lambda open, last: _over(open, last) - 1, ("open", "__last"), 0),
    "__day": (lambda close, open: _over(close, open) - 1, ("close", "open"), 0),
    "__span": (lambda high, low, close: _over(high - low, close), ("high", "low", "close"), 0),
    "__impact": (lambda ret, amount: _over(abs(ret), amount) * 1e6, ("__ret", "amount"), 0),
    "__rise": (lambda ret: np.where(np.isnan(ret), np.nan, ret > 0), ("__ret",), 0),
    "__down": (_square_where(lambda ret: ret < 0), ("__ret",), 0),
    "__up": (_square_where(lambda ret: ret > 0), ("__ret",), 0),
    "__traded": (lambda close, volume: close * volume, ("close", "volume"), 0),
}


def _family_windows(n: int) -> dict[str, tuple[dict[str, tuple], tuple]]:
    """Of every family at horizon n the windows that it uses, and itself from these."""
    own = lambda how, source: ({}, (how, source, n))
    window = {f"__{how}_{c.strip('_')}_{n}": (how, c, n) for how, c in (
        ("mean", "close"), ("max", "high"), ("min", "low"), ("lag", "close"), ("mean", "__down"), ("mean", "__up"), ("mean", "volume"), ("std", "volume"), ("mean", "amount"), ("total", "__traded"), ("total", "volume"), ("mean", "__ret"), ("std", "__ret"))}

    def made(how: Callable, *of: str) -> tuple[dict[str, tuple], tuple]:
        names = [f"__{c}_{n}" if f"__{c}_{n}" in window else c for c in of]
        return {c: window[c] for c in names if c in window}, (how, tuple(names), 0)

    return {
        "mom": made(lambda x, y: _over(x, y) - 1, "close", "lag_close"), "rev": made(lambda x, y: -(_over(x, y) - 1), "close", "lag_close"), "ma_gap": made(lambda x, y: _over(x, y) - 1, "close", "mean_close"),
        "place": made(lambda x, top, bottom: _over(x - bottom, top - bottom), "close", "max_high", "min_low"), "near_high": made(_over, "close", "max_high"), "near_low": made(_over, "close", "min_low"),
        "up_share": own("mean", "__rise"), "vol": own("std", "__ret"), "down_vol": made(np.sqrt, "mean_down"), "up_vol": made(np.sqrt, "mean_up"), "skew": own("skew", "__ret"), "kurt": own("kurt", "__ret"),
        "max_ret": own("max", "__ret"), "min_ret": own("min", "__ret"), "range": own("mean", "__span"), "illiquid": own("mean", "__impact"), "volume_ratio": made(_over, "volume", "mean_volume"),
        "volume_cv": made(_over, "std_volume", "mean_volume"), "amount_mean": made(lambda x: np.log(np.where(x > 0, x, np.nan)), "mean_amount"), "price_volume": own("rho", ("close", "volume")), "ret_volume": own("rho", ("__ret", "volume")),
        "vwap_gap": made(lambda x, traded, volume: _over(x, _over(traded, volume)) - 1, "close", "total_traded", "total_volume"), "sharpe": made(_over, "mean_ret", "std_ret"),
        "gap": own("mean", "__open_gap"), "intraday": own("mean", "__day"),
    }


def _rolled(name: str, n: int) -> dict[str, tuple]:
    windows, last = _family_windows(n)[name]
    return windows | {f"{name}_{n}": last}


HORIZONS = (5, 10, 20, 60)
#: Families: what they measure, and whether more (1) or less (-1) is taken to be better.
FAMILIES = {
    "mom": ("momentum", 1), "rev": ("reversal", 1), "ma_gap": ("momentum", 1), "place": ("momentum", 1), "near_high": ("momentum", 1), "near_low": ("reversal", -1), "up_share": ("momentum", 1),
    "vol": ("risk", -1), "down_vol": ("risk", -1), "up_vol": ("risk", 1), "skew": ("risk", -1), "kurt": ("risk", -1), "max_ret": ("lottery", -1), "min_ret": ("lottery", 1), "range": ("risk", -1),
    "illiquid": ("liquidity", 1), "volume_ratio": ("liquidity", -1), "volume_cv": ("liquidity", -1), "amount_mean": ("size", -1), "price_volume": ("volume", -1), "ret_volume": ("volume", -1),
    "vwap_gap": ("volume", -1), "sharpe": ("momentum", 1), "gap": ("overnight", -1), "intraday": ("intraday", 1),
}
for _n in HORIZONS:
    for _name, (_family, _direction) in FAMILIES.items():
        register(f"{_name}_{_n}", _family, _direction, lambda n=_n, name=_name: _rolled(name, n))(lambda w, n=_n, name=_name: _families(n)[name](w))


def with_factors(panel: DataFrame, names: list[str], key: str = "code", time: str = "date") -> DataFrame:
    """The panel with the named factors; all windows share one key and order, so one shuffle serves them all."""
    unknown = [n for n in names if n not in FACTORS]
    if unknown:
        raise KeyError(f"unknown factors: {unknown}")
    w = ordered(key, time)
    rows = panel.withColumn("ret", pct_change("close", w))
    # a lag inside a window must be a column first
    rows = rows.withColumn("__gap", safe_div("open", F.lag("close").over(w)) - 1)
    made = {n: rolling("__gap", "mean", w, int(n.rsplit("_", 1)[1])) if n.startswith("gap_") else FACTORS[n].build(w) for n in names}
    return rows.select(*panel.columns, "ret", *(c.alias(n) for n, c in made.items()))


def rolled_windows(names: list[str]) -> dict[str, tuple]:
    """What ``operators.rolled`` makes the named factors of, each column once; they are those of ``with_factors``."""
    made = dict(ROLLED)
    for n in names:
        made |= FACTORS[n].windows()
    used = set(names)
    for c in reversed(made):  # each uses those before it
        if c in used:
            used |= {made[c][1]} if isinstance(made[c][1], str) else set(made[c][1])
    return {c: s for c, s in made.items() if c in used}


def long_factors(panel: DataFrame, names: list[str], key: str = "code", time: str = "date") -> DataFrame:
    """(key, time, factor, value), values turned so that more is better."""
    wide = with_factors(panel, names, key, time)
    turned = wide.select(key, time, *((F.col(n) * FACTORS[n].direction).alias(n) for n in names))
    return turned.unpivot([key, time], names, "factor", "value").where("value is not null")
