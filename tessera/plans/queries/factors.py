"""The factor registry on the weekly price panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import factors as fz
from tessera.operators import chartseries as cs
from tessera.operators import evaluation as ev
from tessera.operators import series as sr
from tessera.operators.rolled import rolled, sorted_by
from tessera.operators.timeseries import forward_return
from tessera.plans.panel import PANEL, price_panel
from tessera.plans.registry import query, rounded

_W = "PARTITION BY code ORDER BY date"
_R = f"{PANEL}, r AS (SELECT *, close / nullif(lag(close) OVER ({_W}), 0) - 1 AS ret FROM panel)"
_T = f"WINDOW w AS ({_W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query(f"""WITH {_R}, s AS (SELECT code, date, close / nullif(lag(close, 10) OVER ({_W}), 0) - 1 AS mom, count(close) OVER w AS n, count(ret) OVER w AS m, avg(close) OVER w AS ma, max(high) OVER w AS hi, min(low) OVER w AS lo, close,
  stddev_samp(ret) OVER w AS sd, avg(ret) OVER w AS mr, max(ret) OVER w AS xr, avg((high - low) / nullif(close, 0)) OVER w AS rg, avg(volume) OVER w AS mv, stddev_samp(volume) OVER w AS sv, volume, avg(CASE WHEN ret IS NOT NULL THEN (ret > 0)::INT::DOUBLE END) OVER w AS up,
  sqrt(avg(CASE WHEN ret IS NOT NULL THEN pow(CASE WHEN ret < 0 THEN ret ELSE 0 END, 2) END) OVER w) AS dv, corr(close, volume) OVER w AS pv FROM r {_T})
  SELECT code, date, round(mom, 6) AS mom_10, CASE WHEN n >= 10 THEN round(close / nullif(ma, 0) - 1, 6) END AS ma_gap_10, CASE WHEN n >= 10 THEN round((close - lo) / nullif(hi - lo, 0), 6) END AS place_10, CASE WHEN m >= 10 THEN round(sd, 6) END AS vol_10,
  CASE WHEN m >= 10 THEN round(dv, 6) END AS down_vol_10, CASE WHEN m >= 10 THEN round(xr, 6) END AS max_ret_10, CASE WHEN n >= 10 THEN round(rg, 6) END AS range_10, CASE WHEN n >= 10 THEN round(volume / nullif(mv, 0), 8) END AS volume_ratio_10,
  CASE WHEN n >= 10 THEN round(sv / nullif(mv, 0), 6) END AS volume_cv_10, CASE WHEN m >= 10 THEN round(up, 6) END AS up_share_10, CASE WHEN n >= 10 THEN round(pv, 6) END AS price_volume_10, CASE WHEN m >= 10 THEN round(mr / nullif(sd, 0), 6) END AS sharpe_10 FROM s""")
def factor_panel_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"{n}_10" for n in ("mom", "ma_gap", "place", "vol", "down_vol", "max_ret", "range", "volume_ratio", "volume_cv", "up_share", "price_volume", "sharpe")]
    rows = fz.with_factors(price_panel(spark, sf_dir), names)
    return rows.select("code", "date", *(F.round(n, 8 if n == "volume_ratio_10" else 6).alias(n) for n in names))


@query()
def factor_registry_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of every registered factor's rank coefficients with the return over the next four rows."""
    names = sorted(fz.FACTORS, key=lambda n: (fz.FACTORS[n].windows is None, n.rpartition("_")[2], n))  # by horizon, which know the same rows
    known = [n for n in names if fz.FACTORS[n].windows]
    bars = sorted_by(price_panel(spark, sf_dir).drop("industry"), "code", "date")
    rows = forward_return(bars, 4).drop("known_on")
    if len(known) < len(names):  # those that only have columns
        rows = fz.with_factors(rows, names[len(known) :]).drop("ret")
    sets = ev.sets_of(names, "forward", 25)
    blocks = rolled(rows, fz.rolled_windows(known), keep=known, into=ev.dealt(sets, "date", "date", "forward", {n: fz.FACTORS[n].direction for n in names}))
    return rounded(ev.ic_summary(ev.rank_ics_of(blocks, sets, least=8), by=("factor",)))


def _full(x: str, value: str, n: int) -> str:
    """``value`` over a named window wN of n rows, where all n values of x are known."""
    return f"CASE WHEN count({x}) OVER w{n} >= {n} THEN {value.format(x=x, w=f'w{n}')} END"


def _windows(*sizes: int) -> str:
    return "WINDOW w AS (" + _W + ")" + "".join(f", w{n} AS ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sizes)


def _mean(x: str, n: int) -> str:
    return _full(x, "avg({x}) OVER {w}", n)


def _corr(x: str, y: str, n: int) -> str:
    spread = f"(stddev_pop({x}) OVER w{n} * stddev_pop({y}) OVER w{n})"
    return f"CASE WHEN count({x} + {y}) OVER w{n} >= {n} AND {spread} > 1e-12 THEN covar_pop({x}, {y}) OVER w{n} / {spread} END"


#: Prices over whole quantities often end in a half at the last place: both engines add this before they round.
NUDGE = 1e-9
#: Places of sums of large amounts.
PLACES = {"gtja_009": 2, "gtja_011": 4, "tech_obv_slope": 3, "amihud_illiq": 5, "cci_20": 4, "tech_cci20": 4}


def _out(names: tuple[str, ...]) -> str:
    return ", ".join(f"round({n} + {NUDGE}, {PLACES.get(n, 6)}) + 0 AS {n}" for n in names)


def _shown(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The named values rounded. As lists: a column each would make one method too long for the JVM to compile."""
    digits = {n: PLACES.get(n, 6) for n in names}
    lists = {k: [n for n in names if digits[n] == k] for k in sorted(set(digits.values()))}
    to = lambda k: F.transform(F.array(*lists[k]), lambda v: F.round(v + NUDGE, k) + 0.0).alias(f"to_{k}")
    listed = rows.select("code", "date", *map(to, lists))
    return listed.select("code", "date", *(F.get(f"to_{digits[n]}", F.lit(lists[digits[n]].index(n))).alias(n) for n in names))


@query(f"""WITH {PANEL}, a AS (SELECT *, row_number() OVER w AS k, close / nullif(lag(close) OVER w, 0) - 1 AS ret, close - lag(close) OVER w AS mv, close / nullif(lag(close, 20) OVER w, 0) - 1 AS mom,
    (high - low) / nullif(close, 0) AS rg, coalesce((open / nullif(lag(close) OVER w, 0) - 1 > 0.005)::INT, 0)::DOUBLE AS gap, sign(close - open)::DOUBLE AS side, (close - open) / nullif(high - low, 0) AS body FROM panel {_windows()}),
  b AS (SELECT *, {_full("close", "list({x}) OVER {w}", 20)} AS l20, mv * lag(mv) OVER w AS pair, abs(ret) / nullif(amount, 0) AS cost, {_full("ret", "skewness({x}) OVER {w}", 20)} AS g1, {_full("ret", "kurtosis({x}) OVER {w}", 20)} AS g2 FROM a {_windows(20)}),
  c AS (SELECT *, list_dot_product(l20, list_transform(range(1, 21), lambda i: i::DOUBLE)) / 210 AS wma, {_mean("pair", 20)} AS cv FROM b {_windows(20)}),
  d AS (SELECT code, date, (close / nullif(amount / nullif(volume, 0), 0) - 1) * 100 AS vwap_bias, (amount / nullif({_mean("amount", 20)}, 0) - 1) * 100 AS amt_trend,
    {_full("volume", "stddev_samp({x}) OVER {w}", 20)} / nullif({_mean("volume", 20)}, 0) AS volume_std_20, {_mean("rg", 20)} * 100 AS high_low_range_20, {_full("gap", "sum({x}) OVER {w}", 5)} AS gap_up_5d,
    mom / nullif({_full("ret", "stddev_samp({x}) OVER {w}", 20)}, 0) AS mom_risk_adj, mom - {_mean("mom", 60)} AS res_mom_approx, (wma / nullif(lag(wma, 5) OVER w, 0) - 1) * 100 AS wma_mom, g1 AS skew_20, g2 AS kurt_20,
    {_full("side", "sum({x}) OVER {w}", 5)} AS ofi_approx, {_mean("cost", 5)} AS amihud_5d, CASE WHEN cv < 0 THEN 2 * sqrt(-cv) END AS roll_spread, (close / nullif({_mean("close", 20)}, 0) - 1) * 100 AS alpha_rank_cm,
    {_corr("close", "volume", 10)} AS alpha_corr_cv, len(list_filter(l20, lambda v: v < close)) / 20.0 AS alpha_tsrank_20, (volume / nullif(lag(volume, 5) OVER w, 0) - 1) * 100 AS alpha_delta_vol_5, {_mean("body", 20)} AS candle_strength FROM c {_windows(5, 10, 20, 60)})
  SELECT code, date, {_out(sr.BAR_SERIES)} FROM d""")
def factor_bar_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(sr.bar_series(price_panel(spark, sf_dir)), sr.BAR_SERIES)


def _rank(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER w{n} >= {n} THEN list({x}) OVER w{n} END AS {x}_l{n}"


def _placed(x: str, n: int) -> str:
    return f"(len(list_filter({x}_l{n}, lambda one: one < {x})) + (len(list_filter({x}_l{n}, lambda one: one = {x})) + 1) / 2.0) / {n} AS r_{x}"


def _share(x: str) -> str:
    return f"((rank() OVER (PARTITION BY code ORDER BY {x}) + (count(*) OVER (PARTITION BY code, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY code))"


@query(f"""WITH {PANEL}, a AS (SELECT *, nullif(volume, 0) AS v, (high + low + close) / 3 AS typ, lag(close) OVER w AS bf, ((close - low) - (high - close)) / (high - low + 1e-8::DOUBLE) AS pl, lag(close, 5) OVER w AS c5, lag(close, 6) OVER w AS c6,
    lag(high) OVER w AS hb, lag(low) OVER w AS lb, lead(1) OVER w IS NULL AS fin FROM panel {_windows()}),
  b AS (SELECT *, round(ln(v) - ln(lag(v) OVER w), 12) AS dl, (close - open) / (open + 1e-8::DOUBLE) AS body, CASE WHEN bf IS NULL OR close = bf THEN 0 WHEN close > bf THEN close - least(low, bf) ELSE close - greatest(high, bf) END AS ps, pl * v AS fl, typ - close AS gp,
    (high + low) / 2 * 0.2::DOUBLE + typ * 0.8::DOUBLE AS mx, open * 0.85::DOUBLE + high * 0.15::DOUBLE AS op, open - typ AS fo, close - typ AS fc, ((high + low) / 2 - (hb + lb) / 2) * (high - low) / (v + 1e-8::DOUBLE) AS sp,
    typ - coalesce({_full("typ", "max({x}) OVER {w}", 15)}, typ) AS fall FROM a {_windows(15)}),
  c AS (SELECT *, {_rank("dl", 6)}, {_rank("body", 6)}, {_rank("v", 5)}, {_rank("high", 5)}, {_rank("typ", 5)}, sign(coalesce(op - lag(op, 4) OVER w, 0)) AS sg, coalesce({_full("gp", "min({x}) OVER {w}", 3)}, 0) AS mn, coalesce({_full("gp", "max({x}) OVER {w}", 3)}, 0) AS mxg,
    coalesce(v - lag(v, 3) OVER w, 0) AS d3, -coalesce(mx - lag(mx, 4) OVER w, 0) AS dm, list(sp) FILTER (sp IS NOT NULL) OVER (w ROWS UNBOUNDED PRECEDING) AS sps FROM b {_windows(3, 5, 6)}),
  d AS (SELECT *, {_placed("dl", 6)}, {_placed("body", 6)}, {_placed("v", 5)}, {_placed("high", 5)}, {_placed("typ", 5)}, mxg + {_share("mn")} * {_share("d3")} AS bo FROM c),
  e AS (SELECT *, {_corr("r_v", "r_high", 5)} AS vh, {_corr("r_v", "r_typ", 5)} AS vt, {_corr("r_dl", "r_body", 6)} AS db FROM d {_windows(5, 6)}),
  f AS (SELECT code, date, -db AS gtja_001, -(pl - lag(pl) OVER w) AS gtja_002, {_full("ps", "sum({x}) OVER {w}", 6)} AS gtja_003, -{_full("vh", "max({x}) OVER {w}", 3)} AS gtja_005, CASE WHEN fin THEN -{_share("sg")} END AS gtja_006,
    CASE WHEN fin THEN {_share("bo")} END AS gtja_007, CASE WHEN fin THEN {_share("dm")} END AS gtja_008, CASE WHEN len(sps) > 0 THEN list_reduce(sps, lambda s, x: s * 5::DOUBLE / 7 + x * 2::DOUBLE / 7) END AS gtja_009, {_full("fl", "sum({x}) OVER {w}", 6)} AS gtja_011,
    CASE WHEN fin THEN {_share("fo")} * {_share("fc")} END AS gtja_012, sqrt(high * low) - typ AS gtja_013, close - c5 AS gtja_014, open / (bf + 1e-8::DOUBLE) - 1 AS gtja_015, -{_full("vt", "max({x}) OVER {w}", 5)} AS gtja_016,
    CASE WHEN fin THEN sign(coalesce(close - c5, 0)) * {_share("fall")} END AS gtja_017, close / (c5 + 1e-8::DOUBLE) - 1 AS gtja_018, CASE WHEN close > c5 THEN (close - c5) / close ELSE (close - c5) / (c5 + 1e-8::DOUBLE) END AS gtja_019,
    (close - c6) / (c6 + 1e-8::DOUBLE) * 100 AS gtja_020 FROM e {_windows(3, 5, 6)})
  SELECT code, date, {_out(sr.ALPHAS)} FROM f""")
def factor_alphas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(sr.alphas(price_panel(spark, sf_dir)), sr.ALPHAS)


def _agg(x: str, how: str, n: int) -> str:
    return _full(x, how + "({x}) OVER {w}", n)


def _flag(test: str) -> str:
    return f"coalesce(({test})::INT, 0)::DOUBLE"


@query(f"""WITH {PANEL}, a AS (SELECT *, lag(close) OVER w AS bf, close / nullif(lag(close) OVER w, 0) - 1 AS r, volume / nullif(lag(volume) OVER w, 0) - 1 AS dv, high - lag(high) OVER w AS ri, lag(low) OVER w - low AS fa, lag(high) OVER w AS hb, lag(low) OVER w AS lb,
    lag(volume) OVER w AS vb, lag(amount, 5) OVER w AS ab, {_mean("close", 5)} AS m5, {_mean("close", 20)} AS m20, {_mean("close", 60)} AS m60, {_agg("close", "stddev_samp", 20)} AS sd, row_number() OVER w AS k,
    close / nullif(lag(close, 20) OVER w, 0) - 1 AS p20, close / nullif(lag(close, 60) OVER w, 0) - 1 AS p60 FROM panel {_windows(5, 20, 60)}),
  b AS (SELECT *, greatest(high - low, abs(high - bf), abs(low - bf)) AS tr, CASE WHEN ri IS NOT NULL THEN greatest(ri, 0) END AS up, CASE WHEN ri > fa AND ri > 0 THEN ri ELSE 0 END AS pl, CASE WHEN fa > ri AND fa > 0 THEN fa ELSE 0 END AS mi, CASE WHEN r IS NOT NULL THEN least(r, 0) END AS ls,
    {_flag("r > 0")} AS ru, {_flag("r < 0")} AS rd, {_flag("m5 > m20 AND lag(m5) OVER w <= lag(m20) OVER w")} AS cr, max(CASE WHEN r > 0 THEN NULL ELSE k END) OVER (w ROWS UNBOUNDED PRECEDING) AS rest FROM a {_windows()}),
  c AS (SELECT *, ls * ls AS l2, CASE WHEN count(ls) OVER w60 >= 60 THEN sum(rd) OVER w60 END AS nl FROM b {_windows(60)}),
  d AS (SELECT *, sqrt(greatest({_agg("l2", "sum", 60)} / nullif(nl, 0) - pow({_agg("ls", "sum", 60)} / nullif(nl, 0), 2), 0)) AS sl, {_agg("hb", "max", 20)} AS t20, {_agg("lb", "min", 20)} AS b20, {_agg("high", "max", 14)} AS h14, {_agg("low", "min", 14)} AS l14,
    {_agg("high", "max", 20)} AS h20, {_agg("low", "min", 20)} AS l20, {_agg("close", "max", 20)} AS c20, {_agg("close", "min", 20)} AS d20, {_mean("r", 60)} AS r60, {_mean("tr", 14)} AS atr, {_mean("ls", 60)} * 100 AS lm FROM c {_windows(14, 20, 60)}),
  e AS (SELECT code, date, p20 - p60 AS tech_mom_accel, p20 / nullif(abs(p60), 0) AS tech_ret_20_60, {_flag("coalesce(m5 > m20, FALSE) OR coalesce(m20 > m60, FALSE) OR coalesce(close > m5, FALSE)")} AS tech_ma_bull, m20 / nullif(lag(m20, 5) OVER w, 0) - 1 AS tech_ma20_slope,
    coalesce({_agg("cr", "max", 3)}, 0) AS tech_ma_cross_5_20, {_mean("up", 14)} * 100 / nullif(atr, 0) AS tech_dmi_plus, r60 / nullif({_agg("r", "stddev_samp", 60)}, 0) * sqrt(252) AS tech_sharpe_60, r60 / CASE WHEN nl < 2 OR sl < 1e-9 THEN 1 ELSE sl END * sqrt(252) AS tech_sortino_60,
    {_agg("r", "stddev_samp", 5)} / nullif({_agg("r", "stddev_samp", 60)}, 0) AS tech_vol_contract, atr / nullif(close, 0) AS tech_atr_pct, CASE WHEN sd >= 1e-9 THEN (close - m20 + 2 * sd) / (4 * sd) ELSE 0.5 END AS tech_boll_pos, sd / nullif(m20, 0) * 4 AS tech_boll_width,
    (h14 - close) / nullif(h14 - l14, 0) * -100 AS tech_williams_r, ({_agg("high", "max", 10)} - {_agg("low", "min", 10)}) / nullif({_mean("high", 10)}, 0) AS tech_hl_range10, volume / nullif({_mean("vb", 5)}, 0) AS tech_vol_ratio, {_mean("amount", 5)} / nullif({_mean("ab", 6)}, 0) - 1 AS tech_amount_trend,
    (amount - {_mean("amount", 20)}) / nullif({_agg("amount", "stddev_samp", 20)}, 0) AS tech_amount_z, close / nullif(lag(close, 5) OVER w, 0) - 1 - (volume / nullif(lag(volume, 5) OVER w, 0) - 1) AS tech_price_vol_div, (close - open) / nullif(bf, 0) AS tech_candle_body,
    (high - greatest(close, open)) / nullif(high, 0) AS tech_upper_shadow, {_flag("high >= t20")} AS tech_high_20d, {_flag("low <= b20")} AS tech_low_20d, (close - d20) / nullif(c20 - d20, 0) AS tech_close_pos, close / nullif(t20, 0) - 1 AS tech_breakout_20,
    {_flag("open > bf * 1.005::DOUBLE AND low <= bf")} AS tech_gap_fill, (k - rest)::DOUBLE AS tech_consec_up, {_agg("ru", "sum", 20)} / nullif({_agg("rd", "sum", 20)}, 0) AS tech_up_down_ratio, m5 / nullif(m20, 0) - 1 AS ma_cross, (close / nullif({_mean("close", 12)}, 0) - 1) * 100 AS bias12,
    (close / nullif({_agg("high", "max", 60)}, 0) - 1) * 100 AS new_high_dist, (close / nullif({_agg("low", "min", 60)}, 0) - 1) * 100 AS new_low_dist, {_mean("volume", 5)} / nullif(({_agg("volume", "sum", 20)} - {_agg("volume", "sum", 5)}) / 15, 0) - 1 AS volume_trend, ln(1 + {_mean("volume", 20)}) AS vol_20d,
    {_corr("r", "dv", 20)} AS volume_price_fit, {_agg("r", "stddev_pop", 20)} * sqrt(252) * 100 AS realized_vol, CASE WHEN nl < 3 THEN 0 ELSE sl * sqrt(252) * 100 END AS downside_vol, CASE WHEN count(close) OVER w250 >= 2 THEN (close / nullif(max(close) OVER w250, 0) - 1) * 100 END AS max_dd_12m,
    {_agg("r", "stddev_pop", 20)} / nullif({_agg("r", "stddev_pop", 60)}, 0) - 1 AS vol_change, ln(1 + {_mean("amount", 20)}) AS amount_liquidity, -({_agg("volume", "stddev_pop", 20)} / nullif({_mean("volume", 20)}, 0)) AS turnover_stability,
    ({_agg("pl", "sum", 14)} - {_agg("mi", "sum", 14)}) * 100 / nullif({_agg("tr", "sum", 14)}, 0) AS dmi, CASE WHEN h20 > l20 THEN (close - l20) / (h20 - l20) ELSE 0.5 END AS donchian, m20 / nullif(m60, 0) - 1 AS ma_trend, r60 * 100 AS beta_60d, CASE WHEN lm = 0 THEN 1 ELSE lm END AS downside_beta
    FROM d {_windows(3, 5, 6, 10, 12, 14, 20, 60, 250)})
  SELECT code, date, {_out(sr.LEVEL_SERIES)} FROM e""")
def factor_level_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(sr.level_series(price_panel(spark, sf_dir)), sr.LEVEL_SERIES)


def _strength(n: int) -> str:
    up, down = _mean("gain", n), _mean("loss", n)
    return f"CASE WHEN {down} = 0 AND {up} > 0 THEN 100 WHEN {up} = 0 AND {down} > 0 THEN 0 WHEN {up} = 0 AND {down} = 0 THEN 50 ELSE 100 - 100 / (1 + {up} / nullif({down}, 0)) END"


def _moved(*names: tuple[str, int]) -> str:
    return ", ".join(f"close / nullif(lag(close, {k}) OVER w, 0) - 1 AS {n}" for n, k in names)


@query(f"""WITH RECURSIVE {PANEL}, a AS (SELECT *, volume / 10000.0 AS turnover, row_number() OVER w AS k, lag(close) OVER w AS bf, close / nullif(lag(close) OVER w, 0) - 1 AS r, close - lag(close) OVER w AS mv, (high + low + close) / 3 AS typ, lag(volume) OVER w AS vb, (high - low) / nullif(close, 0) AS spr,
    (close - {_agg("low", "min", 9)}) / nullif({_agg("high", "max", 9)} - {_agg("low", "min", 9)}, 0) * 100 AS rw FROM panel {_windows(9)}),
  b AS (SELECT *, greatest(high - low, coalesce(abs(high - bf), 0), coalesce(abs(low - bf), 0)) AS tr, CASE WHEN mv IS NOT NULL THEN greatest(mv, 0) END AS gain, CASE WHEN mv IS NOT NULL THEN greatest(-mv, 0) END AS loss, coalesce(sign(mv) * volume, 0) AS sg, abs(r) / nullif(amount, 0) AS cost,
    abs(typ - {_mean("typ", 20)}) AS dev, sum(coalesce(sign(mv) * volume, 0)) OVER (w ROWS UNBOUNDED PRECEDING) AS obv, {_full("typ", "list({x}) OVER {w}", 20)} AS typs, list(close) OVER w60 AS cl FROM a {_windows(20, 60)}),
  s AS (SELECT code, k, close AS e12, close AS e26, 0.0::DOUBLE AS dea, coalesce(rw, 0)::DOUBLE AS kn, (rw IS NOT NULL)::INT::DOUBLE AS kd, coalesce(rw, 0)::DOUBLE AS dn, (rw IS NOT NULL)::INT::DOUBLE AS dd FROM b WHERE k = 1
    UNION ALL SELECT code, k, e12, e26, 0.8 * dea + 0.2 * (e12 - e26), kn, kd, 2.0 / 3 * dn + CASE WHEN kd > 0 THEN kn / kd ELSE 0 END, 2.0 / 3 * dd + CASE WHEN kd > 0 THEN 1 ELSE 0 END
    FROM (SELECT b.code, b.k, 2.0 / 13 * b.close + 11.0 / 13 * s.e12 AS e12, 2.0 / 27 * b.close + 25.0 / 27 * s.e26 AS e26, s.dea, 2.0 / 3 * s.kn + coalesce(b.rw, 0) AS kn, 2.0 / 3 * s.kd + (b.rw IS NOT NULL)::INT AS kd, s.dn, s.dd FROM s JOIN b ON b.code = s.code AND b.k = s.k + 1)),
  j AS (SELECT b.*, e12 - e26 - dea AS hist, CASE WHEN kd > 0 THEN 3 * kn / kd - 2 * dn / dd END AS kdj FROM b JOIN s USING (code, k)),
  g AS (SELECT *, {_flag("hist > 0 AND lag(hist) OVER w <= 0")} AS gold, CASE WHEN count(close) OVER w60 >= 60 THEN list_min(list_transform(cl, lambda x, i: x / list_max(cl[1:i]) - 1)) END AS fall,
    {_full("obv", "regr_slope({x}, k::DOUBLE) OVER {w}", 25)} AS s25, {_full("obv", "regr_slope({x}, k::DOUBLE) OVER {w}", 20)} AS s20, list_avg(list_transform(typs, lambda x: abs(x - list_avg(typs)))) AS od FROM j {_windows(20, 25, 60)}),
  e AS (SELECT code, date, {_moved(("tech_mom_3_10", 3), ("tech_mom_10", 10), ("tech_mom_20", 20), ("tech_mom_60", 60), ("tech_mom_120", 120), ("tech_ret_week", 5), ("tech_ret_250", 250), ("tech_cum_ret_10", 10))}, close / first_value(close) OVER w300 - 1 AS tech_ret_ytd,
    close / {_mean("close", 5)} - 1 AS tech_ma5_dev, close / {_mean("close", 20)} - 1 AS tech_ma20_dev, close / {_mean("close", 60)} - 1 AS tech_ma60_dev, close / {_mean("close", 250)} - 1 AS tech_close_ma250, {_strength(6)} AS tech_rsi6, {_strength(14)} AS tech_rsi14, {_strength(20)} - {_strength(50)} AS tech_rsi_diff,
    kdj AS tech_kdj_j, hist AS tech_macd_hist, coalesce({_agg("gold", "max", 3)}, 0) AS tech_macd_gold, {_agg("r", "stddev_samp", 20)} AS tech_vol20, {_full("r", "skewness({x}) OVER {w}", 60)} AS tech_vol_skew, fall AS tech_drawdown_60, (close / nullif(lag(close, 59) OVER w, 0) - 1) / nullif(abs(fall), 0) AS tech_calmar_60,
    CASE WHEN od >= 1e-9 THEN (typ - {_mean("typ", 20)}) / (od * 0.015) ELSE 0 END AS tech_cci20, volume / nullif({_mean("volume", 20)}, 0) AS tech_vol_ma20, {_agg("volume", "stddev_samp", 20)} / nullif({_mean("volume", 20)}, 0) AS tech_vol_std20, (turnover - {_mean("turnover", 20)}) / nullif({_agg("turnover", "stddev_samp", 20)}, 0) AS tech_turnover_z,
    s25 AS tech_obv_slope, ({_mean("obv", 20)} - lag(obv, 64) OVER w) / nullif(abs({_mean("obv", 60)} - lag(obv, 64) OVER w), 0) AS tech_obv_trend, open / nullif(bf, 0) - 1 AS tech_gap_up, (close - {_agg("close", "min", 250)}) / nullif({_agg("close", "max", 250)} - {_agg("close", "min", 250)}, 0) AS tech_high_52w_pos,
    {_moved(("mom20", 20), ("mom1m", 21), ("mom3m", 63), ("mom6m", 126), ("mom12m", 252))}, -(close / nullif(lag(close, 5) OVER w, 0) - 1) AS rev5, (hist - lag(hist) OVER w) / nullif(close, 0) * 100 AS macd_cross, hist * 2 AS macd_hist,
    {_flag(f"close <= {_agg('close', 'min', 30)} * 1.02::DOUBLE AND hist > {_agg('hist', 'min', 30)} * 1.1::DOUBLE")} - {_flag(f"close >= {_agg('close', 'max', 30)} * 0.98::DOUBLE AND hist < {_agg('hist', 'max', 30)} * 0.9::DOUBLE")} AS macd_div, (typ - {_mean("typ", 20)}) / nullif({_mean("dev", 20)} * 0.015, 0) AS cci_20,
    CASE WHEN {_agg("close", "max", 252)} > {_agg("close", "min", 252)} THEN (close - {_agg("close", "min", 252)}) / ({_agg("close", "max", 252)} - {_agg("close", "min", 252)}) ELSE 0.5 END AS high_low_pos, volume / nullif({_mean("vb", 20)}, 0) AS volume_surge, volume / nullif({_mean("vb", 5)}, 0) AS volume_ratio,
    s20 / (abs({_mean("obv", 20)} - lag(obv, 299) OVER w) + 1e-9) AS obv_slope, {_mean("tr", 14)} / close AS atr_ratio, {_mean("cost", 20)} * 1e6 AS amihud_illiq, {_mean("spr", 20)} AS spread_approx, kdj, ({_agg("high", "max", 14)} - close) / nullif({_agg("high", "max", 14)} - {_agg("low", "min", 14)}, 0) * 100 AS williams,
    {_agg("close", "stddev_pop", 20)} / {_mean("close", 20)} * 4 AS boll_width, CASE WHEN 4 * {_agg("close", "stddev_pop", 20)} >= 1e-9 THEN (close - {_mean("close", 20)} + 2 * {_agg("close", "stddev_pop", 20)}) / (4 * {_agg("close", "stddev_pop", 20)}) ELSE 0.5 END AS boll_pos,
    coalesce(CASE WHEN {_mean("loss", 14)} = 0 AND {_mean("gain", 14)} > 0 THEN 100 ELSE 100 - 100 / (1 + {_mean("gain", 14)} / nullif({_mean("loss", 14)}, 0)) END, 50) AS rsi14
    FROM g {_windows(3, 5, 6, 14, 20, 30, 50, 60, 250, 252, 300)})
  SELECT code, date, {_out((*cs.TECHNICAL, *cs.CLASSIC))} FROM e""")
def factor_chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = price_panel(spark, sf_dir).withColumn("turnover", F.col("volume") / 10_000.0)
    return _shown(cs.chart_series(panel), (*cs.TECHNICAL, *cs.CLASSIC))
