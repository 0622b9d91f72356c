"""Time-series operators on the weekly price panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expr import ordered, running
from tessera.operators import timeseries as ts
from tessera.operators.rolled import rolled, sorted_by
from tessera.plans.panel import PANEL, price_panel, table
from tessera.plans.registry import places, query, rounded

_W = "PARTITION BY code ORDER BY date"


def _roll(n: int) -> str:
    return f"({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(f"""WITH {PANEL} SELECT code, date, round(close / nullif(lag(close, 1) OVER w, 0) - 1, 6) AS mom_1,
  round(close / nullif(lag(close, 5) OVER w, 0) - 1, 6) AS mom_5, round(close / nullif(lag(close, 20) OVER w, 0) - 1, 6) AS mom_20,
  round(-(close / nullif(lag(close, 1) OVER w, 0) - 1), 6) AS reversal FROM panel WINDOW w AS ({_W})""")
def ts_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.momentum(price_panel(spark, sf_dir), (1, 5, 20)).select("code", "date", "mom_1", "mom_5", "mom_20", "reversal"))


@query(f"""WITH {PANEL} SELECT code, date, round(lag(close, 4) OVER w / nullif(lag(close, 48) OVER w, 0) - 1, 6) AS mom_48_4,
  round(lag(close, 4) OVER w / nullif(lag(close, 24) OVER w, 0) - 1, 6) AS mom_24_4 FROM panel WINDOW w AS ({_W})""")
def ts_skip_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.skip_momentum(price_panel(spark, sf_dir), 4, (48, 24)).select("code", "date", "mom_48_4", "mom_24_4"))


@query(f"""WITH {PANEL} SELECT code, date, CASE WHEN n >= 10 THEN round(a, 6) END AS mean_10, CASE WHEN n >= 10 THEN round(s, 6) END AS std_10,
  CASE WHEN n >= 10 THEN lo END AS min_10, CASE WHEN n >= 10 THEN hi END AS max_10, CASE WHEN n >= 10 THEN round(med, 8) END AS median_10, n AS count_10
  FROM (SELECT code, date, count(close) OVER w AS n, avg(close) OVER w AS a, stddev_samp(close) OVER w AS s, min(close) OVER w AS lo, max(close) OVER w AS hi,
        quantile_cont(close, 0.5) OVER w AS med FROM panel WINDOW w AS {_roll(10)})""")
def ts_rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ts.rolling_stats(price_panel(spark, sf_dir), 10, ("mean", "std", "min", "max", "median"))
    rows = ts.rolling_stats(rows, 10, ("count",), min_periods=1)
    exact = {"mean_10": 6, "std_10": 6, "median_10": 8}
    return rows.select("code", "date", "min_10", "max_10", "count_10", *(F.round(c, n).alias(c) for c, n in exact.items()))


@query(f"""WITH {PANEL}, r AS (SELECT code, date, close, count(close) OVER w AS n, skewness(close) OVER w AS g1, kurtosis(close) OVER w AS g2,
  max(close) OVER w - min(close) OVER w AS spread FROM panel WINDOW w AS {_roll(20)})
  SELECT code, date, CASE WHEN n >= 20 THEN round(g1, 4) END AS skew_20, CASE WHEN n >= 20 THEN round(g2, 4) END AS kurt_20 FROM r""")
def ts_rolling_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rolled(sorted_by(price_panel(spark, sf_dir).select("code", "date", "close"), "code", "date"), {"skew_20": ("skew", "close", 20), "kurt_20": ("kurt", "close", 20)})
    return rounded(rows.select("code", "date", "skew_20", "kurt_20"), 4)


@query(f"""WITH {PANEL}, r AS (SELECT code, date, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS ret FROM panel),
  s AS (SELECT code, date, ret, count(ret) OVER w AS n, sum(ln(1 + ret)) OVER w AS l, min(1 + ret) OVER w AS m FROM r WINDOW w AS {_roll(10)})
  SELECT code, date, CASE WHEN n >= 10 AND m > 0 THEN round(exp(l) - 1, 6) END AS product_10 FROM s""")
def ts_rolling_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ts.momentum(price_panel(spark, sf_dir), (1,))
    return rounded(ts.rolling_stats(rows, 10, ("product",), value="mom_1").select("code", "date", "product_10"))


@query(f"""WITH {PANEL}, r AS (SELECT code, date, close / nullif(lag(close) OVER ({_W}), 0) - 1 AS ret FROM panel),
  m AS (SELECT date, avg(ret) AS market FROM r GROUP BY date),
  j AS (SELECT r.code, r.date, ret, market, CASE WHEN ret IS NOT NULL AND market IS NOT NULL THEN 1 END AS k FROM r JOIN m USING (date)),
  s AS (SELECT code, date, count(k) OVER w AS n, covar_samp(ret, market) OVER w AS cv, var_samp(CASE WHEN k = 1 THEN market END) OVER w AS v, corr(ret, market) OVER w AS cr
        FROM j WINDOW w AS {_roll(20)})
  SELECT code, date, CASE WHEN n >= 10 THEN round(cv / nullif(v, 0), 6) END AS beta_20, CASE WHEN n >= 10 THEN round(cr, 6) END AS corr_20, CASE WHEN n >= 10 THEN round(cv, 6) END AS cov_20 FROM s""")
def ts_market_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.market_features(price_panel(spark, sf_dir)).select("code", "date", "beta_20", "corr_20", "cov_20"))


@query(f"""WITH {PANEL}, r AS (SELECT code, date, close, row_number() OVER ({_W})::DOUBLE AS k FROM panel),
  s AS (SELECT code, date, CASE WHEN count(close) OVER w >= 10 THEN regr_slope(close, k) OVER w END AS slope FROM r WINDOW w AS {_roll(10)})
  SELECT code, date, round(slope, 6) AS slope, round(degrees(atan(slope)), 6) AS angle FROM s""")
def ts_trend_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.with_trend(price_panel(spark, sf_dir)).select("code", "date", "slope", "angle"))


@query(f"""WITH {PANEL}, r AS (SELECT code, date, close, list(close) OVER w AS x FROM panel WINDOW w AS {_roll(10)})
  SELECT code, date, CASE WHEN len(x) >= 10 THEN round((len(list_filter(x, lambda v: v < close)) + (len(list_filter(x, lambda v: v = close)) + 1) / 2.0) / len(x), 6) END AS ts_rank,
  CASE WHEN len(x) >= 10 THEN round(len(list_filter(x, lambda v: v < close))::DOUBLE / len(x), 6) END AS below FROM r""")
def ts_window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ordered("code", "date")
    rows = price_panel(spark, sf_dir).select("code", "date", ts.ts_rank("close", 10, w).alias("ts_rank"), ts.share_below("close", 10, w).alias("below"))
    return rounded(rows)


@query(f"""WITH {PANEL} SELECT code, date, round((lag(close, 4) OVER w + 2 * lag(close, 3) OVER w + 3 * lag(close, 2) OVER w + 4 * lag(close, 1) OVER w + 5 * close) / 15.0, 6) AS wma
  FROM panel WINDOW w AS ({_W})""")
def ts_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ordered("code", "date")
    return rounded(price_panel(spark, sf_dir).select("code", "date", ts.weighted_mean("close", 5, w).alias("wma")))


@query(f"""WITH {PANEL}, t AS (SELECT code, date, (high + low + close) / 3 AS tp FROM panel),
  r AS (SELECT code, date, tp, avg(tp) OVER w AS m, list(tp) OVER w AS x FROM t WINDOW w AS {_roll(20)})
  SELECT code, date, CASE WHEN len(x) >= 20 THEN round((tp - m) / nullif(list_sum(list_transform(x, lambda v: abs(v - m))) / len(x) * 0.015, 0), 4) END AS cci FROM r""")
def ts_cci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.cci(price_panel(spark, sf_dir)).select("code", "date", "cci"), 4)


@query(f"""WITH {PANEL}, r AS (SELECT code, date, row_number() OVER ({_W}) AS k, close FROM panel),
  p AS (SELECT a.code, a.date, a.k, b.close, max(b.close) OVER (PARTITION BY a.code, a.k ORDER BY b.k ROWS UNBOUNDED PRECEDING) AS peak
        FROM r a JOIN r b ON a.code = b.code AND b.k BETWEEN a.k - 11 AND a.k)
  SELECT code, date, CASE WHEN count(*) >= 12 THEN round(min(close / peak - 1), 6) END AS worst FROM p GROUP BY code, date""")
def ts_window_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ordered("code", "date")
    return rounded(price_panel(spark, sf_dir).select("code", "date", ts.window_drawdown("close", 12, w).alias("worst")))


@query(f"""WITH {PANEL} SELECT code, date, round(close / max(close) OVER ({_W} ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM panel""")
def ts_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.drawdown(price_panel(spark, sf_dir), "close").select("code", "date", "drawdown"))


@query(f"""WITH {PANEL}, r AS (SELECT code, date, close, count(close) OVER w AS n, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s FROM panel
  WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING))
  SELECT code, date, CASE WHEN n >= 20 THEN CASE WHEN s > 0 THEN round((close - m) / s, 6) ELSE 0.0 END END AS z FROM r""")
def ts_expanding_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(price_panel(spark, sf_dir).select("code", "date", ts.expanding_z("close", ordered("code", "date")).alias("z")))


@query(f"""WITH RECURSIVE {PANEL}, r AS (SELECT code, date, high, low, close, row_number() OVER ({_W}) AS k FROM panel),
  e AS (SELECT code, date, k, close AS a, close AS b FROM r WHERE k = 1
        UNION ALL SELECT r.code, r.date, r.k, r.close * (2.0 / 13) + e.a * (11.0 / 13), r.close * (2.0 / 27) + e.b * (25.0 / 27) FROM e JOIN r ON r.code = e.code AND r.k = e.k + 1)
  SELECT code, date, round(a, 5) AS ema_12, round(b, 5) AS ema_26, round(a - b, 5) AS macd FROM e""")
def ts_ema_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("ema_12", "ema_26", "macd")
    rows = ts.recursive_indicators(price_panel(spark, sf_dir).select("code", "date", "close"), names=names)
    return rows.select("code", "date", *(places(n, 5).alias(n) for n in names))


@query()
def ts_recursive_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("macd_signal", "macd_hist", "rsi_wilder", "atr_wilder", "kdj_k", "kdj_d", "kdj_j", "adx")
    rows = price_panel(spark, sf_dir).select("code", "date", "high", "low", "close")
    return rounded(ts.recursive_indicators(rows, names=names).select("code", "date", *names), 5)


@query(f"""WITH {PANEL}, r AS (SELECT code, date, close, CASE WHEN count(close) OVER w >= 20 THEN avg(close) OVER w END AS m, CASE WHEN count(close) OVER w >= 20 THEN stddev_samp(close) OVER w END AS s
  FROM panel WINDOW w AS {_roll(20)})
  SELECT code, date, round(m, 5) AS mid, round(m + s * 2.0, 5) AS upper, round(m - s * 2.0, 5) AS lower, round(((m + s * 2.0) - (m - s * 2.0)) / nullif(m, 0), 5) AS width,
  round((close - (m - s * 2.0)) / nullif((m + s * 2.0) - (m - s * 2.0), 0), 5) AS place FROM r""")
def ts_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.bands(price_panel(spark, sf_dir)).select("code", "date", "mid", "upper", "lower", "width", "place"), 5)


@query(f"""WITH {PANEL}, r AS (SELECT *, lag(close) OVER w AS p FROM panel WINDOW w AS ({_W})),
  s AS (SELECT *, coalesce(sign(close - p), 0.0) * volume AS sv, coalesce(close / nullif(p, 0) - 1, 0.0) * volume AS f FROM r)
  SELECT code, date, sum(sv) OVER u AS obv, round(sum(f) OVER u, 5) AS pvt, round(volume / nullif(avg(volume) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0), 7) AS volume_ratio,
  round(sum(close * volume) OVER v / nullif(sum(volume) OVER v, 0), 5) AS vwap
  FROM s WINDOW w AS ({_W}), u AS ({_W} ROWS UNBOUNDED PRECEDING), v AS {_roll(20)}""")
def ts_volume_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ts.volume_lines(price_panel(spark, sf_dir)).select("code", "date", "obv", "pvt", "volume_ratio", "vwap")
    return rows.withColumns({c: F.round(c, n) for c, n in (("pvt", 5), ("volume_ratio", 7), ("vwap", 5))})


@query(f"""WITH {PANEL}, r AS (SELECT code, date, close, max(high) OVER w AS prior_high, min(low) OVER w AS prior_low FROM panel WINDOW w AS ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
  SELECT code, date, prior_high, prior_low, coalesce(close > prior_high, false) AS breaks_up, coalesce(close < prior_low, false) AS breaks_down FROM r""")
def ts_breakout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.breakout(price_panel(spark, sf_dir), 20).select("code", "date", "prior_high", "prior_low", "breaks_up", "breaks_down")


@query(f"""WITH {PANEL}, r AS (SELECT *, abs(close - open) AS body, high - low AS span, high - greatest(open, close) AS top, least(open, close) - low AS bottom,
  lag(open) OVER w AS po, lag(close) OVER w AS pc, lag(open, 2) OVER w AS po2, lag(close, 2) OVER w AS pc2 FROM panel WINDOW w AS ({_W}))
  SELECT code, date, concat_ws(',', CASE WHEN span > 0 AND body <= span * 0.1 THEN 'doji' END, CASE WHEN body > 0 AND bottom >= body * 2 AND top <= body * 0.5 THEN 'hammer' END,
  CASE WHEN body > 0 AND top >= body * 2 AND bottom <= body * 0.5 THEN 'shooting_star' END, CASE WHEN pc < po AND close > open AND open <= pc AND close >= po THEN 'bullish_engulfing' END,
  CASE WHEN pc > po AND close < open AND open >= pc AND close <= po THEN 'bearish_engulfing' END,
  CASE WHEN po IS NOT NULL AND greatest(open, close) < greatest(po, pc) AND least(open, close) > least(po, pc) THEN 'inside' END,
  CASE WHEN close > open AND pc > po AND pc2 > po2 AND close > pc AND pc > pc2 THEN 'three_up' END,
  CASE WHEN close < open AND pc < po AND pc2 < po2 AND close < pc AND pc < pc2 THEN 'three_down' END) AS patterns FROM r""")
def ts_candle_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.candle_patterns(price_panel(spark, sf_dir)).select("code", "date", F.array_join("patterns", ",").alias("patterns"))


@query(f"""WITH {PANEL}, r AS (SELECT code, date, coalesce(close > lag(close) OVER ({_W}), false) AS up FROM panel),
  s AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS g FROM r)
  SELECT code, date, (sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY code, g ORDER BY date ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM s""")
def ts_up_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = price_panel(spark, sf_dir)
    rising = F.col("close") > F.lag("close").over(ordered("code", "date"))
    return ts.runs(panel.withColumn("up", rising), F.col("up")).select("code", "date", "run")


@query(f"""WITH {PANEL}, c AS (SELECT DISTINCT date FROM panel), s AS (SELECT code, min(date) AS a, max(date) AS b FROM panel GROUP BY code),
  j AS (SELECT s.code, c.date, p.close, p.volume, p.code IS NULL AS synthetic FROM s JOIN c ON c.date BETWEEN s.a AND s.b LEFT JOIN panel p ON p.code = s.code AND p.date = c.date),
  f AS (SELECT code, date, last_value(close IGNORE NULLS) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS close, coalesce(volume, 0.0) AS volume, synthetic FROM j)
  SELECT * FROM f WHERE close IS NOT NULL""")
def ts_fill_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = price_panel(spark, sf_dir)
    return ts.fill_calendar(panel.select("code", "date", "close", "volume"), panel.select("date").distinct(), ["close"], ["volume"], 2)


@query(f"""WITH {PANEL} SELECT code, CAST(date_trunc('month', date) AS DATE) AS period, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close,
  sum(volume) AS volume, round(sum(amount), 2) AS amount, count(*) AS bars FROM panel GROUP BY 1, 2""")
def ts_resample_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ts.resample(price_panel(spark, sf_dir), F.to_date(F.date_trunc("month", "date")))
    return rows.withColumn("amount", F.round("amount", 2))


@query("""SELECT user_id, CAST(ts AS DATE) + CAST((5 - isodow(ts) + 7) % 7 AS INT) AS week_end, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2""")
def ts_resample_friday_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    return table(spark, sf_dir, "events").groupBy("user_id", F.next_day(F.date_sub(day, 1), "FRI").alias("week_end")).agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query(f"""WITH {PANEL} SELECT code, date, round(lead(close, 4) OVER w / nullif(close, 0) - 1, 6) AS forward, lead(date, 4) OVER w AS known_on FROM panel WINDOW w AS ({_W})""")
def ts_forward_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.forward_return(price_panel(spark, sf_dir), 4).select("code", "date", "forward", "known_on"))


@query(f"""WITH {PANEL}, c AS (SELECT date, lead(date, 1) OVER (ORDER BY date) AS i, lead(date, 2) OVER (ORDER BY date) AS o FROM (SELECT DISTINCT date FROM panel))
  SELECT p.code, p.date, a.open AS entry, b.open AS exit, round(b.open / nullif(a.open, 0) - 1, 6) AS label
  FROM panel p JOIN c USING (date) LEFT JOIN panel a ON a.code = p.code AND a.date = c.i LEFT JOIN panel b ON b.code = p.code AND b.date = c.o""")
def ts_next_open_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.next_open_label(price_panel(spark, sf_dir)).select("code", "date", "entry", "exit", F.round("label", 6).alias("label"))


@query(f"""WITH {PANEL}, r AS (SELECT code, date, close - lag(close) OVER ({_W}) AS d FROM panel),
  s AS (SELECT code, date, count(d) OVER w AS n, avg(CASE WHEN d IS NOT NULL THEN greatest(d, 0.0) END) OVER w AS g, avg(CASE WHEN d IS NOT NULL THEN greatest(-d, 0.0) END) OVER w AS l FROM r WINDOW w AS {_roll(14)})
  SELECT code, date, CASE WHEN n < 14 OR (g = 0 AND l = 0) THEN NULL WHEN l = 0 THEN 100.0 ELSE round(100 - 100 / (1 + g / l), 4) END AS rsi FROM s""")
def ts_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.with_rsi(price_panel(spark, sf_dir)).select("code", "date", "rsi"), 4)


@query(f"""WITH {PANEL}, r AS (SELECT *, ln(high / low) AS hl, ln(close / open) AS co, ln(open / lag(close) OVER ({_W})) AS gap,
  ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs FROM panel),
  s AS (SELECT code, date, count(close) OVER w AS n, count(gap) OVER w AS ng, avg(hl * hl) OVER w AS p, avg(0.5 * hl * hl - (2 * ln(2.0::DOUBLE) - 1) * co * co) OVER w AS g,
  var_samp(gap) OVER w + var_samp(co) OVER w * (0.34::DOUBLE / (1.34::DOUBLE + 21.0::DOUBLE / 19.0::DOUBLE)) + avg(rs) OVER w * (1 - 0.34::DOUBLE / (1.34::DOUBLE + 21.0::DOUBLE / 19.0::DOUBLE)) AS y FROM r WINDOW w AS {_roll(20)})
  SELECT code, date, CASE WHEN n >= 20 THEN round(sqrt(p / (4 * ln(2.0::DOUBLE))), 6) END AS parkinson, CASE WHEN n >= 20 AND g >= 0 THEN round(sqrt(greatest(g, 0.0)), 6) END AS garman_klass,
  CASE WHEN ng >= 20 AND y >= 0 THEN round(sqrt(greatest(y, 0.0)), 6) END AS yang_zhang FROM s""")
def ts_range_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.range_volatility(price_panel(spark, sf_dir)).select("code", "date", "parkinson", "garman_klass", "yang_zhang"))


@query(f"""WITH {PANEL}, m AS (SELECT max(date) AS date FROM panel GROUP BY date_trunc('month', date)) SELECT date FROM m""")
def ts_period_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_panel(spark, sf_dir).groupBy(F.date_trunc("month", "date").alias("m")).agg(F.max("date").alias("date")).select("date")


@query("""SELECT user_id, event_id, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) OVER w > 100 AS over_100, max(value) OVER w AS top, count(*) OVER w AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def ts_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = running(ordered("user_id", ["ts", "event_id"]))
    spent = F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)).over(w)
    return table(spark, sf_dir, "events").select("user_id", "event_id", (spent > 100).alias("over_100"), F.max("value").over(w).alias("top"), F.count("*").over(w).alias("n"))


@query(f"""WITH {PANEL}, g AS (SELECT code, date, CASE WHEN volume % 2 = 0 THEN close END AS x FROM panel)
  SELECT code, date, first_value(x IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM g""")
def ts_back_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = price_panel(spark, sf_dir).select("code", "date", F.when(F.col("volume") % 2 == 0, F.col("close")).alias("x"))
    return ts.back_fill(rows, "x")


@query(f"""WITH {PANEL}, a AS (SELECT code, date, close, (open + high + low + close) / 4 AS twap, coalesce(last_value(CASE WHEN volume <> 0 THEN amount / volume END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING), close) AS vwap,
    CASE WHEN count(close) OVER b >= 20 THEN min(close) OVER b END AS lo, CASE WHEN count(close) OVER b >= 20 THEN max(close) OVER b END AS hi FROM panel WINDOW b AS ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
  SELECT code, date, round(twap, 6) AS twap, vwap, round((close / nullif(twap, 0) - 1) * 100, 3) AS twap_deviation, round((close / nullif(vwap, 0) - 1) * 100, 3) AS vwap_deviation,
    CASE WHEN hi > lo THEN round(least(greatest((1 - (close - lo) / (hi - lo)) * 100, 0.0), 100.0), 3) END AS reversal_strength, CASE WHEN hi IS NOT NULL THEN round(least(greatest(lo / nullif(hi, 0), 0.0), 1.0), 6) END AS reversal_ratio FROM a""")
def ts_price_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ts.price_lines(price_panel(spark, sf_dir), 20)
    rows = rows.withColumns({c: F.round(c, 3) for c in ("twap_deviation", "vwap_deviation", "reversal_strength")})
    return rows.select("code", "date", F.round("twap", 6).alias("twap"), "vwap", "twap_deviation", "vwap_deviation", "reversal_strength", F.round("reversal_ratio", 6).alias("reversal_ratio"))
