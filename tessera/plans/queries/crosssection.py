"""Cross-sectional operators on the weekly price panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import crosssection as xs
from tessera.plans.panel import PANEL, price_panel
from tessera.plans.registry import query, rounded

_PCT = "((rank() OVER (PARTITION BY date ORDER BY {0} NULLS LAST) + (count(*) OVER (PARTITION BY date, {0}) - 1) / 2.0) / count({0}) OVER (PARTITION BY date))::DOUBLE"


@query(f"""WITH {PANEL}, r AS (SELECT code, date, volume, {_PCT.format('volume')} AS pct, row_number() OVER (PARTITION BY date ORDER BY volume DESC, code) AS place FROM panel)
  SELECT code, date, round(pct, 6) AS pct, place, floor(least(pct, 0.999999) * 10)::BIGINT AS decile FROM r""")
def xs_rank_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(xs.ranked(price_panel(spark, sf_dir), "volume").select("code", "date", "pct", "place", "decile"))


@query(f"""WITH {PANEL}, e AS (SELECT date, list_distinct(quantile_cont(close, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS x FROM panel GROUP BY date)
  SELECT code, date, greatest(len(list_filter(x, lambda v: v < close)) - 1, 0)::BIGINT AS "group" FROM panel JOIN e USING (date)""")
def xs_quantile_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xs.quantile_groups(price_panel(spark, sf_dir), "close", 5).select("code", "date", "group")


@query(f"""WITH {PANEL} SELECT code, date, ntile(5) OVER (PARTITION BY date ORDER BY close, code) AS "group" FROM panel""")
def xs_even_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xs.even_groups(price_panel(spark, sf_dir), "close", 5).select("code", "date", "group")


@query(f"""WITH {PANEL}, m AS (SELECT *, median(close) OVER (PARTITION BY date) AS mid FROM panel), d AS (SELECT *, median(abs(close - mid)) OVER (PARTITION BY date) AS mad FROM m)
  SELECT code, date, round(CASE WHEN mad > 0 THEN least(greatest(close, mid - mad * 1.4826::DOUBLE * 3.0), mid + mad * 1.4826::DOUBLE * 3.0) ELSE close END, 7) AS winsorized FROM d""")
def xs_mad_winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(xs.mad_winsorize(price_panel(spark, sf_dir), "close").select("code", "date", "winsorized"), 7)


@query(f"""WITH {PANEL}, e AS (SELECT date, quantile_cont(close, 0.05) AS lo, quantile_cont(close, 0.95) AS hi FROM panel GROUP BY date)
  SELECT code, date, round(least(greatest(close, lo), hi), 8) AS winsorized FROM panel JOIN e USING (date)""")
def xs_quantile_winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(xs.quantile_winsorize(price_panel(spark, sf_dir), "close", 0.05, 0.95).select("code", "date", "winsorized"), 8)


@query(f"""WITH {PANEL}, s AS (SELECT code, date, volume AS x, avg(volume) OVER d AS m, stddev_pop(volume) OVER d AS s, count(volume) OVER d AS n FROM panel WINDOW d AS (PARTITION BY date))
  SELECT code, date, round(least(greatest(CASE WHEN s > 0 THEN (x - m) / s ELSE 0.0 END, -3.0), 3.0), 6) AS z, round(CASE WHEN n >= 3 AND s > 0 THEN (x - m) / s END, 6) AS z_strict FROM s""")
def xs_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(xs.standardized(price_panel(spark, sf_dir), "volume").select("code", "date", "z", "z_strict"))


@query(f"""WITH {PANEL} SELECT code, date, round(CASE WHEN count(volume) OVER g >= 3 THEN volume - avg(volume) OVER g END, 6) AS neutral FROM panel WINDOW g AS (PARTITION BY date, industry)""")
def xs_group_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(xs.demeaned(price_panel(spark, sf_dir), "volume", "industry").select("code", "date", "neutral"))


@query(f"""WITH {PANEL}, k AS (SELECT code, date, industry, close, ln(amount) AS x FROM panel WHERE close IS NOT NULL AND amount > 0 AND industry IS NOT NULL),
  g AS (SELECT code, date, count(*) OVER g AS n, close - avg(close) OVER g AS y, x - avg(x) OVER g AS x FROM k WINDOW g AS (PARTITION BY date, industry)),
  s AS (SELECT *, sum(x * y) OVER d / nullif(sum(x * x) OVER d, 0) AS b, count(*) OVER d AS nd FROM g WHERE n > 1 WINDOW d AS (PARTITION BY date))
  SELECT code, date, round(CASE WHEN nd >= 5 THEN y - coalesce(b, 0) * x END, 4) AS residual FROM s""")
def xs_group_size_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(xs.residual(price_panel(spark, sf_dir), "close", "amount", "industry").select("code", "date", "residual"), 4)


@query(f"""WITH {PANEL}, g AS (SELECT code, date, close - avg(close) OVER (PARTITION BY date, industry) AS y, ln(1 + amount) AS x FROM panel),
  s AS (SELECT *, regr_intercept(y, x) OVER d AS a, regr_slope(y, x) OVER d AS b, count(y) OVER d AS n FROM g WINDOW d AS (PARTITION BY date))
  SELECT code, date, round(CASE WHEN n > 20 THEN y - (a + b * x) ELSE y END, 4) AS neutral FROM s""")
def xs_sequential_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(xs.sequential_neutral(price_panel(spark, sf_dir), "close", "amount", "industry").select("code", "date", "neutral"), 4)


@query()
def xs_orthogonalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = price_panel(spark, sf_dir).select("code", "date", "close", "volume", "amount")
    return rounded(xs.orthogonalized(rows, ["close", "volume", "amount"]).select("code", "date", "close_orth", "volume_orth", "amount_orth"), 4)


@query(f"""WITH {PANEL} SELECT code, date, CASE WHEN NOT (high = low) THEN close END AS close, CASE WHEN NOT (high = low) THEN volume END AS volume FROM panel""")
def xs_state_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xs.masked(price_panel(spark, sf_dir), ["close", "volume"], F.col("high") == F.col("low")).select("code", "date", "close", "volume")


@query(f"""WITH {PANEL}, r AS (SELECT code, date, volume <= 20 AS idle, row_number() OVER w AS k, sum(CASE WHEN volume <= 20 THEN 0 ELSE 1 END) OVER (w ROWS UNBOUNDED PRECEDING) AS g FROM panel WINDOW w AS (PARTITION BY code ORDER BY date)),
  s AS (SELECT *, CASE WHEN idle AND sum(idle::INT) OVER (PARTITION BY code, g) >= 2 THEN k END AS e FROM r),
  t AS (SELECT *, max(e) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM s)
  SELECT code, date, coalesce(NOT idle AND k - ended <= 3, false) AS resting FROM t""")
def xs_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xs.cooled(price_panel(spark, sf_dir), F.col("volume") <= 20, 2, 3).select("code", "date", "resting")


@query(f"""WITH {PANEL}, a AS (SELECT *, row_number() OVER (PARTITION BY date, industry ORDER BY volume DESC, code) AS i FROM panel WHERE volume IS NOT NULL),
  b AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY volume DESC, code) AS place FROM a WHERE i <= 2) SELECT code, date, place FROM b WHERE place <= 10""")
def xs_top_n_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xs.top_n(price_panel(spark, sf_dir), "volume", 10, "industry", 2).select("code", "date", "place")


@query(f"""WITH {PANEL}, s AS (SELECT code, date, volume, -close AS c FROM panel), r AS (SELECT code, date, {_PCT.format('volume')} AS a, {_PCT.format('c')} AS b FROM s)
  SELECT code, date, round((a + b) / 2, 6) AS blend FROM r""")
def xs_rank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(xs.rank_blend(price_panel(spark, sf_dir), {"volume": 1, "close": -1}).select("code", "date", "blend"))


@query(f"""WITH {PANEL}, z AS (SELECT code, date, CASE WHEN stddev_pop(volume) OVER d > 0 THEN (volume - avg(volume) OVER d) / stddev_pop(volume) OVER d ELSE 0.0 END AS a,
  CASE WHEN stddev_pop(close) OVER d > 0 THEN (close - avg(close) OVER d) / stddev_pop(close) OVER d ELSE 0.0 END AS b FROM panel WINDOW d AS (PARTITION BY date))
  SELECT code, date, round(a * 0.75 + b * -0.25, 6) AS blend FROM z""")
def xs_weighted_z_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(xs.z_blend(price_panel(spark, sf_dir), {"volume": 3.0, "close": -1.0}).select("code", "date", "blend"))


@query(f"""WITH {PANEL}, u AS (SELECT code, date, 'volume' AS factor, volume AS value FROM panel UNION ALL SELECT code, date, 'close', close FROM panel)
  SELECT code, date, factor, value * CASE WHEN factor = 'close' THEN -1 ELSE 1 END AS value FROM u""")
def xs_direction_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = price_panel(spark, sf_dir).unpivot(["code", "date"], ["volume", "close"], "factor", "value")
    meta = spark.createDataFrame([("volume", 1), ("close", -1)], "factor string, direction int")
    return xs.directed(long, meta).select("code", "date", "factor", "value")


@query(f"""WITH {PANEL}, m AS (SELECT *, median(close) OVER (PARTITION BY date) AS mid FROM panel), d AS (SELECT *, median(abs(close - mid)) OVER (PARTITION BY date) AS mad FROM m),
  w AS (SELECT *, CASE WHEN mad > 0 THEN least(greatest(close, mid - mad * 1.4826::DOUBLE * 3.0), mid + mad * 1.4826::DOUBLE * 3.0) ELSE close END AS x FROM d),
  n AS (SELECT *, x - avg(x) OVER (PARTITION BY date, industry) AS y FROM w),
  z AS (SELECT *, CASE WHEN stddev_pop(y) OVER d > 1e-9 THEN (y - avg(y) OVER d) / stddev_pop(y) OVER d WHEN stddev_pop(y) OVER d = 0 THEN 0.0 END AS score FROM n WINDOW d AS (PARTITION BY date))
  SELECT code, date, round(score, 4) AS score FROM z""")
def xs_process_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(xs.processed(price_panel(spark, sf_dir), "close", "industry").select("code", "date", "score"), 4)


@query(f"""WITH {PANEL}, g AS (SELECT code, date, CASE WHEN close - open > 0 THEN close - open END AS x FROM panel),
  r AS (SELECT code, date, x, (rank() OVER (PARTITION BY date ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0) / nullif(count(x) OVER d, 0) AS p,
        CASE WHEN stddev_pop(x) OVER d > 0 THEN (x - avg(x) OVER d) / stddev_pop(x) OVER d ELSE 0.0 END AS z FROM g WINDOW d AS (PARTITION BY date))
  SELECT code, date, round(CASE WHEN x IS NULL THEN 0.0 ELSE p END, 6)::DOUBLE AS positive_pct, round(CASE WHEN x IS NULL THEN 0.0 ELSE least(greatest(z, -3.0), 3.0) END, 6)::DOUBLE AS positive_z FROM r""")
def xs_positive_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = price_panel(spark, sf_dir).withColumn("gain", F.col("close") - F.col("open"))
    return rounded(xs.positive_scores(rows, "gain").select("code", "date", "positive_pct", "positive_z"))
