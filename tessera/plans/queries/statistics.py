"""Statistics, seasonality and regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expr import ordered, pct_change
from tessera.operators import statistics as st
from tessera.plans.panel import PANEL, price_panel, table
from tessera.plans.registry import query, rounded

_R = f"{PANEL}, r AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS ret FROM panel)"


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_panel(spark, sf_dir).withColumn("ret", pct_change("close", ordered("code", "date")))


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b, avg(value) AS mean, stddev_samp(value) AS s FROM events GROUP BY 1),
  d AS (SELECT event_type, median(abs(value - m)) AS mad FROM events JOIN q USING (event_type) GROUP BY 1)
  SELECT event_id, round((value - mean) / nullif(s, 0), 9) AS z, round(0.6745::DOUBLE * ((value - m) / nullif(mad, 0)), 9) AS mad_z, (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS beyond FROM events JOIN q USING (event_type) JOIN d USING (event_type)""")
def st_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.outliers(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "value", "event_type").select("event_id", "z", "mad_z", "beyond"), 9)


@query(f"""WITH {_R}, c AS (SELECT code, (close IS NULL)::INT + coalesce(close <= 0, false)::INT + coalesce(abs(ret) > 0.3, false)::INT + coalesce(date_diff('day', lag(date) OVER (PARTITION BY code ORDER BY date), date) > 21, false)::INT AS i FROM r)
  SELECT code, count(*) AS rows, sum(i)::BIGINT AS issues, round(1 - sum(i) / (count(*) * 4.0), 6)::DOUBLE AS score FROM c GROUP BY code""")
def st_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.quality_score(price_panel(spark, sf_dir)))


@query(f"""WITH {PANEL}, s AS (SELECT code, date, volume / nullif(avg(volume) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS ratio FROM panel) SELECT code, date, round(ratio, 7) AS ratio FROM s WHERE ratio > 2.5""")
def st_volume_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.spikes(price_panel(spark, sf_dir), "volume", 20, 2.5).select("code", "date", "ratio"), 7)


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS date, max(value) AS v FROM events GROUP BY 1, 2), r AS (SELECT *, v / nullif(lag(v) OVER (PARTITION BY user_id ORDER BY date), 0) - 1 AS ret FROM d)
  SELECT (isodow(date) - 1)::BIGINT AS bucket, round(avg(ret), 6) AS mean, round(avg((ret > 0)::INT::DOUBLE), 6) AS win_rate, round(stddev_samp(ret), 6) AS std, round(median(ret), 6) AS median, count(*) AS n FROM r WHERE ret IS NOT NULL GROUP BY 1""")
def st_weekday_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(F.max("value").alias("v"))
    rows = days.withColumn("ret", pct_change("v", ordered("user_id", "date")))
    return rounded(st.calendar_effect(rows, "ret", F.weekday("date").cast("bigint")))


@query(f"""WITH {_R} SELECT month(date)::INT AS bucket, round(avg(ret), 6) AS mean, round(avg((ret > 0)::INT::DOUBLE), 6) AS win_rate, round(stddev_samp(ret), 6) AS std, round(median(ret), 6) AS median, count(*) AS n FROM r WHERE ret IS NOT NULL GROUP BY 1""")
def st_month_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.calendar_effect(_returns(spark, sf_dir), "ret", F.month("date")))


@query(f"""WITH {_R}, a AS (SELECT code, date, close, CASE WHEN count(close) OVER l >= 40 THEN avg(close) OVER l END AS mean, CASE WHEN count(ret) OVER s >= 20 THEN stddev_samp(ret) OVER s END AS vol
  FROM r WINDOW l AS (PARTITION BY code ORDER BY date ROWS BETWEEN 39 PRECEDING AND CURRENT ROW), s AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
  b AS (SELECT *, CASE WHEN count(vol) OVER l >= 20 THEN quantile_cont(vol, 0.8) OVER l END AS edge FROM a WINDOW l AS (PARTITION BY code ORDER BY date ROWS BETWEEN 39 PRECEDING AND CURRENT ROW))
  SELECT code, date, CASE WHEN mean IS NULL OR edge IS NULL THEN 'unknown' WHEN close > mean THEN CASE WHEN vol <= edge THEN 'calm_up' ELSE 'wild_up' END ELSE CASE WHEN vol <= edge THEN 'calm_down' ELSE 'wild_down' END END AS regime FROM b""")
def st_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.regimes(price_panel(spark, sf_dir), "close").select("code", "date", "regime")


_DAYS = """days AS (SELECT CAST(ts AS DATE) AS date, count(*) FILTER (WHERE event_type = 'view') AS up, max(value)::INT % 7 AS top, count(*) FILTER (WHERE event_type = 'error')::DOUBLE / count(*) AS broken_share, count(*) FILTER (WHERE value > 60) AS losers FROM events GROUP BY 1),
  stage AS (SELECT date, CASE WHEN up >= 100 AND top >= 5 THEN 'climax' WHEN broken_share >= 0.35 THEN 'divergence' WHEN losers >= 15 THEN 'divergence' WHEN up <= 35 AND top <= 2 THEN 'ice' WHEN up <= 30 THEN 'ice' WHEN up >= 60 THEN 'ferment' ELSE 'repair' END AS stage FROM days)"""


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(
        F.count_if(F.col("event_type") == "view").alias("up"), (F.round(F.max("value")).cast("int") % 7).alias("top"),
        (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("broken_share"), F.count_if(F.col("value") > 60).alias("losers"),
    )
    return st.stages(days)


@query(f"WITH {_DAYS} SELECT date, stage FROM stage")
def st_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stages(spark, sf_dir).select("date", "stage")


@query(f"""WITH {PANEL}, s AS (SELECT code, date, CASE WHEN r > 0.02 THEN 'up' WHEN r < -0.02 THEN 'down' WHEN r IS NOT NULL THEN 'flat' ELSE 'unknown' END AS s FROM (SELECT code, date, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS r FROM panel)),
  t AS (SELECT s AS now, lead(s) OVER (PARTITION BY code ORDER BY date) AS nx FROM s), c AS (SELECT now, nx, count(*) AS n FROM t WHERE nx IS NOT NULL GROUP BY 1, 2) SELECT now, nx AS next, n, round(n / sum(n) OVER (PARTITION BY now), 6)::DOUBLE AS share FROM c""")
def st_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each code's weeks that rise, fall or do neither."""
    move = pct_change("close", ordered("code", "date"))
    rows = price_panel(spark, sf_dir).select("code", "date", move.alias("r"))
    state = F.when(F.col("r") > 0.02, "up").when(F.col("r") < -0.02, "down").when(F.col("r").isNotNull(), "flat").otherwise("unknown")
    return rounded(st.transitions(rows.withColumn("state", state), "state", "date", "code"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS date, count(*)::DOUBLE AS n, max(value) AS top, count(DISTINCT user_id)::DOUBLE AS users FROM events GROUP BY 1), s AS (SELECT stddev_pop(n) AS a, stddev_pop(top) AS b, stddev_pop(users) AS c FROM d), l AS (SELECT * FROM d ORDER BY date DESC LIMIT 1),
  r AS (SELECT d.date, row_number() OVER (ORDER BY d.date DESC) AS p, coalesce(pow((d.n - l.n) / nullif(a, 0), 2), 0) + coalesce(pow((d.top - l.top) / nullif(b, 0), 2), 0) + coalesce(pow((d.users - l.users) / nullif(c, 0), 2), 0) AS distance FROM d, s, l)
  SELECT date, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity FROM r WHERE p > 5 ORDER BY distance, date LIMIT 5""")
def st_similar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count("*").cast("double").alias("n"), F.max("value").alias("top"), F.countDistinct("user_id").cast("double").alias("users"))
    return rounded(st.similar_days(days, ["n", "top", "users"], 5, 5))


@query(f"""WITH {PANEL}, b AS (SELECT code, volume, floor(ln(low) / ln(1.05::DOUBLE))::BIGINT AS lo, floor(ln(high) / ln(1.05::DOUBLE))::BIGINT AS hi FROM panel),
  c AS (SELECT code, unnest(range(lo, hi + 1)) AS cell, volume / (hi - lo + 1) AS v FROM b), o AS (SELECT code, cell, sum(v) AS volume FROM c GROUP BY 1, 2)
  SELECT code, cell, round(volume, 5) AS volume, round(volume / sum(volume) OVER (PARTITION BY code), 6) AS share FROM o""")
def st_volume_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.volume_profile(price_panel(spark, sf_dir), 0.05)
    return rows.select("code", "cell", F.round("volume", 5).alias("volume"), F.round("share", 6).alias("share"))


@query(f"""WITH {PANEL}, m AS (SELECT date, avg(close) AS bench FROM panel GROUP BY date), a AS (SELECT code, date, close / nullif(bench, 0) AS rs, row_number() OVER (PARTITION BY code ORDER BY date)::DOUBLE AS k FROM panel JOIN m USING (date)),
  b AS (SELECT *, CASE WHEN count(rs) OVER w >= 20 THEN avg(rs) OVER w END AS rm FROM a WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
  SELECT code, date, round(rs, 6) AS rs, round(rm, 6) AS rs_mean, round(CASE WHEN count(rm) OVER v >= 5 THEN regr_slope(rm, k) OVER v END, 6) AS rs_slope FROM b WINDOW v AS (PARTITION BY code ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def st_relative_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.relative_strength(price_panel(spark, sf_dir)).select("code", "date", "rs", "rs_mean", "rs_slope"))


@query(f"""WITH {_R}, l AS (SELECT volume, ret AS y0, lead(ret, 1) OVER w AS y1, lead(ret, 2) OVER w AS y2 FROM r WINDOW w AS (PARTITION BY code ORDER BY date))
  SELECT 0 AS lag, round(corr(volume, y0), 6) AS corr FROM l UNION ALL SELECT 1, round(corr(volume, y1), 6) FROM l UNION ALL SELECT 2, round(corr(volume, y2), 6) FROM l""")
def st_lagged_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.lagged_correlation(_returns(spark, sf_dir), "volume", "ret", 2))


@query("""WITH r AS (SELECT user_id % 10 AS model, event_id % 3 = 0 AS hit, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id DESC) AS p FROM events),
  a AS (SELECT model, avg(CASE WHEN p <= 50 THEN hit::INT::DOUBLE END) AS recent, avg(CASE WHEN p > 50 THEN hit::INT::DOUBLE END) AS prior, count(*) AS n FROM r GROUP BY model)
  SELECT model, round(recent, 6) AS recent, round(prior, 6) AS prior, n, CASE WHEN n < 100 THEN 'insufficient_samples' WHEN recent - prior < -0.05 THEN 'drift' ELSE 'stable' END AS status FROM a""")
def st_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("model"), (F.col("event_id") % 3 == 0).alias("hit"), "event_id")
    return rounded(st.drift(rows, "hit", 50, "model", "event_id").select("model", "recent", "prior", "n", "status"))


@query()
def st_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.bootstrap_mean(table(spark, sf_dir, "events").select("event_type", "value"), "value", "event_type", 200)


@query(f"""WITH {_R}, n AS (SELECT *, lead(ret) OVER (PARTITION BY code ORDER BY date) AS nx FROM r), d AS (SELECT date, count(*) AS n, max(floor(volume / 50)::BIGINT) AS top, avg((low < open * 0.5)::INT::DOUBLE) AS b, avg(nx) AS p, count(*) FILTER (WHERE nx < -0.5) AS losses FROM n WHERE ret > 0.5 GROUP BY date)
  SELECT date, n, top, round(b, 6) AS broken_share, round(p, 6) AS premium, losses, round(avg(n) OVER (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS n_3 FROM d""")
def st_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _returns(spark, sf_dir).withColumn("nx", F.lead("ret").over(ordered("code", "date"))).where("ret > 0.5")
    rows = rows.withColumn("board", F.floor(F.col("volume") / 50).cast("bigint")).withColumn("broken", F.col("low") < F.col("open") * 0.5)
    return rounded(st.ladder(rows, "board", "date", "broken", "nx"))


@query(f"""WITH {PANEL}, r AS (SELECT code, date, coalesce((close / nullif(lag(close) OVER w, 0) - 1) * 100, 0.0) AS pct, lag(close) OVER w AS p, count(*) OVER (PARTITION BY code) AS n FROM panel WINDOW w AS (PARTITION BY code ORDER BY date)),
  z AS (SELECT code, date, pct, (pct - avg(pct) OVER k) / CASE WHEN stddev_pop(pct) OVER k > 0 THEN stddev_pop(pct) OVER k ELSE 1.0 END AS z FROM r WHERE n >= 10 AND p IS NOT NULL WINDOW k AS (PARTITION BY code))
  SELECT code, date, round(pct, 6) AS pct, round(z, 6) AS z, abs(pct) > 15 AS likely_error FROM z WHERE abs(z) > 2.5""")
def st_price_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.price_anomalies(price_panel(spark, sf_dir), limit=2.5))
