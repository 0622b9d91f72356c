"""Recursions along a key, run as prefix scans: weighted means, volatility, Kalman filter and smoother."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expr import ordered, pct_change
from tessera.operators import recursion as rc
from tessera.plans.panel import PANEL, price_panel
from tessera.plans.registry import query, rounded

_RETURNS = f"""{PANEL}, rets AS (SELECT code, date, row_number() OVER w AS k, close, close / nullif(lag(close) OVER w, 0) - 1 AS ret FROM panel WINDOW w AS (PARTITION BY code ORDER BY date)),
  paired AS (SELECT code, date, k, close, ret, avg(ret) OVER (PARTITION BY date) AS market FROM rets)"""


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = price_panel(spark, sf_dir).select("code", "date", "close").withColumn("ret", pct_change("close", ordered("code", "date")))
    return rows.withColumn("market", F.avg("ret").over(ordered("date", "code").rowsBetween(-(2**63), 2**63 - 1)))


@query(f"""WITH RECURSIVE {_RETURNS}, f AS (
  SELECT code, 0::BIGINT AS k, NULL::DATE AS date, 1.0::DOUBLE AS b, 100.0::DOUBLE AS p FROM panel GROUP BY code
  UNION ALL
  SELECT r.code, r.k, r.date,
    CASE WHEN ret IS NULL OR market IS NULL THEN b ELSE b + (p + 1e-5) * market / (market * market * (p + 1e-5) + 1e-3) * (ret - market * b) END,
    CASE WHEN ret IS NULL OR market IS NULL THEN p + 1e-5 ELSE (1 - (p + 1e-5) * market / (market * market * (p + 1e-5) + 1e-3) * market) * (p + 1e-5) END
  FROM f JOIN paired r ON r.code = f.code AND r.k = f.k + 1)
  SELECT code, date, round(b, 6) AS beta, round(sqrt(p), 6) AS beta_std FROM f WHERE k > 0""")
def ts_kalman_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rc.kalman_beta(_returns(spark, sf_dir), "ret", "market").select("code", "date", "beta", "beta_std"))


@query(f"""WITH RECURSIVE {_RETURNS}, f AS (
  SELECT code, 0::BIGINT AS k, NULL::DATE AS date, close AS s, 10.0::DOUBLE AS p FROM paired WHERE k = 1
  UNION ALL
  SELECT r.code, r.k, r.date, s + (p + 1e-5) / (p + 1e-5 + 1e-3) * (close - s), (1 - (p + 1e-5) / (p + 1e-5 + 1e-3)) * (p + 1e-5)
  FROM f JOIN paired r ON r.code = f.code AND r.k = f.k + 1),
  last AS (SELECT code, max(k) AS n FROM f GROUP BY code),
  b AS (SELECT code, k, date, s, p, s AS smooth FROM f JOIN last USING (code) WHERE k = n
    UNION ALL
    SELECT f.code, f.k, f.date, f.s, f.p, f.s + f.p / (f.p + 1e-5) * (b.smooth - f.s) FROM b JOIN f ON f.code = b.code AND f.k = b.k - 1 AND f.k > 0)
  SELECT code, date, round(s, 5) AS state, round(sqrt(p), 6) AS state_std, round(smooth, 5) AS smooth FROM b""")
def ts_kalman_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rc.kalman_smooth(price_panel(spark, sf_dir).select("code", "date", "close"), "close")
    return rows.select("code", "date", F.round("state", 5).alias("state"), F.round("state_std", 6).alias("state_std"), F.round("smooth", 5).alias("smooth"))


@query(f"""WITH RECURSIVE {_RETURNS}, f AS (
  SELECT code, k, date, close AS plain, close AS s, 1.0::DOUBLE AS w, NULL::DOUBLE AS vw, NULL::DOUBLE AS v2, NULL::DOUBLE AS vs, NULL::DOUBLE AS vq FROM paired WHERE k = 1
  UNION ALL
  SELECT r.code, r.k, r.date, 2.0 / 13 * close + 11.0 / 13 * plain, close + 0.9 * s, 1 + 0.9 * w,
    CASE WHEN ret IS NULL THEN vw WHEN vw IS NULL THEN 1 ELSE 0.94 * vw + 0.06 END, CASE WHEN ret IS NULL THEN v2 WHEN v2 IS NULL THEN 1 ELSE 0.94 * 0.94 * v2 + 0.06 * 0.06 END,
    CASE WHEN ret IS NULL THEN vs WHEN vs IS NULL THEN ret ELSE 0.94 * vs + 0.06 * ret END, CASE WHEN ret IS NULL THEN vq WHEN vq IS NULL THEN ret * ret ELSE 0.94 * vq + 0.06 * ret * ret END
  FROM f JOIN paired r ON r.code = f.code AND r.k = f.k + 1)
  SELECT code, date, round(plain, 6) AS ema_12, round(s / w, 6) AS ewm_adjusted,
    CASE WHEN vw * vw - v2 > 1e-12 THEN round(sqrt(greatest(vq / vw - (vs / vw) * (vs / vw), 0) * vw * vw / (vw * vw - v2)), 6) END AS volatility FROM f""")
def ts_ewm(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [rc.ewm_mean("close", 2 / 13, "ema_12"), rc.ewm_adjusted("close", 0.1, "ewm_adjusted"), rc.ewm_deviation("ret", 0.06, "volatility")]
    return rounded(rc.scan(_returns(spark, sf_dir), steps).select("code", "date", "ema_12", "ewm_adjusted", "volatility"))
