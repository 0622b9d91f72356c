"""Factor risk of the weekly panel: two styles and the market."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expr import ordered, pct_change
from tessera.operators import risk as rk
from tessera.plans.panel import PANEL, price_panel
from tessera.plans.registry import query, rounded
from tessera.sources.scratch import stored

STYLES = ["size", "momentum"]

_EXPOSED = f"""{PANEL}, raw AS (
    SELECT code, date, industry, amount, close / nullif(lag(close) OVER w, 0) - 1 AS ret, ln(avg(amount) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS size,
      lag(close, 1) OVER w / nullif(lag(close, 9) OVER w, 0) - 1 AS momentum FROM panel WINDOW w AS (PARTITION BY code ORDER BY date)),
  mid AS (SELECT *, median(size) OVER d AS ms, median(momentum) OVER d AS mm FROM raw WINDOW d AS (PARTITION BY date)),
  mad AS (SELECT *, median(abs(size - ms)) OVER d AS ds, median(abs(momentum - mm)) OVER d AS dm FROM mid WINDOW d AS (PARTITION BY date)),
  held AS (SELECT * REPLACE (CASE WHEN ds < 1e-12 OR size IS NULL THEN size ELSE least(greatest(size, ms - 3 * ds), ms + 3 * ds) END AS size,
      CASE WHEN dm < 1e-12 OR momentum IS NULL THEN momentum ELSE least(greatest(momentum, mm - 3 * dm), mm + 3 * dm) END AS momentum) FROM mad),
  exposed AS (SELECT code, date, industry, amount, ret,
      coalesce(CASE WHEN size IS NULL THEN 0 WHEN stddev_pop(size) OVER d > 1e-12 THEN least(greatest((size - avg(size) OVER d) / stddev_pop(size) OVER d, -3), 3) ELSE 0 END, 0) AS size,
      coalesce(CASE WHEN momentum IS NULL THEN 0 WHEN stddev_pop(momentum) OVER d > 1e-12 THEN least(greatest((momentum - avg(momentum) OVER d) / stddev_pop(momentum) OVER d, -3), 3) ELSE 0 END, 0) AS momentum
    FROM held WINDOW d AS (PARTITION BY date))"""

_FACTORS = """centred AS (SELECT *, ret - avg(ret) OVER d AS y, size - avg(size) OVER d AS a, momentum - avg(momentum) OVER d AS b, avg(ret) OVER d AS my, avg(size) OVER d AS ma, avg(momentum) OVER d AS mb
    FROM exposed WHERE ret IS NOT NULL WINDOW d AS (PARTITION BY date)),
  sums AS (SELECT date, count(*) AS assets, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS yb, any_value(my) AS my, any_value(ma) AS ma, any_value(mb) AS mb FROM centred GROUP BY date),
  slopes AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS fa, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS fb FROM sums WHERE assets >= 6 AND aa * bb - ab * ab > 1e-6 * aa * bb),
  fr AS (SELECT date, assets, my - fa * ma - fb * mb AS f0, fa AS f1, fb AS f2 FROM slopes)"""


def _exposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ordered("code", "date")
    rows = price_panel(spark, sf_dir).withColumn("ret", pct_change("close", w))
    styles = {"size": F.log(F.avg("amount").over(w.rowsBetween(-19, 0))), "momentum": F.try_divide(F.lag("close", 1).over(w), F.lag("close", 9).over(w)) - 1}
    return rk.exposures(rows, styles).select("code", "date", "industry", "amount", "ret", *STYLES)


def _returns(exposed: DataFrame) -> DataFrame:
    """Factor returns of dates whose exposures tell the styles apart."""
    usable = exposed.where(F.col("ret").isNotNull()).groupBy("date").agg(F.count("*").alias("n"), F.var_pop("size").alias("aa"), F.var_pop("momentum").alias("bb"), F.covar_pop("size", "momentum").alias("ab"))
    usable = usable.where((F.col("n") >= 6) & (F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab") > 1e-6 * F.col("aa") * F.col("bb")))
    return rk.factor_returns(exposed, STYLES).join(usable.select("date"), "date", "left_semi")


@query(f"""WITH {_EXPOSED} SELECT code, date, round(size, 6) AS size, round(momentum, 6) AS momentum FROM exposed""")
def rk_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_exposed(spark, sf_dir).select("code", "date", *STYLES))


@query(f"""WITH {_EXPOSED}, {_FACTORS} SELECT date, assets, round(f0, 6) AS market, round(f1, 6) AS size, round(f2, 6) AS momentum FROM fr""")
def rk_factor_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _returns(stored(_exposed(spark, sf_dir), "exposed"))
    return rounded(rows.select("date", "assets", *(F.col("returns")[k].alias(c) for k, c in enumerate([rk.MARKET, *STYLES]))))


@query(f"""WITH {_EXPOSED}, {_FACTORS},
  aged AS (SELECT *, count(*) OVER () AS n, power(2, -(row_number() OVER (ORDER BY date DESC) - 1) / 60.0) AS w0 FROM fr),
  weighed AS (SELECT *, w0 / sum(w0) OVER () AS w FROM aged),
  d AS (SELECT date, n, w, unnest([0, 1, 2]) AS i, unnest([f0 - sum(w * f0) OVER (), f1 - sum(w * f1) OVER (), f2 - sum(w * f2) OVER ()]) AS d FROM weighed),
  lagged AS (SELECT *, lag(d, 1) OVER l AS d1, lag(d, 2) OVER l AS d2 FROM d WINDOW l AS (PARTITION BY i ORDER BY date))
  SELECT a.i, b.i AS j, round(sum(a.w * (a.d * b.d + 2.0 / 3 * coalesce(a.d * b.d1 + b.d * a.d1, 0) + 1.0 / 3 * coalesce(a.d * b.d2 + b.d * a.d2, 0))) * any_value(a.n) / greatest(any_value(a.n) - 1, 1), 8) AS cov, any_value(a.n) AS n
  FROM lagged a JOIN lagged b USING (date) GROUP BY a.i, b.i""")
def rk_factor_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rk.factor_covariance(_returns(stored(_exposed(spark, sf_dir), "exposed"))), 8)


@query(f"""WITH {_EXPOSED}, {_FACTORS},
  rest AS (SELECT code, e.date, ret - f0 - f1 * size - f2 * momentum AS e FROM exposed e JOIN fr USING (date) WHERE ret IS NOT NULL),
  aged AS (SELECT *, power(2, -(row_number() OVER (PARTITION BY code ORDER BY date DESC) - 1) / 60.0) AS w, e - avg(e) OVER (PARTITION BY code) AS d FROM rest)
  SELECT code, round(greatest(sum(w * d * d) / sum(w) * count(*) / greatest(count(*) - 1, 1), 1e-4), 7) AS variance FROM aged GROUP BY code""")
def rk_specific_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    exposed = stored(_exposed(spark, sf_dir), "exposed")
    return rounded(rk.specific_variance(rk.residuals(exposed, _returns(exposed), STYLES)), 7)


@query()
def rk_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per date, the portfolio that holds each code by its amount, under the repaired covariance of all dates."""
    exposed = stored(_exposed(spark, sf_dir), "exposed")
    returns = stored(_returns(exposed), "factor-returns")
    cov = rk.repaired_covariance(rk.factor_covariance(returns))
    specific = rk.specific_variance(rk.residuals(exposed, returns, STYLES))
    held = exposed.withColumn("weight", F.try_divide("amount", F.sum("amount").over(ordered("date", "code").rowsBetween(-(2**63), 2**63 - 1))))
    return rk.decomposition(held, cov, specific, STYLES, ["date"])
