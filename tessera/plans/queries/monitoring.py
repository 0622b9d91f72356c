"""Watching the panel's portfolios, and phases and sessions of events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expr import ordered, pct_change
from tessera.operators import monitoring as mo
from tessera.plans.panel import PANEL, price_panel, table
from tessera.plans.queries import risk
from tessera.plans.registry import query, rounded
from tessera.sources.scratch import stored

_R = f"""{PANEL}, r0 AS (SELECT code, date, industry, close, volume, amount, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS ret FROM panel), r AS (SELECT *, avg(ret) OVER (PARTITION BY date) AS market FROM r0)"""
_BETAS = """b AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS back FROM r WHERE ret IS NOT NULL AND market IS NOT NULL),
  v AS (SELECT code, covar_samp(ret, market) FILTER (WHERE back <= 60) / var_pop(market) FILTER (WHERE back <= 60) AS current, covar_samp(ret, market) FILTER (WHERE back > 60) / var_pop(market) FILTER (WHERE back > 60) AS previous FROM b WHERE back <= 120 GROUP BY code HAVING count(*) >= 120)"""


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = price_panel(spark, sf_dir).withColumn("ret", pct_change("close", ordered("code", "date")))
    return rows.withColumn("market", F.avg("ret").over(ordered("date", "code").rowsBetween(-(2**63), 2**63 - 1)))


@query(f"WITH {_R}, {_BETAS} SELECT code, round(current, 6) AS current, round(previous, 6) AS previous, round(current - previous, 6) AS change FROM v")
def mo_beta_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mo.beta_windows(_returns(spark, sf_dir), "ret", "market"))


@query(f"""WITH {_R}, {_BETAS}, h AS (SELECT code, industry, sum(amount) AS weight FROM r GROUP BY 1, 2), g AS (SELECT industry, sum(weight * current) / sum(weight) AS current, sum(weight * previous) / sum(weight) AS previous FROM h JOIN v USING (code) GROUP BY industry)
  SELECT industry, round(current, 6) AS current, round(previous, 6) AS previous, round(current - previous, 6) AS change, abs(current - previous) > 0.3 AS alert FROM g""")
def mo_beta_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each industry as a portfolio that holds its codes by their amounts."""
    rows = stored(_returns(spark, sf_dir), "returns")
    held = rows.groupBy("code", "industry").agg(F.sum("amount").alias("weight"))
    return rounded(mo.beta_break(held, mo.beta_windows(rows, "ret", "market"), ["industry"]))


@query(f"""WITH {risk._EXPOSED}, {risk._FACTORS}, x AS (SELECT e.date, sum(amount * size) / sum(amount) AS xs, sum(amount * momentum) / sum(amount) AS xm, sum(amount * ret) / sum(amount) AS y FROM exposed e WHERE ret IS NOT NULL GROUP BY 1),
  m AS (SELECT x.*, f0, f1, f2, f0 + xs * f1 + xm * f2 AS model FROM x JOIN fr USING (date)),
  t AS (SELECT unnest(['market', 'size', 'momentum']) AS factor, unnest([1.0, avg(xs), avg(xm)]) AS exposure, unnest([sum(f0), sum(f1), sum(f2)]) AS ret, unnest([sum(f0), sum(xs * f1), sum(xm * f2)]) AS contribution, sum(y - model) AS residual, 1 - sum((y - model) * (y - model)) / (var_pop(y) * count(*)) AS r2 FROM m)
  SELECT factor, round(exposure, 5) AS exposure, round(ret, 5) AS ret, round(contribution, 5) AS contribution, round(residual, 5) AS residual, round(r2, 5) AS r2 FROM t""")
def mo_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The portfolio of all codes by their amounts."""
    exposed = stored(risk._exposed(spark, sf_dir), "exposed")
    named = risk._returns(exposed).select("date", *(F.col("returns")[k].alias(c) for k, c in enumerate(["market", *risk.STYLES])))
    rows = exposed.where("ret IS NOT NULL").withColumn("weight", F.col("amount")).withColumn("market", F.lit(1.0))
    portfolio = rows.groupBy("date").agg((F.sum(F.col("weight") * F.col("ret")) / F.sum("weight")).alias("ret"))
    return rounded(mo.attribution(rows, ["market", *risk.STYLES], named, portfolio), 5)


@query(f"""WITH {_R}, s AS (SELECT code, date, count(ret) OVER w AS n, avg(ret) OVER w AS m, stddev_samp(ret) OVER w AS sd, list(ret) OVER w AS x FROM r WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
  v AS (SELECT *, list_transform(range(1, len(x) + 1), lambda i: list_product(list_transform(list_filter(x, lambda u: u IS NOT NULL)[1:i], lambda u: 1 + u))) AS c FROM s WHERE n >= 21)
  SELECT s.code, s.date, CASE WHEN s.n >= 21 THEN round((s.m - 0.025 / 52) / nullif(s.sd, 0) * sqrt(52), 6) END AS sharpe, CASE WHEN s.n >= 21 THEN round(s.sd * sqrt(52), 6) END AS vol,
    round(list_min(list_transform(c, lambda p, i: p / list_max(c[1:i]) - 1)), 6) AS max_dd FROM s LEFT JOIN v ON s.code = v.code AND s.date = v.date""")
def mo_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mo.rolling_figures(_returns(spark, sf_dir), "ret", 21, periods=52.0).select("code", "date", "sharpe", "vol", "max_dd"))


@query(f"""WITH {PANEL}, a AS (SELECT code, date, volume, avg(volume) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS adv, sum(volume) OVER (PARTITION BY code) AS every FROM panel)
  SELECT code, date, round(volume / adv * 0.1 * 1e4 * CASE WHEN volume / every > 0.05 THEN 1 + 10 * (volume / every - 0.05) ELSE 1 END, 5) AS permanent, round(0.3 * 0.02 * power(volume / adv / 2, 0.6) * 1e4, 5) AS temporary FROM a""")
def mo_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What trading each bar's volume would cost against the mean of the bars before."""
    w = ordered("code", "date")
    rows = price_panel(spark, sf_dir).withColumn("adv", F.avg("volume").over(w.rowsBetween(-20, -1))).withColumn("every", F.sum("volume").over(ordered("code", "date").rowsBetween(-(2**63), 2**63 - 1)))
    return rounded(rows.select("code", "date", mo.permanent_impact("volume", "adv", 0.1, "every").alias("permanent"), mo.temporary_impact("volume", "adv", 0.3, 0.02, 0.6, 2.0).alias("temporary")), 5)


@query("""SELECT phase, event_type, count(*) AS n FROM (SELECT event_type, CASE WHEN dayofweek(ts) IN (0, 6) THEN 'closed' WHEN m BETWEEN 555 AND 564 THEN 'opening_auction' WHEN m BETWEEN 565 AND 569 THEN 'pause' WHEN m BETWEEN 570 AND 689 THEN 'continuous' WHEN m BETWEEN 690 AND 779 THEN 'lunch'
  WHEN m BETWEEN 780 AND 896 THEN 'continuous' WHEN m BETWEEN 897 AND 899 THEN 'closing_auction' ELSE 'closed' END AS phase FROM (SELECT event_type, ts, hour(ts) * 60 + minute(ts) AS m FROM events)) GROUP BY 1, 2""")
def mo_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(mo.phase("ts", ~F.dayofweek("ts").isin(1, 7)).alias("phase"), "event_type").agg(F.count("*").alias("n"))


@query(f"""WITH {PANEL}, s AS (SELECT DISTINCT date FROM panel), o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
  SELECT o_orderkey, (SELECT list_sort(list(date))[2] FROM s WHERE date > d) AS after_two, (SELECT list_reverse_sort(list(date))[1] FROM s WHERE date < d) AS before FROM o""")
def mo_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second session after each order, and the one before it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    sessions = stored(price_panel(spark, sf_dir).select("date").distinct(), "sessions")
    rows = mo.shifted_session(orders, sessions, 2, "d", "after_two")
    return mo.shifted_session(rows, sessions, -1, "d", "before").select("o_orderkey", "after_two", "before")
