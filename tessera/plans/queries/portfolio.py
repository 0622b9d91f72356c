"""Portfolio operators on the weekly price panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expr import ordered, pct_change, running
from tessera.operators import portfolio as pf
from tessera.plans.panel import PANEL, price_panel, table
from tessera.plans.registry import query, rounded

_EQUITY = """equity AS (SELECT user_id % 5 AS strategy, CAST(ts AS DATE) AS date, 1000 + sum((event_id * 7919) % 2001 - 1000) OVER (PARTITION BY user_id % 5 ORDER BY CAST(ts AS DATE) RANGE UNBOUNDED PRECEDING) / 100.0 AS total_value FROM events),
  eq AS (SELECT DISTINCT strategy, date, total_value::DOUBLE AS total_value FROM equity)"""


def _equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("strategy"), F.to_date("ts").alias("date")).agg(F.sum((F.col("event_id") * 7919) % 2001 - 1000).alias("v"))
    total = F.sum("v").over(running(ordered("strategy", "date")))
    return day.select("strategy", "date", (F.lit(1000) + total / F.lit(100.0)).cast("double").alias("total_value"))


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_panel(spark, sf_dir).withColumn("ret", pct_change("close", ordered("code", "date")))


@query()
def pf_simulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ordered("code", "date")
    rows = price_panel(spark, sf_dir).withColumn("tradable", F.col("high") > F.col("low"))
    names = F.explode(F.array(F.lit("momentum"), F.lit("reversal"))).alias("strategy")
    rows = rows.select(names, "date", "code", "open", "close", "amount", "tradable", pct_change("close", w, 4).alias("m"))
    rows = rows.withColumn("score", F.when(F.col("strategy") == "momentum", F.col("m")).otherwise(-F.col("m"))).drop("m")
    return rounded(pf.simulate(rows, pf.SimConfig(cash=10_000_000.0)), 2)


@query(f"""WITH {_EQUITY}, r AS (SELECT *, total_value / nullif(lag(total_value) OVER w, 0) - 1 AS r, total_value / max(total_value) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM eq WINDOW w AS (PARTITION BY strategy ORDER BY date)),
  u AS (SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM r), l AS (SELECT *, sum(CASE WHEN dd < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY strategy, g) AS len FROM u),
  a AS (SELECT strategy, arg_min(total_value, date) AS f, arg_max(total_value, date) AS l, count(r) AS n, avg(r) AS m, stddev_samp(r) AS s, sqrt(avg(pow(least(r, 0.0), 2))) AS d, min(dd) AS md, max(len) AS lf, avg(CASE WHEN r IS NOT NULL THEN (r > 0)::INT::DOUBLE END) AS wr, quantile_cont(r, 0.05) AS q FROM l GROUP BY strategy),
  b AS (SELECT *, l / f - 1 AS t, pow(l / f, 252.0 / n) - 1 AS an FROM a)
  SELECT strategy, n, round(t, 6) AS total_return, round(an, 6) AS annual_return, round(s * sqrt(252.0::DOUBLE), 6) AS volatility, round(m / nullif(s, 0) * sqrt(252.0::DOUBLE), 6) AS sharpe, round(m / nullif(d, 0) * sqrt(252.0::DOUBLE), 6) AS sortino, round(md, 6) AS max_drawdown,
  lf::BIGINT AS longest_fall, round(an / nullif(abs(md), 0), 6) AS calmar, round(wr, 6) AS win_rate, round(greatest(-q, 0.0), 6) AS var_95 FROM b""")
def pf_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pf.performance(_equity(spark, sf_dir)))


@query(f"""WITH {PANEL}, r AS (SELECT industry, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS ret FROM panel), v AS (SELECT industry, quantile_cont(-ret, 0.95) AS v FROM r WHERE ret IS NOT NULL GROUP BY industry)
  SELECT industry, round(greatest(any_value(v), 0.0), 6) AS var, round(greatest(avg(-ret), 0.0), 6) AS cvar FROM r JOIN v USING (industry) WHERE -ret >= v GROUP BY industry""")
def pf_tail_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pf.tail_risk(_returns(spark, sf_dir).where("ret is not null"), "ret", "industry"))


@query(f"""WITH {PANEL}, s AS (SELECT date, volume / nullif(sum(volume) OVER (PARTITION BY date), 0) AS s FROM panel) SELECT date, round(sum(s * s), 8) AS hhi, round(1.0 / nullif(sum(s * s), 0), 6) AS effective_n FROM s GROUP BY date""")
def pf_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pf.concentration(price_panel(spark, sf_dir), "volume", "date")
    return rows.select("date", F.round("hhi", 8).alias("hhi"), F.round("effective_n", 6).alias("effective_n"))


@query(f"""WITH {PANEL}, r AS (SELECT *, close / open - 1 AS ret FROM panel WHERE date = (SELECT max(date) FROM panel WHERE date < DATE '2000-01-01')), p AS (SELECT CAST(industry AS VARCHAR) AS sector, sum(volume) AS w, sum(volume * ret) / sum(volume) AS r FROM r WHERE code % 2 = 0 GROUP BY 1),
  b AS (SELECT CAST(industry AS VARCHAR) AS sector, sum(amount) AS w, sum(amount * ret) / sum(amount) AS r FROM r GROUP BY 1),
  j AS (SELECT coalesce(p.sector, b.sector) AS sector, coalesce(p.w / (SELECT sum(w) FROM p), 0) AS wp, coalesce(p.r, 0) AS rp, coalesce(b.w / (SELECT sum(w) FROM b), 0) AS wb, coalesce(b.r, 0) AS rb FROM p FULL OUTER JOIN b ON p.sector = b.sector)
  SELECT sector, round((wp - wb) * (rb - sum(wb * rb) OVER ()), 6) AS allocation, round(wb * (rp - rb), 6) AS selection, round((wp - wb) * (rp - rb), 6) AS interaction FROM j""")
def pf_brinson(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = price_panel(spark, sf_dir)
    last = panel.where("date < date '2000-01-01'").agg(F.max("date").alias("last"))
    rows = panel.join(F.broadcast(last), F.col("date") == F.col("last")).select("code", F.col("industry").cast("string").alias("sector"), "volume", "amount", (F.col("close") / F.col("open") - 1).alias("ret"))
    return rounded(pf.brinson(rows.where("code % 2 = 0").withColumn("weight", F.col("volume")), rows.withColumn("weight", F.col("amount"))))


@query(f"""WITH {PANEL}, e AS (SELECT code, date AS entered, CAST(date + INTERVAL 70 DAY AS DATE) AS until, close * 0.6 AS stop, close * 1.8 AS target FROM panel WHERE month(date) = 6 AND day(date) <= 7),
  h AS (SELECT e.*, p.date, p.close, CASE WHEN p.low <= stop THEN 'stop' WHEN p.high >= target THEN 'target' END AS k FROM e LEFT JOIN panel p ON p.code = e.code AND p.date > entered AND p.date <= until),
  a AS (SELECT code, entered, any_value(stop) AS stop, any_value(target) AS target, min(date) FILTER (WHERE k IS NOT NULL) AS hd, arg_min(k, date) FILTER (WHERE k IS NOT NULL) AS k, max(date) AS ed, arg_max(close, date) AS ec FROM h GROUP BY 1, 2)
  SELECT code, entered, coalesce(hd, ed) AS left_on, round(CASE WHEN k = 'stop' THEN stop WHEN k = 'target' THEN target ELSE ec END, 7) AS price, coalesce(k, CASE WHEN ed IS NOT NULL THEN 'time_stop' ELSE 'no_bars' END) AS reason FROM a""")
def pf_exit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = price_panel(spark, sf_dir)
    entries = panel.where("month(date) = 6 and day(date) <= 7").select("code", F.col("date").alias("entered"), F.date_add("date", 70).alias("until"), (F.col("close") * 0.6).alias("stop"), (F.col("close") * 1.8).alias("target"))
    return rounded(pf.exits(entries, panel.select("code", "date", "high", "low", "close")), 7)


@query(f"""WITH {PANEL}, f AS (SELECT *, close / nullif(lag(close, 4) OVER w, 0) - 1 AS mom, close / nullif(lag(close) OVER w, 0) - 1 AS ret FROM panel WINDOW w AS (PARTITION BY code ORDER BY date)),
  g AS (SELECT *, ntile(5) OVER (PARTITION BY date ORDER BY mom, code) AS grp FROM f WHERE mom IS NOT NULL), h AS (SELECT *, lag(grp) OVER w AS was, lead(ret) OVER w AS nx FROM g WINDOW w AS (PARTITION BY code ORDER BY date))
  SELECT date, grp AS "group", round(avg(nx), 6) AS gross, round(avg(CASE WHEN was = grp THEN 0.0 ELSE 1.0 END), 6) AS turnover, count(*) AS n, round(avg(nx) - avg(CASE WHEN was = grp THEN 0.0 ELSE 1.0 END) * 0.001, 6) AS net FROM h GROUP BY 1, 2""")
def pf_group_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ordered("code", "date")
    rows = price_panel(spark, sf_dir).select("code", "date", pct_change("close", w, 4).alias("mom"), pct_change("close", w).alias("ret"))
    return rounded(pf.group_backtest(rows, "mom", "ret"))


@query(f"""WITH {PANEL}, r AS (SELECT code, date, close, first_value(close) OVER w AS entry, max(high) OVER w AS peak, row_number() OVER (PARTITION BY code ORDER BY date) - 1 AS age FROM panel WINDOW w AS (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING))
  SELECT code, date, CASE WHEN close / entry - 1 <= -0.08 THEN 'fixed' WHEN close <= peak * 0.9::DOUBLE THEN 'trailing' WHEN age >= 60 THEN 'time' WHEN peak / entry - 1 >= 0.2 AND close / entry - 1 <= (peak / entry - 1) * 0.5 THEN 'profit_lock' ELSE 'hold' END AS rule FROM r""")
def pf_stop_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.stop_rules(price_panel(spark, sf_dir)).select("code", "date", "rule")


@query("""WITH s AS (SELECT * FROM (VALUES ('crash', 'BUILDING', -0.3), ('crash', 'MACHINERY', -0.2), ('rates', 'BUILDING', -0.1), ('rates', 'HOUSEHOLD', 0.05)) t(scenario, sector, shock))
  SELECT scenario, c_nationkey AS code, round(sum(c_acctbal * shock::DOUBLE), 4) AS profit FROM customer JOIN s ON c_mktsegment = sector GROUP BY 1, 2""")
def pf_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    shocks = spark.createDataFrame([("crash", "BUILDING", -0.3), ("crash", "MACHINERY", -0.2), ("rates", "BUILDING", -0.1), ("rates", "HOUSEHOLD", 0.05)], "scenario string, sector string, shock double")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("code"), F.col("c_mktsegment").alias("sector"), F.col("c_acctbal").alias("exposure"))
    return rounded(pf.stressed(rows, shocks), 4)


@query("""WITH t AS (SELECT d, row_number() OVER (ORDER BY d) AS p, ntile(5) OVER (ORDER BY d) AS fold FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)), s AS (SELECT fold, min(p) AS a, max(p) AS b FROM t GROUP BY fold)
  SELECT s.fold, t.d AS date FROM s JOIN t ON t.p < s.a - 2 OR t.p > s.b + 1""")
def pf_purged_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.purged_folds(table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")), 5, 2, 1)
