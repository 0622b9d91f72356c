"""Decisions from what was measured, and files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expr import ordered, pct_change
from tessera.operators import decisions as de
from tessera.plans.panel import PANEL, price_panel
from tessera.plans.registry import query, rounded
from tessera.sources import files as fs
from tessera.sources.scratch import new_path, stored

_F = f"""{PANEL}, fp AS (SELECT code, date, close / nullif(lag(close, 4) OVER w, 0) - 1 AS mom, lead(close, 2) OVER w / nullif(close, 0) - 1 AS forward, lead(date, 2) OVER w AS known_on FROM panel WINDOW w AS (PARTITION BY code ORDER BY date))"""


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ordered("code", "date")
    rows = price_panel(spark, sf_dir).select("code", "date", pct_change("close", w, 4).alias("mom"), (F.try_divide(F.lead("close", 2).over(w), F.col("close")) - 1).alias("forward"), F.lead("date", 2).over(w).alias("known_on"))
    return stored(rows, "factors")


def _average_rank(x: str) -> str:
    return f"(rank() OVER (PARTITION BY date ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0)"


@query(f"""WITH {_F}, p AS (SELECT code, date, {_average_rank('mom')} / count(*) OVER (PARTITION BY date) AS pr FROM fp WHERE mom IS NOT NULL),
  k AS (SELECT fp.*, {_average_rank('mom')} / count(*) OVER (PARTITION BY date) AS pl FROM fp WHERE mom IS NOT NULL AND forward IS NOT NULL AND known_on IS NOT NULL),
  d AS (SELECT date, floor(least(pl, 0.999999) * 5)::BIGINT AS bucket, avg(forward) AS m, max(known_on) AS realized FROM k GROUP BY 1, 2), r AS (SELECT realized, bucket, avg(m) AS m FROM d GROUP BY 1, 2),
  c AS (SELECT realized, bucket, CASE WHEN count(m) OVER w >= 12 THEN avg(m) OVER w END AS e FROM r WINDOW w AS (PARTITION BY bucket ORDER BY realized ROWS UNBOUNDED PRECEDING)),
  q AS (SELECT date, b.b AS bucket FROM (SELECT DISTINCT date FROM fp), range(0, 5) b(b)), t AS (SELECT q.date, q.bucket, c.e FROM q ASOF LEFT JOIN c ON c.bucket = q.bucket AND c.realized <= q.date),
  x AS (SELECT code, date, least(greatest(pr * 5 - 0.5, 0), 4) AS x FROM p), y AS (SELECT *, floor(x)::BIGINT AS lo, least(floor(x) + 1, 4)::BIGINT AS hi FROM x)
  SELECT fp.code, fp.date, round(a.e * (1 - (x - lo)) + b.e * (x - lo), 6) AS expected_ret FROM fp LEFT JOIN y USING (code, date) LEFT JOIN t a ON a.date = y.date AND a.bucket = lo LEFT JOIN t b ON b.date = y.date AND b.bucket = hi""")
def de_expected_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = de.expected_return(_factors(spark, sf_dir), "mom", "forward", "known_on", 5, 12)
    return rounded(rows.select("code", "date", "expected_ret"))


@query(f"""WITH {_F}, h AS (SELECT code, year(date) AS year, corr(mom, forward) AS ic, count(*) AS n FROM fp WHERE mom IS NOT NULL AND forward IS NOT NULL GROUP BY 1, 2), i AS (SELECT code, year, lag(ic) OVER (PARTITION BY code ORDER BY year) AS a, ic AS b FROM h WHERE n >= 3),
  j AS (SELECT *, a IS NOT NULL AND a <> 0 AND abs(b) >= 0.005 AND sign(a) <> sign(b) AS flip FROM i), s AS (SELECT *, CASE WHEN coalesce(lag(flip) OVER (PARTITION BY code ORDER BY year), false) THEN 1 ELSE 0 END AS before FROM j),
  r AS (SELECT *, CASE WHEN b IS NULL THEN 'oos_missing' WHEN a IS NULL THEN 'in_sample_ic_missing' WHEN abs(b) < 0.005 THEN 'oos_ic_below_threshold' WHEN a = 0 THEN 'in_sample_ic_zero' WHEN NOT flip THEN 'sign_consistent' WHEN before + 1 >= 2 THEN 'consecutive_flip_streak_' || (before + 1) WHEN abs(b) >= 0.02 THEN 'severe_flip' ELSE 'flip' END AS reason FROM s)
  SELECT code, year::INT AS year, CASE WHEN reason = 'sign_consistent' THEN 'keep' WHEN reason IN ('oos_ic_below_threshold', 'severe_flip') OR reason LIKE 'consecutive%' THEN 'retire' ELSE 'downweight' END AS action, reason, flip,
    CASE WHEN reason = 'sign_consistent' THEN 1.0 WHEN reason IN ('oos_ic_below_threshold', 'severe_flip') OR reason LIKE 'consecutive%' THEN 0.0 ELSE 0.5 END::DOUBLE AS multiplier FROM r""")
def de_out_of_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each code's coefficient of a year against that of the year before."""
    rows = _factors(spark, sf_dir).where("mom IS NOT NULL AND forward IS NOT NULL").groupBy("code", F.year("date").alias("year")).agg(F.try_divide(F.covar_pop("mom", "forward"), F.stddev_pop("mom") * F.stddev_pop("forward")).alias("b"), F.count("*").alias("n"))
    w = ordered("code", "year")
    rows = rows.where("n >= 3").withColumn("a", F.lag("b").over(w))
    flip = F.coalesce((F.col("a") != 0) & (F.abs("b") >= 0.005) & (F.signum("a") != F.signum("b")), F.lit(False))
    rows = rows.withColumn("f", flip).withColumn("before", F.coalesce(F.lag("f").over(w), F.lit(False)).cast("int"))
    return de.out_of_sample_rule(rows, "a", "b", "before").select("code", "year", "action", "reason", "flip", "multiplier")


_SEASONS = [("new_year_festival", "(month(date) = 1 AND day(date) >= 25) OR (month(date) = 2 AND day(date) <= 20)", "1", False), ("march_sessions", "month(date) = 3 AND day(date) BETWEEN 1 AND 14", "1", True), ("annual_reports", "month(date) = 4 AND day(date) BETWEEN 11 AND 30", "NULL", False), ("third_quarter_reports", "month(date) = 10 AND day(date) BETWEEN 1 AND 31", "NULL", False)]


@query(f"""WITH {PANEL}, daily AS (SELECT date, avg(volume) AS v FROM panel GROUP BY date),
  m AS ({' UNION ALL '.join(f"SELECT '{n}' AS season, {d}::INT AS direction, year(date) AS year, v, {t} AS inside, {'true' if whole else f'NOT ({t})'} AS base FROM daily" for n, t, d, whole in _SEASONS)}),
  y AS (SELECT season, any_value(direction) AS direction, year, avg(v) FILTER (WHERE inside) AS w, avg(v) FILTER (WHERE base) AS b FROM m GROUP BY season, year), g AS (SELECT season, any_value(direction) AS direction, count(*) FILTER (WHERE w IS NOT NULL AND b IS NOT NULL) AS years, avg((w > b)::INT) AS win_rate FROM y GROUP BY season),
  p AS (SELECT season, count(*) FILTER (WHERE inside) AS days, avg(v) FILTER (WHERE inside) AS mean, avg(v) FILTER (WHERE base) AS base FROM m GROUP BY season), d AS (SELECT *, (mean - base) / base AS difference FROM g JOIN p USING (season))
  SELECT season, years, days, round(mean, 6) AS mean, round(base, 6) AS base, round(difference, 6) AS difference, round(win_rate, 6) AS win_rate, coalesce(abs(difference) >= 0.2, false) AS significant,
    CASE WHEN years < 3 OR difference IS NULL THEN 'too_few_years' WHEN win_rate >= 0.6 AND abs(difference) >= 0.2 AND (direction IS NULL OR difference * direction >= 0) THEN 'supported' ELSE 'unsupported' END AS verdict, round(least(greatest(1 + difference, 0.8), 1.2), 2) AS multiplier FROM d""")
def de_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = price_panel(spark, sf_dir).groupBy("date").agg(F.avg("volume").alias("v"))
    return rounded(de.season_effects(daily, "v"))


@query(f"""WITH {_F}, d AS (SELECT date, avg(mom) AS f, avg(forward) AS r FROM fp GROUP BY date), e AS (SELECT date, CASE WHEN f IS NOT NULL AND r IS NOT NULL THEN f END AS f, CASE WHEN f IS NOT NULL AND r IS NOT NULL THEN r END AS r FROM d)
  SELECT date, CASE WHEN count(f) OVER w >= 30 THEN round(corr(f, r) OVER w, 6) END AS timing FROM e WINDOW w AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def de_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(de.timing_correlation(_factors(spark, sf_dir), "mom", "forward"))


@query(f"WITH {PANEL} SELECT code::VARCHAR AS code, date, round(CASE WHEN date > DATE '1997-12-31' THEN close + 1 ELSE close END + 1e-9, 6) AS close, CASE WHEN date > DATE '1997-12-31' THEN NULL ELSE volume END AS volume FROM panel")
def rel_mixed_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as Parquet, its later years again as a CSV with other headers, whose rows replace those with their keys."""
    panel = stored(price_panel(spark, sf_dir).select("code", "date", "close", "volume"), "panel")
    table, text = new_path(spark, "table"), f"{new_path(spark, 'text')}.csv"
    panel.write.parquet(table)
    fs.write_csv(panel.where("date > DATE'1997-12-31'").select(F.col("code").alias("symbol"), F.col("date").alias("day"), (F.col("close") + 1).alias("last price")), text)
    rows = fs.load_panel(spark, [table, text], {"code": ("symbol",), "date": ("day",), "close": ("last price",)})
    return rows.select("code", "date", F.round(F.col("close") + 1e-9, 6).alias("close"), "volume")


@query("SELECT event_id, user_id, round(value, 6) AS value, event_type FROM events")
def rel_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as CSV, read under other names, written as JSON and read again."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("User"), "value", "event_type")
    text, lines = new_path(spark, "csv"), new_path(spark, "json")
    fs.write_csv(events, text)
    fs.write_json(fs.read_csv(spark, text, {"event_id": ("id",), "user_id": ("uid", "User"), "value": (), "event_type": ()}, {"event_id": "bigint", "user_id": "bigint", "event_type": "string"}), lines)
    return rounded(spark.read.schema("event_id bigint, user_id bigint, value double, event_type string").json(lines))
