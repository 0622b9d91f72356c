"""Price limits on the weekly panel: locked and broken bars, streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import limitpool as lp
from tessera.plans.panel import PANEL, price_panel
from tessera.plans.registry import query, rounded

_POOL = f"""{PANEL}, prior AS (SELECT *, lag(close) OVER w AS p, row_number() OVER w AS k, (close / nullif(lag(close) OVER w, 0) - 1) * 100 AS pct0 FROM panel WINDOW w AS (PARTITION BY code ORDER BY date)),
  edges AS (SELECT *, coalesce(pct0, 0) AS pct, round_even(p * 1.1 * 100, 0) / 100 AS up, round_even(p * 0.9 * 100, 0) / 100 AS down FROM prior),
  flags AS (SELECT *, coalesce(close >= up - 1e-6 AND pct >= 9.7, false) AS locked_up, coalesce(close <= down + 1e-6 AND pct <= -9.7, false) AS locked_down,
    coalesce(high >= up - 1e-6 AND pct >= 8.0, false) AS touched, lead(pct) OVER (PARTITION BY code ORDER BY date) AS next_pct FROM edges),
  s AS (SELECT code, k, locked_up AS locked, locked_up::BIGINT AS streak FROM flags WHERE k = 1
    UNION ALL SELECT f.code, f.k, f.locked_up, CASE WHEN f.locked_up THEN CASE WHEN s.locked THEN s.streak + 1 ELSE 1 END ELSE s.streak END FROM s JOIN flags f ON f.code = s.code AND f.k = s.k + 1),
  pooled AS (SELECT f.*, touched AND NOT locked_up AS broken, s.streak FROM flags f JOIN s USING (code, k))"""


@query(f"""WITH RECURSIVE {_POOL} SELECT code, date, round(pct, 6) AS pct, locked_up, locked_down, broken, streak, round(next_pct, 6) AS next_pct FROM pooled WHERE locked_up OR locked_down OR broken""")
def lp_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lp.pool(price_panel(spark, sf_dir))
    return rounded(rows.select("code", "date", "pct", "locked_up", "locked_down", "broken", "streak", "next_pct"))


@query(f"""WITH RECURSIVE {_POOL} SELECT code, date, streak FROM pooled""")
def lp_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lp.limit_pool(price_panel(spark, sf_dir)).select("code", "date", "streak")


@query(f"""WITH RECURSIVE {_POOL} SELECT date, count(*) FILTER (WHERE locked_up) AS up, count(*) FILTER (WHERE locked_down) AS down, count(*) FILTER (WHERE broken) AS broken, max(CASE WHEN locked_up THEN streak END) AS longest,
  count(*) FILTER (WHERE locked_up AND streak = 1) AS streak_1, count(*) FILTER (WHERE locked_up AND streak = 2) AS streak_2, count(*) FILTER (WHERE locked_up AND streak = 3) AS streak_3, count(*) FILTER (WHERE locked_up AND streak >= 4) AS streak_4,
  round(count(*) FILTER (WHERE broken)::DOUBLE / nullif(count(*) FILTER (WHERE locked_up OR broken), 0), 6) AS broken_share FROM pooled WHERE locked_up OR locked_down OR broken GROUP BY date""")
def lp_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lp.pool_counts(lp.pool(price_panel(spark, sf_dir))))
