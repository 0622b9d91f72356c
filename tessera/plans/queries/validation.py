"""Labels, folds, walk-forward choice and forests on the weekly panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from tessera.functions import factors as fz
from tessera.functions.expr import ordered, pct_change, rolling
from tessera.operators import trees as tr
from tessera.operators import validation as va
from tessera.plans.panel import PANEL, price_panel
from tessera.plans.registry import query, rounded
from tessera.sources.scratch import stored

GRID = [{"fast": f, "slow": s} for f in (3, 6) for s in (12, 24)]


@query(f"""WITH {PANEL}, f AS (SELECT code, date, (lead(close, 4) OVER (PARTITION BY code ORDER BY date) / nullif(close, 0) - 1) * 100 AS r FROM panel)
  SELECT code, date, CASE WHEN r > 5 THEN 2 WHEN r < -5 THEN 0 WHEN r IS NOT NULL THEN 1 END AS label FROM f""")
def vl_three_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.three_classes(price_panel(spark, sf_dir), 4, 5.0, -5.0).select("code", "date", "label")


@query(f"""WITH {PANEL}, p AS (SELECT code, date, close, high, low, row_number() OVER (PARTITION BY code ORDER BY date) AS k, count(*) OVER (PARTITION BY code) AS n FROM panel),
  h AS (SELECT a.code, a.k, min(b.k - a.k) AS held, arg_min(CASE WHEN b.low <= a.close * 0.85 THEN -1 ELSE 1 END, b.k) AS side FROM p a JOIN p b ON b.code = a.code AND b.k BETWEEN a.k + 1 AND a.k + 8 AND (b.low <= a.close * 0.85 OR b.high >= a.close * 1.15) GROUP BY 1, 2)
  SELECT p.code, p.date, coalesce(h.side, CASE WHEN p.k + 8 <= p.n THEN 0 END)::INT AS barrier, coalesce(h.held, CASE WHEN p.k + 8 <= p.n THEN 8 END)::INT AS held FROM p LEFT JOIN h USING (code, k)""")
def vl_first_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = va.first_touch(price_panel(spark, sf_dir), 0.15, 0.15, 8)
    return rows.select("code", "date", F.col("barrier").cast("int").alias("barrier"), F.col("held").cast("int").alias("held"))


@query(f"""WITH {PANEL}, t AS (SELECT date, row_number() OVER (ORDER BY date) AS place, ntile(5) OVER (ORDER BY date) AS block FROM (SELECT DISTINCT date FROM panel)), s AS (SELECT block, min(place) AS lo, max(place) AS hi FROM t GROUP BY 1),
  c AS (SELECT row_number() OVER (ORDER BY a.block, b.block) - 1 AS combo, a.block AS a, b.block AS b, a.lo AS al, a.hi AS ah, b.lo AS bl, b.hi AS bh FROM s a JOIN s b ON a.block < b.block),
  x AS (SELECT combo, date, CASE WHEN block IN (a, b) THEN 'test' WHEN NOT (place BETWEEN al - 4 AND ah + 2 OR place BETWEEN bl - 4 AND bh + 2) THEN 'train' END AS part, block FROM t, c)
  SELECT combo::INT AS combo, date, part, block::INT AS block FROM x WHERE part IS NOT NULL""")
def vl_combinatorial_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.combinatorial_folds(price_panel(spark, sf_dir), 5, 2, 4, 2)


def crossing(w: WindowSpec, parameters: dict) -> Column:
    """In the market while the fast mean is above the slow one."""
    return F.when(rolling("close", "mean", w, parameters["fast"]) > rolling("close", "mean", w, parameters["slow"]), 1.0).otherwise(0.0)


def _mean(n: int) -> str:
    return f"CASE WHEN count(close) OVER (v ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {n} THEN avg(close) OVER (v ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"


_WALK = f"""{PANEL}, p AS (SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY date) - 1 AS k, count(*) OVER (PARTITION BY code) AS n FROM panel),
  x AS (SELECT code, date, close, s.w AS win, k - s.w * 26 AS off FROM p, range(0, 40) s(w) WHERE s.w * 26 + 134 <= n AND k - s.w * 26 BETWEEN 0 AND 133),
  y AS (SELECT *, CASE WHEN off < 104 THEN 'train' WHEN off >= 108 THEN 'test' END AS part FROM x),
  m AS (SELECT *, coalesce(close / nullif(lag(close) OVER v, 0) - 1, 0) AS move, {', '.join(f'{_mean(n)} AS m{n}' for n in (3, 6, 12, 24))} FROM y WHERE part IS NOT NULL WINDOW v AS (PARTITION BY code, win, part ORDER BY date)),
  q AS (SELECT code, date, win, part, off, move, unnest([{', '.join(f"CASE WHEN m{g['fast']} > m{g['slow']} THEN 1.0 ELSE 0.0 END" for g in GRID)}]) AS pos, unnest([0, 1, 2, 3]) AS g FROM m),
  h AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY code, win, part, g ORDER BY date), 0) AS held FROM q),
  r AS (SELECT *, held * move - abs(held - coalesce(lag(held) OVER (PARTITION BY code, win, part, g ORDER BY date), 0)) * 0.0015 AS ret FROM h),
  s AS (SELECT code, win, g, CASE WHEN stddev_samp(ret) * sqrt(52.0) >= 1e-12 THEN avg(ret) * 52 / (stddev_samp(ret) * sqrt(52.0)) ELSE 0 END AS score FROM r WHERE part = 'train' AND 103 - off >= 4 GROUP BY 1, 2, 3),
  b AS (SELECT code, win, arg_max(g, (score, -g)) AS choice, max(score) AS score FROM s GROUP BY 1, 2)"""


def _walk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return va.walk_forward(price_panel(spark, sf_dir), crossing, GRID, 104, 26, 26, 4, periods=52.0)


@query(f"WITH {_WALK} SELECT code, win::BIGINT AS win, choice::INT AS choice, round(score, 6) AS score FROM b")
def vl_walk_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, _ = _walk(spark, sf_dir)
    return rounded(chosen.withColumnRenamed("window", "win"))


@query(f"WITH {_WALK} SELECT r.code, r.date, round(avg(r.ret), 6) AS ret FROM r JOIN b ON r.code = b.code AND r.win = b.win AND r.g = b.choice WHERE part = 'test' GROUP BY 1, 2")
def vl_walk_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_walk(spark, sf_dir)[1])


@query(f"""WITH {PANEL}, r AS (SELECT code, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS ret FROM panel), d AS (SELECT code, ret, ret - avg(ret) OVER (PARTITION BY code) AS d FROM r WHERE ret IS NOT NULL),
  m AS (SELECT code, count(*) AS n, avg(ret) / stddev_samp(ret) AS ratio, avg(d * d * d) / power(avg(d * d), 1.5) AS s, avg(d * d * d * d) / power(avg(d * d), 2) AS k FROM d GROUP BY code)
  SELECT code, n, round(ratio, 6) AS ratio, round((ratio - {va.expected_best(20)!r} / sqrt(n - 1)) / sqrt((1 - s * ratio + (k - 1) / 4 * ratio * ratio) / (n - 1)), 5) AS z FROM m""")
def vl_deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = price_panel(spark, sf_dir).withColumn("ret", pct_change("close", ordered("code", "date")))
    out = va.deflated_sharpe(rows, 20)
    return out.select("code", "n", F.round("ratio", 6).alias("ratio"), F.round("z", 5).alias("z"))


@query()
def ml_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest fitted on the first two thirds of the dates, before a gap of the label's length, tells later rows' chance to rise."""
    names = ["mom_10", "ma_gap_10", "vol_10", "range_10"]
    panel = price_panel(spark, sf_dir)
    rows = va.three_classes(fz.with_factors(panel, names), 4, 0.0, 0.0).withColumn("rises", (F.col("label") == 2).cast("double"))
    rows = stored(rows.select("code", "date", *names, "rises").withColumn("id", F.xxhash64("code", "date")), "features")
    dates = rows.select(F.percentile_approx(F.unix_date("date"), [0.66], 1000)[0].alias("cut")).first()
    early = rows.where(F.unix_date("date") <= dates["cut"] - 28)
    forest = tr.fit(early, names, "rises", "id", trees=10, depth=3)
    return tr.predict(rows.where(F.unix_date("date") > dates["cut"]), forest).select("code", "date", F.round("prediction", 6).alias("prediction"))
