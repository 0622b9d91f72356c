"""Tests of the panel's series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expr import ordered, pct_change
from tessera.operators import inference as nf
from tessera.plans.panel import PANEL, price_panel
from tessera.plans.registry import query, rounded

_RETS = f"""{PANEL}, rets AS (SELECT code, date, close, volume, amount, close / nullif(lag(close) OVER w, 0) - 1 AS ret FROM panel WINDOW w AS (PARTITION BY code ORDER BY date)),
  x AS (SELECT *, avg(ret) OVER (PARTITION BY date) AS market, avg(close) OVER (PARTITION BY date) AS level FROM rets)"""
_LAGS = 10


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = price_panel(spark, sf_dir).withColumn("ret", pct_change("close", ordered("code", "date")))
    each = ordered("date", "code").rowsBetween(-(2**63), 2**63 - 1)
    return rows.select("code", "date", "close", "volume", "amount", "ret", F.avg("ret").over(each).alias("market"), F.avg("close").over(each).alias("level"))


@query(f"""WITH {_RETS}, d AS (SELECT code, ret - avg(ret) OVER (PARTITION BY code) AS d FROM x WHERE ret IS NOT NULL),
  m AS (SELECT code, count(*) AS n, avg(d * d * d) / power(avg(d * d), 1.5) AS s, avg(d * d * d * d) / power(avg(d * d), 2) - 3 AS k FROM d GROUP BY code)
  SELECT code, n, round(s, 6) AS skewness, round(k, 6) AS kurtosis, round(n / 6.0 * (s * s + k * k / 4), 4) AS statistic, round(exp(-n / 12.0 * (s * s + k * k / 4)), 6) AS p FROM m""")
def st_normality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nf.normality(_series(spark, sf_dir), "ret")
    return out.select("code", "n", F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"), F.round("statistic", 4).alias("statistic"), F.round("p", 6).alias("p"))


@query(f"""WITH {_RETS}, d AS (SELECT code, date, ret - avg(ret) OVER (PARTITION BY code) AS d FROM x WHERE ret IS NOT NULL),
  l AS (SELECT code, d, unnest([{', '.join(f'lag(d, {k}) OVER w' for k in range(1, _LAGS + 1))}]) AS y, unnest(range(1, {_LAGS + 1})) AS k FROM d WINDOW w AS (PARTITION BY code ORDER BY date)),
  v AS (SELECT code, count(*) AS n, sum(d * d) AS v FROM d GROUP BY code), r AS (SELECT code, k, sum(d * y) AS s FROM l GROUP BY 1, 2),
  q AS (SELECT code, any_value(n) AS n, any_value(n) * (any_value(n) + 2.0) * sum((s / v) * (s / v) / (n - k)) AS q FROM r JOIN v USING (code) WHERE n > {_LAGS} GROUP BY code)
  SELECT code, n, round(q, 5) AS statistic, round(exp(-q / 2) * (1 + q / 2 + power(q / 2, 2) / 2 + power(q / 2, 3) / 6 + power(q / 2, 4) / 24), 6) AS p FROM q""")
def st_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nf.autocorrelation(_series(spark, sf_dir), "ret", _LAGS)
    return out.select("code", "n", F.round("statistic", 5).alias("statistic"), F.round("p", 6).alias("p"))


def _adf(source: str, value: str) -> str:
    return f"""ch AS (SELECT code, date, {value} - lag({value}) OVER w AS dy, lag({value}) OVER w AS y1 FROM {source} WINDOW w AS (PARTITION BY code ORDER BY date)),
  lg AS (SELECT *, lag(dy) OVER (PARTITION BY code ORDER BY date) AS d1 FROM ch),
  ce AS (SELECT code, dy - avg(dy) OVER c AS y, y1 - avg(y1) OVER c AS a, d1 - avg(d1) OVER c AS b FROM lg WHERE d1 IS NOT NULL WINDOW c AS (PARTITION BY code)),
  mo AS (SELECT code, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS yb, sum(y * y) AS yy FROM ce GROUP BY code),
  co AS (SELECT *, aa * bb - ab * ab AS det, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS ba, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS bc FROM mo WHERE n > 3)"""


@query(f"WITH {_RETS}, {_adf('x', 'close')} SELECT code, n, round(ba / sqrt((yy - ba * ay - bc * yb) / (n - 3) * bb / det), 5) AS statistic FROM co")
def st_unit_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nf.unit_root(_series(spark, sf_dir), "close").select("code", "n", "statistic"), 5)


@query(f"""WITH {_RETS}, ab0 AS (SELECT code, regr_slope(close, level) AS slope, regr_intercept(close, level) AS c FROM x GROUP BY code), res AS (SELECT code, date, close - slope * level - c AS e, slope FROM x JOIN ab0 USING (code)), {_adf('res', 'e')}
  SELECT code, n, round(ba / sqrt((yy - ba * ay - bc * yb) / (n - 3) * bb / det), 5) AS statistic, round(slope, 5) AS slope FROM co JOIN ab0 USING (code)""")
def st_cointegration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nf.cointegration(_series(spark, sf_dir), "close", "level").select("code", "n", "statistic", "slope"), 5)


@query(f"""WITH {_RETS}, k AS (SELECT code, close AS y, row_number() OVER (PARTITION BY code ORDER BY date)::DOUBLE AS t, count(*) OVER (PARTITION BY code) AS n FROM x),
  h AS (SELECT *, t > n // 2 AS late FROM k WHERE n >= 30), part AS (SELECT code, n, late, regr_syy(y, t) - regr_sxy(y, t) * regr_sxy(y, t) / regr_sxx(y, t) AS rss FROM h GROUP BY 1, 2, 3),
  one AS (SELECT code, regr_syy(y, t) - regr_sxy(y, t) * regr_sxy(y, t) / regr_sxx(y, t) AS rss FROM h GROUP BY 1), f AS (SELECT code, any_value(n) AS n, (any_value(one.rss) - sum(part.rss)) / 2 / (sum(part.rss) / (any_value(n) - 4)) AS f FROM part JOIN one USING (code) GROUP BY code)
  SELECT code, n, round(f, 5) AS statistic, round(power(1 + 2 * greatest(f, 0) / (n - 4), -(n - 4) / 2.0), 6) AS p FROM f""")
def st_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nf.structural_break(_series(spark, sf_dir), "close")
    return out.select("code", "n", F.round("statistic", 5).alias("statistic"), F.round("p", 6).alias("p"))


@query(f"""WITH {_RETS}, c AS (SELECT year(date) AS year, corr(close, volume) AS ab, corr(close, amount) AS ac, corr(volume, amount) AS bc FROM x GROUP BY 1),
  v AS (SELECT year, unnest(['close', 'volume', 'amount']) AS factor, unnest([(ab * ab + ac * ac - 2 * ab * ac * bc) / (1 - bc * bc), (ab * ab + bc * bc - 2 * ab * ac * bc) / (1 - ac * ac), (ac * ac + bc * bc - 2 * ab * ac * bc) / (1 - ab * ab)]) AS r2 FROM c)
  SELECT year, factor, round(CASE WHEN r2 < 0.999 THEN 1 / (1 - r2) ELSE 999 END, 5) AS vif FROM v""")
def st_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _series(spark, sf_dir).withColumn("year", F.year("date").cast("bigint"))
    return rounded(nf.inflation(rows, ["close", "volume", "amount"], ["year"]), 5)


@query(f"""WITH {_RETS}, m AS (SELECT code, count(*) AS n, regr_slope(ret, market) AS b, avg(ret) AS my, avg(market) AS mx, regr_sxx(ret, market) AS sxx, regr_syy(ret, market) AS syy, regr_sxy(ret, market) AS sxy FROM x WHERE ret IS NOT NULL GROUP BY code HAVING count(*) > 2)
  SELECT code, n, round(my - b * mx, 6) AS alpha, round((my - b * mx) / sqrt((syy - b * sxy) / (n - 2) * (1.0 / n + mx * mx / sxx)), 5) AS t, round(b * sxy / syy, 6) AS r2 FROM m""")
def st_spanning(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nf.spanning(_series(spark, sf_dir), "ret", ["market"])
    return out.select("code", "n", F.round("alpha", 6).alias("alpha"), F.round("t", 5).alias("t"), F.round("r2", 6).alias("r2"))
