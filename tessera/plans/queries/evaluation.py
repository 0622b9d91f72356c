"""Factor evaluation on the weekly price panel: trailing momentum and volume against later returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expr import ordered, pct_change
from tessera.operators import evaluation as ev
from tessera.operators.timeseries import forward_return
from tessera.plans.panel import PANEL, price_panel
from tessera.plans.registry import query, rounded


def factor_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum over four rows, volume, and the return over the next four rows with the date it is known on."""
    w = ordered("code", "date")
    rows = price_panel(spark, sf_dir).withColumn("mom", pct_change("close", w, 4)).withColumn("ret", pct_change("close", w))
    return forward_return(rows, 4)


_FACTORS = f"""{PANEL}, fp AS (SELECT *, close / nullif(lag(close, 4) OVER w, 0) - 1 AS mom, close / nullif(lag(close) OVER w, 0) - 1 AS ret,
  lead(close, 4) OVER w / nullif(close, 0) - 1 AS forward, lead(date, 4) OVER w AS known_on FROM panel WINDOW w AS (PARTITION BY code ORDER BY date))"""


def _rank(x: str, group: str) -> str:
    return f"(rank() OVER (PARTITION BY {group} ORDER BY {x}) + (count(*) OVER (PARTITION BY {group}, {x}) - 1) / 2.0)::DOUBLE"


_IC = f"""{_FACTORS}, rk AS (SELECT date, {_rank('mom', 'date')} AS f, {_rank('forward', 'date')} AS l FROM fp WHERE mom IS NOT NULL AND forward IS NOT NULL),
  ic AS (SELECT date, corr(f, l) AS ic, count(*) AS n FROM rk GROUP BY date HAVING count(*) >= 30)"""
_BUCKETS = f"""{_FACTORS}, bk AS (SELECT date, forward, known_on, floor(least({_rank('mom', 'date')} / count(*) OVER (PARTITION BY date), 0.999999) * {{q}})::BIGINT AS bucket FROM fp WHERE mom IS NOT NULL AND forward IS NOT NULL),
  qm AS (SELECT date, bucket, avg(forward) AS mean, count(*) AS n, max(known_on) AS realized FROM bk GROUP BY 1, 2)"""


@query(f"WITH {_IC} SELECT date, round(ic, 6) AS ic, n FROM ic")
def ev_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.rank_ic(factor_panel(spark, sf_dir), "mom", "forward"))


@query(f"WITH {_FACTORS} SELECT date, round(corr(mom, forward), 6) AS ic, count(*) AS n FROM fp WHERE mom IS NOT NULL AND forward IS NOT NULL GROUP BY date HAVING count(*) >= 30")
def ev_pearson_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.pearson_ic(factor_panel(spark, sf_dir), "mom", "forward"))


@query(f"""WITH {_IC}, s AS (SELECT avg(ic) AS mean, stddev_samp(ic) AS std, count(*) AS n, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM ic WHERE ic IS NOT NULL AND NOT isnan(ic))
  SELECT round(mean, 6) AS mean, round(std, 6) AS std, n, round(win_rate, 6) AS win_rate, round(mean / nullif(std, 0), 6) AS ir, CASE WHEN n >= 5 THEN round(mean / nullif(std, 0) * sqrt(252.0::DOUBLE), 6) ELSE 0.0 END AS ir_annual, round(mean / nullif(std, 0) * sqrt(n), 6) AS t FROM s""")
def ev_ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.ic_summary(ev.rank_ic(factor_panel(spark, sf_dir), "mom", "forward")))


@query(f"""WITH {_IC}, r AS (SELECT date, ic, n, count(ic) OVER w AS c, avg(ic) OVER w AS m, stddev_samp(ic) OVER w AS s FROM ic WINDOW w AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
  SELECT date, CASE WHEN c >= 30 THEN round(m, 6) END AS rolling_mean, CASE WHEN c >= 30 THEN round(m / nullif(s, 0) * sqrt(c), 6) END AS rolling_t FROM r""")
def ev_rolling_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.rolling_ic(ev.rank_ic(factor_panel(spark, sf_dir), "mom", "forward")).select("date", "rolling_mean", "rolling_t"))


@query(f"WITH {_BUCKETS.format(q=5)} SELECT date, bucket, round(mean, 6) AS mean, n FROM qm")
def ev_quantile_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.quantile_returns(factor_panel(spark, sf_dir), "mom", "forward"))


@query(f"WITH {_BUCKETS.format(q=5)} SELECT date, round(max(CASE WHEN bucket = 4 THEN mean END) - max(CASE WHEN bucket = 0 THEN mean END), 6) AS spread FROM qm GROUP BY date")
def ev_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.spread(factor_panel(spark, sf_dir), "mom", "forward"))


@query(f"""WITH {_FACTORS}, ah AS (SELECT code, date, mom, k AS lag, lead(ret, k) OVER (PARTITION BY code, k ORDER BY date) AS later FROM fp, (VALUES (1), (2), (3), (4)) t(k)),
  rk AS (SELECT date, lag, {_rank('mom', 'lag, date')} AS f, {_rank('later', 'lag, date')} AS l FROM ah WHERE mom IS NOT NULL AND later IS NOT NULL), ic AS (SELECT lag, date, corr(f, l) AS ic FROM rk GROUP BY 1, 2 HAVING count(*) >= 30)
  SELECT lag, round(avg(ic), 6) AS mean_ic, count(*) AS n FROM ic GROUP BY lag""")
def ev_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.decay(factor_panel(spark, sf_dir), "mom", "ret", 4))


@query(f"""WITH {_FACTORS}, t AS (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM (SELECT DISTINCT date FROM fp)),
  r AS (SELECT code, date, {_rank('mom', 'date')} / count(*) OVER (PARTITION BY date) > 0.8 AS top FROM fp WHERE mom IS NOT NULL)
  SELECT a.date, round(1 - avg(CASE WHEN b.top THEN 1.0 ELSE 0.0 END), 6) AS turnover, count(*) AS n FROM r a JOIN t ON a.date = t.date JOIN r b ON b.code = a.code AND b.date = t.before WHERE a.top GROUP BY a.date""")
def ev_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.turnover(factor_panel(spark, sf_dir), "mom"))


@query(f"""WITH {_FACTORS}, r AS (SELECT date, {_rank('close', 'date')} AS a, {_rank('volume', 'date')} AS b, {_rank('amount', 'date')} AS c FROM fp),
  e AS (SELECT date, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM r GROUP BY date), u AS (SELECT 'close' AS a, 'volume' AS b, ab AS rho FROM e UNION ALL SELECT 'close', 'amount', ac FROM e UNION ALL SELECT 'volume', 'amount', bc FROM e)
  SELECT a, b, round(avg(rho), 6) AS rho, count(*) AS times FROM u WHERE rho IS NOT NULL AND NOT isnan(rho) GROUP BY 1, 2 HAVING count(*) >= 20""")
def ev_factor_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.factor_correlation(factor_panel(spark, sf_dir), ["close", "volume", "amount"]))


@query(f"""WITH {_FACTORS}, c AS (SELECT 'mom' AS factor, date, count(mom) AS n FROM fp GROUP BY date UNION ALL SELECT 'forward', date, count(forward) FROM fp GROUP BY date)
  SELECT factor, count(*) FILTER (WHERE n >= 5) AS usable, median(n) AS median_n, min(n) AS min_n, count(*) AS times, CASE WHEN count(*) FILTER (WHERE n >= 5) >= count(*) * 0.8 THEN 'PASS' ELSE 'BLOCK' END AS status FROM c GROUP BY factor""")
def ev_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.coverage(factor_panel(spark, sf_dir), ["mom", "forward"])


@query(f"""WITH {_BUCKETS.format(q=5)}, p AS (SELECT date, percent_rank() OVER (ORDER BY date) AS p FROM (SELECT DISTINCT date FROM qm)),
  m AS (SELECT CASE WHEN p < 0.7 THEN 'in' ELSE 'out' END AS part, bucket, avg(mean) AS mean FROM qm JOIN p USING (date) GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY part ORDER BY mean)::DOUBLE AS r FROM m)
  SELECT part, round(corr(r, bucket::DOUBLE), 6) AS monotonicity, round(max(CASE WHEN bucket = 4 THEN mean END), 6) AS top, round(max(CASE WHEN bucket = 0 THEN mean END), 6) AS bottom FROM r GROUP BY part""")
def ev_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.holdout_diagnostics(factor_panel(spark, sf_dir), "mom", "forward"))


@query(f"""WITH {_BUCKETS.format(q=10)}, k AS (SELECT realized, bucket, avg(mean) AS m FROM qm GROUP BY 1, 2)
  SELECT realized, bucket, CASE WHEN count(m) OVER w >= 20 THEN round(avg(m) OVER w, 6) END AS expected FROM k WINDOW w AS (PARTITION BY bucket ORDER BY realized ROWS UNBOUNDED PRECEDING)""")
def ev_trailing_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.trailing_calibration(factor_panel(spark, sf_dir), "mom", "forward", "known_on"))


@query(f"""WITH {_FACTORS}, g AS (SELECT date, forward AS y, mom AS x, count(*) OVER (PARTITION BY date) AS n FROM fp WHERE forward IS NOT NULL AND mom IS NOT NULL),
  p AS (SELECT date, 'const' AS factor, regr_intercept(y, x) AS premium, count(*) AS n FROM g WHERE n >= 10 GROUP BY date UNION ALL SELECT date, 'mom', regr_slope(y, x), count(*) FROM g WHERE n >= 10 GROUP BY date)
  SELECT date, factor, round(premium, 5) AS premium, n FROM p""")
def ev_fama_macbeth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.fama_macbeth(factor_panel(spark, sf_dir), "forward", ["mom"]), 5)


@query(f"""WITH {_FACTORS}, g AS (SELECT date, forward AS y, mom AS a, ln(amount) AS b FROM fp WHERE forward IS NOT NULL AND mom IS NOT NULL AND amount IS NOT NULL),
  m AS (SELECT date, avg(y) AS y, avg(a) AS a, avg(b) AS b, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(a, b) AS ab, var_pop(a) AS aa, var_pop(b) AS bb FROM g GROUP BY date HAVING count(*) >= 10),
  c AS (SELECT *, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS ca, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS cb FROM m),
  p AS (SELECT date, 'const' AS factor, y - ca * a - cb * b AS premium FROM c UNION ALL SELECT date, 'mom', ca FROM c UNION ALL SELECT date, 'size', cb FROM c),
  e AS (SELECT factor, premium, premium - avg(premium) OVER f AS e, count(*) OVER f AS n, floor(4 * pow(count(*) OVER f / 100.0::DOUBLE, 2 / 9.0::DOUBLE)) AS depth, row_number() OVER (PARTITION BY factor ORDER BY date) AS k FROM p WINDOW f AS (PARTITION BY factor)),
  o AS (SELECT x.factor, sum(x.e * y.e * CASE WHEN x.k = y.k THEN 1 ELSE 2 * (1 - (y.k - x.k) / (x.depth + 1)) END) AS omega FROM e x JOIN e y ON x.factor = y.factor AND y.k BETWEEN x.k AND x.k + x.depth GROUP BY 1)
  SELECT factor, round(avg(premium), 5) AS mean, count(*) AS n, round(avg(premium) / sqrt(greatest(any_value(omega) / pow(count(*), 2), 1e-12::DOUBLE)), 5) AS t FROM e JOIN o USING (factor) GROUP BY factor""")
def ev_fama_macbeth_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = factor_panel(spark, sf_dir).withColumn("size", F.log("amount"))
    return rounded(ev.premium_summary(ev.fama_macbeth(rows, "forward", ["mom", "size"])), 5)


@query(f"""WITH {_FACTORS}, s AS (SELECT industry, count(*) AS n, corr(mom, forward) AS ic, avg(mom) / nullif(stddev_samp(mom), 0) AS icir, avg(CASE WHEN forward > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, (industry % 10) / 20.0 AS psi
  FROM fp WHERE mom IS NOT NULL AND forward IS NOT NULL GROUP BY industry)
  SELECT industry, CASE WHEN psi > 0.4 THEN 'inactive' WHEN n < 30 THEN 'inactive' WHEN ic IS NULL OR icir IS NULL THEN 'inactive' WHEN abs(ic) < 0.02 AND icir < 0.3 THEN 'weak' WHEN win_rate < 0.55 OR psi > 0.25 THEN 'watch' ELSE 'active' END AS status FROM s""")
def ev_four_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = factor_panel(spark, sf_dir).where("mom is not null and forward is not null")
    stats = rows.groupBy("industry").agg(F.count("*").alias("n"), F.corr("mom", "forward").alias("ic"), (F.avg("mom") / F.stddev_samp("mom")).alias("icir"), F.avg((F.col("forward") > 0).cast("double")).alias("win_rate"))
    return ev.four_gates(stats.withColumn("psi", (F.col("industry") % 10) / 20.0)).select("industry", "status")


@query(f"""WITH {_FACTORS}, d AS (SELECT date, count(*) AS n, covar_pop(forward, mom) / nullif(stddev_samp(mom), 0) AS spread FROM fp WHERE mom IS NOT NULL AND forward IS NOT NULL GROUP BY date HAVING count(*) >= 20)
  SELECT date, round(spread, 6) AS spread, CASE WHEN count(spread) OVER w >= 6 THEN round(stddev_samp(spread) OVER w, 6) END AS volatility FROM d WHERE spread IS NOT NULL WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def ev_factor_return_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.factor_return_volatility(factor_panel(spark, sf_dir), "mom", "forward", 12))


@query(f"""WITH {_FACTORS}, r AS (SELECT code, date, mom FROM fp WHERE mom IS NOT NULL), d AS (SELECT date, count(*) AS n, quantile_cont(mom, 0.8) AS t, quantile_cont(mom, 0.2) AS b FROM r GROUP BY date),
  e AS (SELECT *, lag(CASE WHEN n >= 15 THEN date END) OVER (ORDER BY date) AS before FROM d), l AS (SELECT code, date, before, 'long' AS leg FROM r JOIN e USING (date) WHERE n >= 15 AND mom >= t UNION ALL SELECT code, date, before, 'short' FROM r JOIN e USING (date) WHERE n >= 15 AND mom <= b),
  s AS (SELECT date, before, leg, count(*) AS n FROM l GROUP BY ALL), m AS (SELECT a.date, a.leg, count(*) AS same FROM l a JOIN l b ON a.code = b.code AND a.leg = b.leg AND a.before = b.date GROUP BY ALL)
  SELECT s.date, round(avg((s.n + p.n - 2 * coalesce(same, 0))::DOUBLE / s.n), 6) AS turnover FROM s JOIN s p ON p.date = s.before AND p.leg = s.leg LEFT JOIN m ON m.date = s.date AND m.leg = s.leg GROUP BY s.date""")
def ev_long_short_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.long_short_turnover(factor_panel(spark, sf_dir), "mom"))


@query(f"""WITH {_FACTORS}, c AS (SELECT corr(volume, amount) AS a, corr(volume, mom) AS b, corr(volume, close) AS c, corr(amount, mom) AS d, corr(amount, close) AS e, corr(mom, close) AS f FROM fp),
  r AS (SELECT (a + b + c + d + e + f) / 6 AS m, ((abs(a) > 0.7)::INT + (abs(b) > 0.7)::INT + (abs(c) > 0.7)::INT + (abs(d) > 0.7)::INT + (abs(e) > 0.7)::INT + (abs(f) > 0.7)::INT)::BIGINT AS n FROM c)
  SELECT round(m, 6) AS avg_correlation, n AS n_high_pairs, CASE WHEN m > 0.7 THEN 'high' WHEN m > 0.4 THEN 'medium' ELSE 'low' END AS level FROM r""")
def ev_crowding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.crowding(factor_panel(spark, sf_dir), ["volume", "amount", "mom", "close"]))


_LONG_IC = f"""{_FACTORS}, lg AS (SELECT 'mom' AS factor, code, date, mom AS value, forward FROM fp UNION ALL SELECT 'ret', code, date, ret, forward FROM fp),
  lr AS (SELECT factor, date, {_rank('value', 'factor, date')} AS f, {_rank('forward', 'factor, date')} AS l FROM lg WHERE value IS NOT NULL AND forward IS NOT NULL),
  li AS (SELECT factor, date, corr(f, l) AS ic FROM lr GROUP BY 1, 2 HAVING count(*) >= 30), fd AS (SELECT *, pow(0.5::DOUBLE, (row_number() OVER (PARTITION BY factor ORDER BY date DESC) - 1) / 20.0::DOUBLE) AS fade FROM li),
  sc AS (SELECT factor, greatest(avg(ic) / greatest(stddev_samp(ic), 1e-12::DOUBLE), 0) AS icir, abs(avg(ic)) AS ic, greatest(sum(coalesce(ic, 0) * fade) / sum(fade), 0) AS decay FROM fd GROUP BY 1),
  sl AS (SELECT 'icir' AS how, factor, icir AS s FROM sc UNION ALL SELECT 'ic', factor, ic FROM sc UNION ALL SELECT 'decay', factor, decay FROM sc),
  wt AS (SELECT how, factor, CASE WHEN sum(s) OVER (PARTITION BY how) > 0 THEN s / sum(s) OVER (PARTITION BY how) ELSE 1.0::DOUBLE / count(*) OVER (PARTITION BY how) END AS weight FROM sl)"""


def _coefficients(panel: DataFrame) -> DataFrame:
    rows = panel.select("date", "forward", "mom", "ret").unpivot(["date", "forward"], ["mom", "ret"], "factor", "value")
    return ev.rank_ic(rows, "value", "forward", by=("factor",))


@query(f"WITH {_LONG_IC} SELECT how, factor, round(weight, 6) AS weight FROM wt")
def ev_factor_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    ic = _coefficients(factor_panel(spark, sf_dir))
    each = [ev.factor_weights(ic, how).select(F.lit(how).alias("how"), "factor", "weight") for how in ("icir", "ic", "decay")]
    return rounded(each[0].unionAll(each[1]).unionAll(each[2]))


def _score(x: str) -> str:
    own = f"({x} - avg({x}) OVER d) / nullif(stddev_samp({x}) OVER d, 0)"
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(least(coalesce({own}, 0), 5), -5) END"


@query(f"""WITH {_LONG_IC}, z AS (SELECT code, date, {_score("mom")} AS zm, {_score("ret")} AS zr FROM fp WINDOW d AS (PARTITION BY date))
  SELECT code, date, round(zm * coalesce((SELECT weight FROM wt WHERE how = 'ic' AND factor = 'mom'), 0) + zr * coalesce((SELECT weight FROM wt WHERE how = 'ic' AND factor = 'ret'), 0), 6) AS score FROM z""")
def ev_combined_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = factor_panel(spark, sf_dir)
    return rounded(ev.combined(panel, ["mom", "ret"], ev.factor_weights(_coefficients(panel), "ic")))
