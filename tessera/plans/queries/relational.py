"""Scans, filters, aggregates, set operations, pivots, views and table maintenance on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.expr import parse_date, parse_number, zfill
from tessera.plans import rules, views
from tessera.plans.panel import PANEL, price_panel, table
from tessera.plans.registry import query, rounded
from tessera.sources import catalog as cat


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' AND event_type = 'click'")
def rel_scan_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cat.Catalog(spark, [cat.Dataset("events", f"{sf_dir}/events.parquet", ("event_id",), "ts")]).read("events", "2024-01-10")
    return rows.where((F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz")) & (F.col("event_type") == "click")).select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r <= 3")
def rel_latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.Catalog(spark, [cat.Dataset("events", f"{sf_dir}/events.parquet", ("user_id", "ts"), "ts")]).latest("events", 3).select("user_id", "event_id", "ts")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity::BIGINT)::BIGINT AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2""")
def rel_group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    out = rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("sum_qty"), F.sum("l_extendedprice").alias("sum_price"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n"))
    return out.withColumn("sum_price", F.round("sum_price", 2)).withColumn("avg_disc", F.round("avg_disc", 6))


@query("""SELECT n_name, r_name, count(DISTINCT o_orderkey) AS orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""")
def rel_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice"), "c_custkey")
    g = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return rounded(c.join(g, "c_nationkey").groupBy("n_name", "r_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.sum("o_totalprice").alias("total")), 2)


@query("SELECT DISTINCT c_nationkey AS k FROM customer INTERSECT SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 0")
def rel_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
def rel_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).exceptAll(table(spark, sf_dir, "supplier").where("s_acctbal > 8000").select("s_nationkey").distinct())


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def rel_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("o_orderpriority", *(F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in "FOP"))


@query("SELECT p_partkey, 'size' AS what, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def rel_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return rows.unpivot("p_partkey", ["size", "price"], "what", "v")


@query("SELECT r_name, n_name, count(*) AS n, grouping_id(r_name, n_name)::BIGINT AS level FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rel_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def rel_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def rel_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.keep_last(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 3 = 0")
def rel_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return cat.upsert(old, old.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@query("SELECT event_type, (count(*) + count(*) FILTER (WHERE user_id < 50))::BIGINT AS n FROM events GROUP BY 1")
def rel_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    count = lambda df: df.groupBy("event_type").agg(F.count("*").alias("n"))
    return cat.increment(count(events), count(events.where("user_id < 50")), ["event_type"], "n")


@query("""SELECT 'events' AS dataset, count(*) AS rows, max(CAST(ts AS DATE)) AS last, date_diff('day', max(CAST(ts AS DATE)), DATE '2024-02-05')::INT AS age_days, 'stale' AS status FROM events
  UNION ALL SELECT 'orders', count(*), max(CAST(o_orderdate AS DATE)), date_diff('day', max(CAST(o_orderdate AS DATE)), DATE '2024-02-05')::INT, 'fresh' FROM orders""")
def rel_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = [cat.Dataset("events", f"{sf_dir}/events.parquet", ("event_id",), "ts", 1), cat.Dataset("orders", f"{sf_dir}/orders.parquet", ("o_orderkey",), "o_orderdate", 10_000)]
    return cat.Catalog(spark, known).freshness("2024-02-05")


_LONG = f"""{PANEL}, long AS (SELECT 'close' AS factor, code AS symbol, date, close AS value FROM panel UNION ALL SELECT 'volume', code, date, volume FROM panel)"""


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_panel(spark, sf_dir).select(F.col("code").alias("symbol"), "date", "close", "volume").unpivot(["symbol", "date"], ["close", "volume"], "factor", "value")


@query(f"WITH {_LONG} SELECT factor, count(value) AS n, count(DISTINCT symbol) AS symbols, min(date) AS first, max(date) AS last, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, round(min(value), 7) AS low, round(max(value), 7) AS high FROM long GROUP BY factor")
def view_factor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.factor_summary(_long(spark, sf_dir))
    return rows.withColumns({c: F.round(c, n) for c, n in (("mean", 5), ("std", 5), ("low", 7), ("high", 7))})


@query(f"WITH {_LONG} SELECT factor, symbol, date, value FROM long l WHERE date = (SELECT max(date) FROM long m WHERE m.factor = l.factor)")
def view_latest_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.latest_factor(_long(spark, sf_dir)).select("factor", "symbol", "date", "value")


@query(f"WITH {_LONG} SELECT factor, symbol, date, value FROM long WHERE factor IN ('volume') AND value >= 100 AND symbol BETWEEN 3 AND 9 AND date < DATE '2000-01-01'")
def view_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    rows = _long(spark, sf_dir).select("factor", "symbol", "date", "value")
    return views.query_view(rows, {"factor": ["volume"], "value__gte": 100, "symbol__between": (3, 9), "date__lt": datetime.date(2000, 1, 1), "symbol": []})


@query("""WITH r AS (SELECT event_type AS strategy, value / 100.0 AS ret, (event_id % 10) / 20.0 AS bench FROM events)
  SELECT strategy, round(avg(ret), 6) AS mean_ret, round(sum(ret), 4) AS sum_ret, round(avg(bench), 6) AS mean_bench, round(sum(ret - bench), 4) AS excess FROM r GROUP BY 1""")
def view_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("strategy"), (F.col("value") / 100.0).alias("ret"), ((F.col("event_id") % 10) / 20.0).alias("bench"))
    return views.performance_view(rows).withColumns({"mean_ret": F.round("mean_ret", 6), "sum_ret": F.round("sum_ret", 4), "mean_bench": F.round("mean_bench", 6), "excess": F.round("excess", 4)}).select("strategy", "mean_ret", "sum_ret", "mean_bench", "excess")


@query("""SELECT o_orderkey, lpad(o_custkey::VARCHAR, 6, '0') AS code, strftime(o_orderdate, '%Y%m%d') AS stamp, CAST(o_orderdate AS DATE) AS parsed, (o_custkey * 1000)::DOUBLE AS amount, NULL::DOUBLE AS nothing FROM orders""")
def fn_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("stamp", F.date_format("o_orderdate", "yyyyMMdd")).withColumn("typed", F.format_number(F.col("o_custkey") * 1000, 0))
    return rows.select("o_orderkey", zfill("o_custkey", 6).alias("code"), "stamp", parse_date("stamp").alias("parsed"), parse_number("typed").alias("amount"), parse_number(F.lit("--")).alias("nothing"))


@query("""SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, substr(sha256(event_type || '|' || user_id), 1, 20) AS id, substr(md5(event_type), 1, 12) AS short FROM events""")
def fn_json_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.substring(F.sha2(F.concat_ws("|", "event_type", "user_id"), 256), 1, 20).alias("id"), F.substring(F.md5("event_type"), 1, 12).alias("short"))


@query("""SELECT p_partkey, upper(p_name) AS up, length(p_name) AS len, replace(p_name, ' ', '_') AS joined, split_part(p_name, ' ', 1) AS first, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, p_type LIKE '%O%' AS has, starts_with(p_name, 'p') AS starts FROM part""")
def fn_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper("p_name").alias("up"), F.length("p_name").cast("bigint").alias("len"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("joined"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"), F.col("p_type").like("%O%").alias("has"), F.startswith("p_name", F.lit("p")).alias("starts"),
    )


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, (isodow(o_orderdate) - 1)::INT AS wd, weekofyear(o_orderdate)::INT AS wk, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))::INT AS days FROM orders""")
def fn_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.weekday(d).alias("wd"), F.weekofyear(d).alias("wk"), F.to_date(F.date_trunc("quarter", d)).alias("q"), F.datediff(d, F.lit("1995-01-01").cast("date")).alias("days"))


@query("""WITH h AS (SELECT c_custkey, c_acctbal, c_nationkey, unnest([CASE WHEN c_acctbal < 0 AND c_nationkey % 2 = 0 THEN 'debt' END, CASE WHEN 9000 < c_acctbal AND c_acctbal <= 9500 THEN 'rich' END, CASE WHEN c_acctbal / nullif(c_nationkey, 0) > 3000 OR NOT c_nationkey < 24 THEN 'odd' END]) AS rule FROM customer)
  SELECT c_custkey, rule, count(*) OVER (PARTITION BY rule) AS hits, count(*) OVER (PARTITION BY rule) > 20 AS summary FROM h WHERE rule IS NOT NULL""")
def rule_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = {"debt": "c_acctbal < 0 and c_nationkey % 2 == 0", "rich": "9000 < c_acctbal <= 9500", "odd": "row.c_acctbal / row.c_nationkey > 3000 or not c_nationkey < 24"}
    return rules.evaluate(table(spark, sf_dir, "customer"), asked, 20).select("c_custkey", "rule", "hits", "summary")


@query("SELECT event_type, approx FROM (SELECT event_type, count(DISTINCT user_id) AS approx FROM events GROUP BY 1)")
def rel_nunique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("approx"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def rel_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS band, (c_acctbal < 0)::INT AS low_flag, greatest(least(c_acctbal, 9000), 0) AS held FROM customer")
def rel_cut_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.expr import clip

    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(b < 0, "low").when(b < 5000, "mid").otherwise("high").alias("band"), (b < 0).cast("int").alias("low_flag"), clip(b, 0.0, 9000.0).alias("held"))


@query("SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, (ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL)::INT AS new FROM events)) GROUP BY 1, 2) GROUP BY 1")
def rel_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    new = (before.isNull() | (F.col("ts") > before + F.expr("INTERVAL 6 HOURS"))).cast("int")
    rows = table(spark, sf_dir, "events").withColumn("new", new).withColumn("s", F.sum("new").over(w))
    return rows.groupBy("user_id", "s").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


_HISTORY = "SELECT event_type AS factor, CAST(ts AS DATE) AS date, value / 1000.0 AS rank_ic, (event_id % 7) / 10.0 AS icir, user_id AS n_stocks FROM events"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    ten = lambda x, y: x.cast("double") / F.lit(y)
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("factor"), F.to_date("ts").alias("date"), ten(F.col("value"), 1000.0).alias("rank_ic"), ten(F.col("event_id") % 7, 10.0).alias("icir"), F.col("user_id").alias("n_stocks"))


@query(f"SELECT factor, count(*) AS n_periods, min(date) AS first, max(date) AS last, round(avg(rank_ic), 6) AS avg_rank_ic, round(avg(icir::DOUBLE), 6) AS avg_icir, round(avg(n_stocks), 6) AS avg_n_stocks FROM ({_HISTORY}) GROUP BY 1")
def view_ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.ic_summary_view(_history(spark, sf_dir)))


@query("SELECT CAST(ts AS DATE) AS date, event_id, event_type AS trend FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)")
def view_regime_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.latest_rows(table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), "event_id", F.col("event_type").alias("trend")))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 AND c_mktsegment <> 'it''s ? \"x\"' GROUP BY 1")
def rel_sql_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"tessera_orders": table(spark, sf_dir, "orders"), "tessera_customer": table(spark, sf_dir, "customer")}
    text = "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM tessera_orders JOIN tessera_customer ON o_custkey = c_custkey WHERE o_totalprice > ? AND c_mktsegment <> ? GROUP BY 1"
    return views.select(spark, text, tables, [1000, "it's ? \"x\""])
