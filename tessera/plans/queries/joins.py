"""Joins beyond equality on events, shipments and the price panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expr import ordered, pct_change
from tessera.operators import joins as jn
from tessera.plans.panel import PANEL, price_panel, table
from tessera.plans.registry import query, rounded


def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind)


@query("""WITH p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
  SELECT c.user_id, c.event_id, c.ts, p.ts AS bought_in_force, p.value AS spent FROM (SELECT * FROM events WHERE event_type = 'click') c
  ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts""")
def join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    buys = _events(spark, sf_dir, "purchase").groupBy("user_id", F.col("ts").alias("bought")).agg(F.max("value").alias("spent"))
    return jn.as_of(_events(spark, sf_dir, "click").select("user_id", "event_id", "ts"), buys, "user_id", "ts", "bought", ["spent"])


@query("""WITH p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
  j AS (SELECT c.user_id, c.event_id, c.ts, p.ts AS b, p.value AS s FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts)
  SELECT user_id, event_id, CASE WHEN date_diff('day', b, ts) <= 2 THEN b END AS bought_in_force, CASE WHEN date_diff('day', b, ts) <= 2 THEN s END AS spent FROM j""")
def join_as_of_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    buys = _events(spark, sf_dir, "purchase").groupBy("user_id", F.col("ts").alias("bought")).agg(F.max("value").alias("spent"))
    rows = jn.as_of(_events(spark, sf_dir, "click").select("user_id", "event_id", "ts"), buys, "user_id", "ts", "bought", ["spent"], 2)
    return rows.select("user_id", "event_id", "bought_in_force", "spent")


@query("""WITH s AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS since, o_orderpriority AS grade, row_number() OVER (PARTITION BY o_custkey, date_trunc('week', o_orderdate) ORDER BY o_orderkey DESC) AS r, o_custkey AS code FROM orders),
  h AS (SELECT code, since, grade FROM s WHERE r = 1), q AS (SELECT DISTINCT c_custkey AS code, DATE '1998-01-05' + INTERVAL (100 * k) DAY AS d FROM customer, range(0, 8) t(k))
  SELECT q.code, CAST(q.d AS DATE) AS date, h.since AS since_in_force, h.grade FROM q ASOF LEFT JOIN h ON q.code = h.code AND CAST(q.d AS DATE) >= h.since""")
def join_effective_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("since", F.to_date(F.date_trunc("week", "o_orderdate")))
    history = orders.groupBy(F.col("o_custkey").alias("code"), "since").agg(F.max_by("o_orderpriority", "o_orderkey").alias("grade"))
    days = F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.date_add(F.lit("1998-01-05").cast("date"), k * 100)))
    probes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), days.alias("date"))
    return jn.as_of(probes, history, "code", "date", "since", ["grade"])


@query(f"""WITH {PANEL}, c AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM panel)),
  r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS announced FROM orders), f AS (SELECT r.*, (SELECT min(k) FROM c WHERE c.date >= r.announced) AS k FROM r)
  SELECT o_orderkey, announced, c.date AS available FROM f LEFT JOIN c ON c.k = f.k + 1""")
def join_available_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    releases = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("announced"))
    return jn.available_on(releases, price_panel(spark, sf_dir).select("date"), 1, "announced").select("o_orderkey", "announced", "available")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) ELSE last_day(CAST(o_orderdate AS DATE)) + CAST(CASE WHEN month(o_orderdate) = 12 THEN 150 ELSE 90 END AS INT) END AS anchor FROM orders""")
def join_report_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = orders.select("o_orderkey", F.last_day("o_orderdate").alias("period"), F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate")).alias("announced"))
    return jn.report_anchor(rows, "period", "announced").select("o_orderkey", "anchor")


@query("""WITH a AS (SELECT DISTINCT user_id % 20 AS m, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'error'), c AS (SELECT d, lead(d) OVER (ORDER BY d) AS nx FROM (SELECT DISTINCT d FROM a)),
  s AS (SELECT a.m, c.nx FROM a JOIN c USING (d) WHERE c.nx IS NOT NULL), n AS (SELECT count(*) AS days FROM c WHERE nx IS NOT NULL),
  sa AS (SELECT m AS src, count(*) AS samples FROM s GROUP BY m), b AS (SELECT a.m AS dst, count(*) AS dd FROM a JOIN c ON a.d = c.nx GROUP BY a.m),
  p AS (SELECT s.m AS src, a.m AS dst, count(*) AS t FROM s JOIN a ON a.d = s.nx AND a.m <> s.m GROUP BY 1, 2)
  SELECT src, dst, samples, round(t::DOUBLE / samples, 6) AS cond_prob, round(dd::DOUBLE / days, 6) AS base_prob, round((t::DOUBLE / samples) / (dd::DOUBLE / days), 6) AS lift FROM p JOIN sa USING (src) JOIN b USING (dst), n WHERE samples >= 5""")
def join_next_day_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = _events(spark, sf_dir, "error").select((F.col("user_id") % 20).alias("m"), F.to_date("ts").alias("d"))
    return rounded(jn.next_day_pairs(active, "m", "d"))


@query("""WITH r AS (SELECT DISTINCT p_brand AS g, l_suppkey AS m FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45), z AS (SELECT g, count(*) AS n FROM r GROUP BY g),
  s AS (SELECT a.g AS a, b.g AS b, count(*) AS shared FROM r a JOIN r b ON a.m = b.m AND a.g < b.g GROUP BY 1, 2)
  SELECT a, b, shared, round(shared::DOUBLE / (x.n + y.n - shared), 6) AS jaccard FROM s JOIN z x ON x.g = a JOIN z y ON y.g = b""")
def join_group_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey", "l_suppkey")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return rounded(jn.overlap(line.join(part, "l_partkey"), "p_brand", "l_suppkey"))


_FIFO = """WITH t AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'signup' THEN 'buy' ELSE 'sell' END AS side, 1 + event_id % 7 AS q, value AS price FROM events WHERE event_type IN ('signup', 'purchase')),
  c AS (SELECT *, sum(q) OVER w AS t, sum(q) OVER w - q AS f, row_number() OVER w AS r FROM t WINDOW w AS (PARTITION BY user_id, side ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
  SELECT b.user_id, b.r AS buy_no, s.r AS sell_no, (least(b.t, s.t) - greatest(b.f, s.f))::BIGINT AS quantity, round((least(b.t, s.t) - greatest(b.f, s.f)) * (s.price - b.price), 6) AS profit
  FROM c b JOIN c s ON b.user_id = s.user_id AND b.side = 'buy' AND s.side = 'sell' AND b.f < s.t AND s.f < b.t"""


@query(_FIFO)
def join_fifo_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase")).select(
        "user_id", "ts", "event_id", F.when(F.col("event_type") == "signup", "buy").otherwise("sell").alias("side"), (1 + F.col("event_id") % 7).alias("q"), F.col("value").alias("price")
    )
    return rounded(jn.fifo_matches(trades, "user_id", ["ts", "event_id"], "side", "q", "price").select("user_id", "buy_no", "sell_no", "quantity", "profit"))


@query(f"""WITH {PANEL}, r AS (SELECT code, date, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS ret FROM panel), m AS (SELECT date, avg(ret) AS bench FROM r GROUP BY date)
  SELECT code, r.date, round(ret - bench, 6) AS excess FROM r LEFT JOIN m USING (date)""")
def join_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = price_panel(spark, sf_dir).select("code", "date", pct_change("close", ordered("code", "date")).alias("ret"))
    bench = rows.groupBy("date").agg(F.avg("ret").alias("bench"))
    return rounded(jn.benchmark_attached(rows, bench, "date", "bench").select("code", "date", "excess"))


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(rich, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order."""
    placed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(placed, "c_custkey", "left_anti").select("c_custkey")


@query("""SELECT coalesce(s.k, c.k) AS nation, s.n AS suppliers, c.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s
  FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < 500 GROUP BY 1) c ON s.k = c.k""")
def join_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    c = table(spark, sf_dir, "customer").where("c_acctbal < 500").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    return s.join(c, "nation", "full_outer")
