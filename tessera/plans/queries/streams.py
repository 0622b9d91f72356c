"""Streaming operators on events: the stream itself where its result is fixed, and batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.panel import table
from tessera.plans.registry import query, rounded
from tessera.sources.scratch import new_path
from tessera.streaming import alerts as sa
from tessera.streaming import gateway as gw


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def sm_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sa.windowed(table(spark, sf_dir, "events"), "1 hour"), 4)


@query("""WITH s AS (SELECT unnest([0, 1, 2]) AS k) SELECT date_trunc('hour', ts) - INTERVAL (k) HOUR AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, s GROUP BY 1, 2""")
def sm_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sa.windowed(table(spark, sf_dir, "events"), "3 hours", "1 hour"), 4)


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, ts, value, row_number() OVER w AS k, lag(value) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT user_id, k, ts, value, value >= 60 AS a, false AS b, CASE WHEN value >= 60 THEN ts END AS fa, NULL::TIMESTAMP AS fb FROM r WHERE k = 1
        UNION ALL SELECT r.user_id, r.k, r.ts, r.value, r.value >= 60 AND (fa IS NULL OR r.ts - fa >= INTERVAL 30 MINUTE), p <> 0 AND abs(r.value / p - 1) >= 3 AND (fb IS NULL OR r.ts - fb >= INTERVAL 30 MINUTE),
          CASE WHEN r.value >= 60 AND (fa IS NULL OR r.ts - fa >= INTERVAL 30 MINUTE) THEN r.ts ELSE fa END, CASE WHEN p <> 0 AND abs(r.value / p - 1) >= 3 AND (fb IS NULL OR r.ts - fb >= INTERVAL 30 MINUTE) THEN r.ts ELSE fb END
        FROM s JOIN r ON r.user_id = s.user_id AND r.k = s.k + 1)
  SELECT user_id, 'large' AS kind, count(*) AS n FROM s WHERE a GROUP BY 1 UNION ALL SELECT user_id, 'jump', count(*) FROM s WHERE b GROUP BY 1""")
def sm_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.alerts(table(spark, sf_dir, "events")).groupBy("user_id", "kind").agg(F.count("*").alias("n"))


@query("SELECT user_id, kind, n FROM (SELECT user_id % 10 AS user_id, 'seen' AS kind, count(DISTINCT event_id) AS n FROM events GROUP BY 1)")
def sm_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events twice over as a file stream, without repeats."""
    events = table(spark, sf_dir, "events")
    source = new_path(spark, "events")
    both = events.unionByName(events).repartition(2)
    both.write.parquet(source)
    rows = sa.first_in_window(sa.stream(spark, source, events.schema), ["event_id"], "60 days")
    out = sa.drain(rows.select("event_id", "user_id"), new_path(spark, "seen"), new_path(spark, "offsets"))
    return out.groupBy((F.col("user_id") % 10).alias("user_id")).agg(F.count("*").alias("n")).select("user_id", F.lit("seen").alias("kind"), "n")


@query("SELECT regexp_replace(event_type || ' ' || event_id || ' at ' || value, '[0-9]+(\\.[0-9]+)?', '#', 'g') AS signature, count(*) AS n FROM events GROUP BY 1")
def sm_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat_ws(" ", "event_type", F.col("event_id").cast("string"), F.lit("at"), F.col("value").cast("string"))
    return table(spark, sf_dir, "events").withColumn("message", message).groupBy(sa.signature("message").alias("signature")).agg(F.count("*").alias("n"))


def _gateway_alerts(events: DataFrame) -> DataFrame:
    message = F.concat(F.col("event_type"), F.lit(" at "), F.format_string("%.2f", F.col("value")))
    level = F.when(F.col("event_type") == "error", "danger").otherwise("info")
    return events.select(F.concat_ws("-", "event_type", (F.col("user_id") % 20).cast("string")).alias("channel"), F.col("event_id").alias("id"), "ts", gw.signature(gw.normalized(message)).alias("signature"), level.alias("level"))


@query("""WITH RECURSIVE a AS (SELECT event_type || '-' || (user_id % 20) AS channel, event_id AS id, ts, substr(md5(regexp_replace(event_type || ' at ' || printf('%.2f', value), '[0-9]+[.][0-9]+%?', '#', 'g')), 1, 12) AS sig,
    event_type = 'error' OR hour(ts) BETWEEN 8 AND 22 AS awake, epoch(ts)::DOUBLE AS t, floor(epoch(ts) / 3600)::BIGINT AS h FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts, id) AS k FROM a),
  s AS (SELECT channel, 0::BIGINT AS k, 0::BIGINT AS id, false AS sent, ''::VARCHAR AS last, 0.0::DOUBLE AS tm, -1::BIGINT AS hour, 0::BIGINT AS n FROM r WHERE k = 1
    UNION ALL SELECT channel, k, id, ok, CASE WHEN ok THEN sig ELSE last END, CASE WHEN ok THEN t ELSE tm END, CASE WHEN ok THEN h ELSE hour END, CASE WHEN NOT ok THEN n WHEN h = hour THEN n + 1 ELSE 1 END
    FROM (SELECT r.*, s.last, s.tm, s.hour, s.n, NOT (r.h = s.hour AND s.n >= 10) AND r.awake AND NOT (r.sig = s.last AND r.t - s.tm < 7200) AS ok FROM s JOIN r ON r.channel = s.channel AND r.k = s.k + 1))
  SELECT channel, id FROM s WHERE sent""")
def sm_gateway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gateway sends of one alert per event, as a stream of four files in order of time."""
    alerts = _gateway_alerts(table(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    source = new_path(spark, "alerts")
    for lo, hi in ((0, 9), (9, 17), (17, 24), (24, 32)):  # events of one month
        day = F.dayofmonth("ts")
        alerts.where((day >= lo) & (day < hi)).coalesce(1).write.mode("append").parquet(source)
    rows = sa.stream(spark, source, alerts.schema, files=1)
    return sa.drain(gw.gateway(rows), new_path(spark, "sent"), new_path(spark, "offsets")).select("channel", "id")
