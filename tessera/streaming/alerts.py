"""Streaming: event-time windows, keyed alerts with cooldown, deduplication; each with its batch twin."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALERT = "user_id bigint, ts timestamp, kind string, value double"
STATE = "last double, fired_large double, fired_jump double"


def stream(spark: SparkSession, path: str, schema: T.StructType, time: str = "ts", files: int = 1, format: str = "parquet") -> DataFrame:
    """A file stream whose time column can carry a watermark (which takes no zoneless timestamps)."""
    rows = spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files).load(path)
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour", time: str = "ts", by: str = "event_type") -> DataFrame:
    """Count and sum per event-time window and ``by``; late rows are taken within the watermark."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, length, slide) if slide else F.window(time, length)
    out = rows.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), by, "n", "total")


def _step(last: float | None, fired: dict[str, float], at: float, value: float, large: float, jump: float, rest: float) -> tuple[list[str], float]:
    """Alerts of one quote, given the last value and when each kind last fired."""
    kinds = []
    if value >= large:
        kinds.append("large")
    if last and abs(value / last - 1) >= jump:
        kinds.append("jump")
    out = [k for k in kinds if at - fired.get(k, -1e18) >= rest]
    for k in out:
        fired[k] = at
    return out, value


def _run(rows: pd.DataFrame, last: float | None, fired: dict[str, float], large: float, jump: float, rest: float) -> tuple[pd.DataFrame, float | None]:
    out = []
    for key, ts, value in rows.sort_values(["ts", "event_id"])[["user_id", "ts", "value"]].itertuples(index=False):
        kinds, last = _step(last, fired, ts.timestamp(), value, large, jump, rest)
        out += [(key, ts, k, value) for k in kinds]
    return pd.DataFrame(out, columns=["user_id", "ts", "kind", "value"]) if out else pd.DataFrame(columns=["user_id", "ts", "kind", "value"], dtype=object), last


def alerts(events: DataFrame, large: float = 60.0, jump: float = 3.0, rest: float = 1800.0) -> DataFrame:
    """Large values and jumps per user, each kind at most once per ``rest`` seconds. The state is the last value
    and when each kind fired; a batch frame is folded per user, a stream keeps it from batch to batch."""
    rows = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    if not events.isStreaming:
        return rows.groupBy("user_id").applyInPandas(lambda p: _run(p, None, {}, large, jump, rest)[0], ALERT)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, a, b = state.get if state.exists else (None, None, None)
        fired = {k: v for k, v in (("large", a), ("jump", b)) if v is not None}
        out, last = _run(pd.concat(list(batches)), last, fired, large, jump, rest)
        state.update((last, fired.get("large"), fired.get("jump")))
        yield out

    return rows.groupBy("user_id").applyInPandasWithState(step, ALERT, STATE, "append", GroupStateTimeout.NoTimeout)


_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)?")


def signature(text: str):
    """A message without its numbers: alerts of one signature are one alert."""
    return F.regexp_replace(F.col(text), _NUMBER.pattern, "#")


def first_in_window(events: DataFrame, keys: list[str], late: str, time: str = "ts") -> DataFrame:
    """A stream's rows without repeats of ``keys`` within the watermark; a batch's without any repeats."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into a Parquet folder and read that."""
    query = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
