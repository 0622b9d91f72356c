"""The alert gateway: what of a flood of alerts goes out. A channel sends an alert unless it repeats the signature that it
last sent within ``gap`` seconds, the channel has sent ``cap`` in this hour, or it is night and the level isn't ``danger``.

The stream keeps a row of state per channel and lets it go once nothing in it can matter any more: a timer on event time,
set to the later of the gap's and the hour's end, forgets the channel when the watermark passes. The batch twin folds
channels in order of time in a stream of rows, so a channel may have any number of alerts.

Alerts of a channel must come in order of time from trigger to trigger; within one they are sorted. Equal times are
ordered by ``id``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SENT = "channel string, id bigint, ts timestamp, signature string, level string"
STATE = "signatures array<string>, sent_at array<double>, hour bigint, sent bigint"
#: Numbers that vary between alerts of one kind: with decimals, with a unit, or of at most four digits. Longer ones are names.
_VARYING = re.compile(r"\d+\.\d+%?|\d+(?:\.\d+)?(?:元|亿|%)|\b\d{1,4}\b")


def normalized(text: Column) -> Column:
    """The message with ``#`` for prices, percentages and amounts."""
    return F.regexp_replace(text, _VARYING.pattern, "#")


def signature(*parts: Column) -> Column:
    """Twelve digits that tell messages apart."""
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12)


@dataclass
class Rules:
    """``each``: repeats are looked for among all signatures of the last ``gap`` seconds, not just the last one sent."""

    gap: float = 7200.0
    cap: int = 10
    night: tuple[int, int] = (23, 8)
    each: bool = False


@dataclass
class Channel:
    """When signatures were sent (only the last, unless the rules ask for each), and how many in the hour."""

    sent_at: dict[str, float] = field(default_factory=dict)
    hour: int = -1
    sent: int = 0

    def takes(self, at: float, of_day: int, mark: str, level: str, rules: Rules) -> bool:
        hour = int(at // 3600)
        if hour == self.hour and self.sent >= rules.cap:
            return False
        from_, to = rules.night
        asleep = (of_day >= from_ or of_day < to) if from_ > to else from_ <= of_day < to
        if asleep and level != "danger":
            return False
        last = self.sent_at.get(mark)
        if last is not None and at - last < max(rules.gap, 1.0):
            return False
        self.sent_at = {m: t for m, t in self.sent_at.items() if rules.each and at - t < rules.gap} | {mark: at}
        self.hour, self.sent = hour, self.sent + 1 if hour == self.hour else 1
        return True

    def matters_until(self, rules: Rules) -> float:
        return max([(self.hour + 1) * 3600.0, *(t + rules.gap for t in self.sent_at.values())])


def _passed(rows: pd.DataFrame, channel: Channel, rules: Rules) -> pd.DataFrame:
    taken = [channel.takes(t, h, m, v, rules) for t, h, m, v in zip(rows["at"], rows["of_day"], rows["signature"], rows["level"])]
    return rows.loc[taken, ["channel", "id", "ts", "signature", "level"]]


def gateway(alerts: DataFrame, rules: Rules = Rules(), late: str = "10 minutes") -> DataFrame:
    """Of alerts (channel, id, ts, signature, level) those that are sent. Nights go by the session's time zone. Alerts without
    a channel or a time are never sent."""
    rows = alerts.select(F.col("channel").cast("string"), F.col("id").cast("bigint"), F.col("ts").cast("timestamp"), F.col("signature").cast("string"), F.coalesce(F.col("level").cast("string"), F.lit("info")).alias("level"))
    rows = rows.where(F.col("ts").isNotNull() & F.col("channel").isNotNull()).withColumn("at", F.unix_micros("ts") / 1e6).withColumn("of_day", F.hour("ts"))
    if not alerts.isStreaming:
        return _batch(rows, rules)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        channel = Channel()
        if state.exists:
            marks, times, hour, sent = state.get
            channel = Channel(dict(zip(marks, times)), hour, sent)
        out = _passed(pd.concat(list(batches)).sort_values(["ts", "id"]), channel, rules)
        if channel.sent_at:
            state.update((list(channel.sent_at), list(channel.sent_at.values()), channel.hour, channel.sent))
            state.setTimeoutTimestamp(max(int(channel.matters_until(rules) * 1000), state.getCurrentWatermarkMs() + 1))
        yield out

    return rows.withWatermark("ts", late).groupBy("channel").applyInPandasWithState(step, SENT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _batch(rows: DataFrame, rules: Rules) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, channel = object(), Channel()
        for batch in batches:
            new = (batch["channel"] != batch["channel"].shift()).cumsum()
            for _, part in batch.groupby(new, sort=False):
                if part["channel"].iloc[0] != name:
                    name, channel = part["channel"].iloc[0], Channel()
                yield _passed(part, channel, rules)

    dealt = rows.repartition("channel").sortWithinPartitions("channel", "ts", "id")
    return dealt.mapInPandas(run, SENT)
