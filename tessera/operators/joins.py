"""Joins beyond equality: as-of, effective-dated, announcement lag, next-day pairs, interval matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def as_of(left: DataFrame, right: DataFrame, key: str | None, left_time: str, right_time: str, columns: list[str], tolerance_days: int | None = None, tie: str | None = None) -> DataFrame:
    """Each left row with the right row in force: the latest at or before its time, per key. Left rows without
    one keep nulls; ``tolerance_days`` bounds how old it may be; ``tie`` orders right rows of one time.

    Both sides go through one window over their union: one shuffle on the key and a sort, no pairs."""
    keys = [key] if key else []
    payload = F.struct(F.col(right_time).alias("__at"), *(F.col(c) for c in columns))
    events = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), (F.col(tie) if tie else F.lit(None)).cast("string").alias("__tie"), payload.alias("__right"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__left"))
    probes = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("string").alias("__tie"), F.lit(None).cast(events.schema["__right"].dataType).alias("__right"), F.struct(*left.columns).alias("__left"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.unionByName(probes).withColumn("__hit", F.last("__right", ignorenulls=True).over(w)).where("__side = 1")
    hit: Column = F.col("__hit")
    if tolerance_days is not None:
        hit = F.when(F.datediff("__t", F.col("__hit.__at")) <= tolerance_days, F.col("__hit"))
    rows = rows.withColumn("__hit", hit)
    return rows.select("__left.*", F.col("__hit.__at").alias(f"{right_time}_in_force"), *(F.col(f"__hit.{c}").alias(c) for c in columns))


def available_on(releases: DataFrame, calendar: DataFrame, lag: int, announced: str, day: str = "date") -> DataFrame:
    """``available``: the session ``lag`` sessions after the first one at or after the announcement; missing
    beyond the calendar. The calendar is one row per session; each day up to a session is laid out with it, so that
    releases are joined on equal days."""
    sessions = calendar.select(F.col(day).cast("date").alias("__to")).distinct()
    sessions = sessions.select("__to", F.lag("__to").over(Window.orderBy("__to")).alias("__last"), F.lead("__to", lag).over(Window.orderBy("__to")).alias("available"))
    days = F.sequence(F.coalesce(F.date_add("__last", 1), F.col("__to")), F.col("__to"))
    laid = sessions.select(F.explode(days).alias("__day"), "available")
    first = sessions.agg(F.min("__to").alias("__first"))  # one row: earlier announcements wait for it
    rows = releases.crossJoin(F.broadcast(first)).withColumn("__day", F.greatest(F.col(announced).cast("date"), F.col("__first")))
    rows = rows.withColumn("__day", F.when(F.col(announced).isNotNull(), F.col("__day")))
    return rows.join(laid, "__day", "left").drop("__day", "__first")


def report_anchor(df: DataFrame, period: str, announced: str) -> DataFrame:
    """``anchor``: the announcement where known, else 150 days after a December period and 90 after others."""
    guess = F.date_add(F.col(period), F.when(F.month(period) == 12, 150).otherwise(90))
    return df.withColumn("anchor", F.coalesce(F.col(announced), guess))


def next_day_pairs(active: DataFrame, member: str, day: str, least: int = 5) -> DataFrame:
    """For members a, b: how far b's activity on the session after a's exceeds its base rate. ``active`` has
    one row per active member and day; sessions are the days that occur."""
    active = active.select(member, day).distinct()
    sessions = active.select(day).distinct()
    calendar = sessions.withColumn("__next", F.lead(day).over(Window.orderBy(day)))
    n = calendar.where("__next is not null").agg(F.count("*").alias("days"))
    source = active.join(calendar, day).where("__next is not null")
    a_days = source.groupBy(F.col(member).alias("src")).agg(F.count("*").alias("samples"))
    followers = active.select(F.col(member).alias("dst"), F.col(day).alias("__next"))
    base = followers.join(calendar.select("__next").where("__next is not null"), "__next").groupBy("dst").agg(F.count("*").alias("dst_days"))
    pairs = source.select(F.col(member).alias("src"), "__next").join(followers, "__next").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("together"))
    out = pairs.join(a_days, "src").join(base, "dst").crossJoin(F.broadcast(n)).where(F.col("samples") >= least)
    cond, rate = F.col("together") / F.col("samples"), F.col("dst_days") / F.col("days")
    return out.select("src", "dst", "samples", cond.alias("cond_prob"), rate.alias("base_prob"), (cond / rate).alias("lift"))


def overlap(df: DataFrame, group: str, member: str) -> DataFrame:
    """Jaccard overlap of groups that share a member, by counting shared members."""
    rows = df.select(group, member).distinct()
    sizes = rows.groupBy(group).agg(F.count("*").alias("size"))
    a, b = rows.select(F.col(group).alias("a"), member), rows.select(F.col(group).alias("b"), member)
    both = a.join(b, member).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = both.join(sizes.select(F.col(group).alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col(group).alias("b"), F.col("size").alias("size_b")), "b")
    return out.select("a", "b", "shared", (F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))).alias("jaccard"))


def fifo_matches(trades: DataFrame, key: str, order: list[str], side: str, quantity: str, price: str) -> DataFrame:
    """Sells matched to the oldest open buys: each side's trades are stretches of cumulative quantity, and the ends of both
    sides' stretches, in order, cut a key into pieces that belong to one buy and one sell. A key is sorted, its
    trades aren't paired. Sells beyond all buys have no match. Buys should precede their sells."""
    w = Window.partitionBy(key, side).orderBy(*order)
    rows = trades.where(F.col(quantity) > 0).withColumn("__to", F.sum(quantity).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__row", F.row_number().over(w))
    lot = lambda s: F.max(F.when(F.col(side) == s, F.struct(F.col("__row").alias("no"), F.col(price).alias("price")))).alias(s)
    cuts = rows.groupBy(key, "__to").agg(lot("buy"), lot("sell"))
    line = Window.partitionBy(key).orderBy("__to")
    ahead = line.rowsBetween(0, Window.unboundedFollowing)
    pieces = cuts.select(key, (F.col("__to") - F.coalesce(F.lag("__to").over(line), F.lit(0))).alias("quantity"), *(F.first(s, ignorenulls=True).over(ahead).alias(s) for s in ("buy", "sell")))
    pieces = pieces.where("buy IS NOT NULL AND sell IS NOT NULL")
    profit = F.col("quantity") * (F.col("sell.price") - F.col("buy.price"))
    return pieces.select(key, F.col("buy.no").alias("buy_no"), F.col("sell.no").alias("sell_no"), "quantity", F.col("buy.price").alias("buy_price"), F.col("sell.price").alias("sell_price"), profit.alias("profit"))


def benchmark_attached(df: DataFrame, benchmark: DataFrame, time: str, column: str) -> DataFrame:
    """All rows with one series' value of their time."""
    return df.join(benchmark.select(time, column), time, "left").withColumn("excess", F.col("ret") - F.col(column))
