"""What to do with what was measured: expected returns at the decision date, keeping or retiring factors, calendar windows
with a verdict, market timing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.expr import clip, pct_rank, rolling_pair, safe_div
from tessera.operators.evaluation import trailing_calibration


def calibration_at(df: DataFrame, factor: str, label: str, known_on: str, q: int = 10, least: int = 20, time: str = "date") -> DataFrame:
    """(time, expected): for each date of ``df`` the expected label of every bucket (an array of ``q``) as of the last realised date at
    or before it; missing where that was before ``least`` realised dates. One row per date and bucket is ordered."""
    known = trailing_calibration(df, factor, label, known_on, q, least, time)
    facts = known.select(F.col("realized").alias("__t"), "bucket", F.lit(0).alias("__ask"), F.struct("expected").alias("__e"))
    asked = df.select(F.col(time).alias("__t")).distinct().select("__t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q - 1).cast("bigint"))).alias("bucket"), F.lit(1).alias("__ask"), F.lit(None).cast("struct<expected: double>").alias("__e"))
    line = Window.partitionBy("bucket").orderBy("__t", "__ask").rowsBetween(Window.unboundedPreceding, 0)
    rows = facts.unionByName(asked).withColumn("__e", F.last("__e", ignorenulls=True).over(line)).where("__ask = 1")
    cells = F.array_sort(F.collect_list(F.struct("bucket", F.col("__e.expected").alias("e"))))
    return rows.groupBy(F.col("__t").alias(time)).agg(F.transform(cells, lambda c: c["e"]).alias("expected"))


def expected_return(df: DataFrame, factor: str, label: str, known_on: str, q: int = 10, least: int = 20, time: str = "date") -> DataFrame:
    """``df`` with ``expected_ret``: between the means of the two buckets next to a row's percentile on its date, in proportion, as
    known on that date. A bucket stands for its middle; beyond the outer ones' middles theirs counts."""
    table = calibration_at(df, factor, label, known_on, q, least, time).withColumnRenamed("expected", "__table")
    x = clip(pct_rank(factor, [time]) * q - 0.5, 0.0, q - 1.0)
    rows = df.withColumn("__x", F.when(F.col(factor).isNotNull(), x)).join(table, time, "left")
    low = F.floor("__x").cast("int")
    at = lambda k: F.try_element_at("__table", k + 1)
    share = F.col("__x") - low
    found = at(low) * (1 - share) + at(F.least(low + 1, F.lit(q - 1))) * share
    return rows.withColumn("expected_ret", found).drop("__x", "__table")


def out_of_sample_rule(df: DataFrame, inside: str, outside: str, flips: str | None = None, noise: float = 0.005, severe: float = 0.02, streak: int = 2, reduced: float = 0.5) -> DataFrame:
    """``action`` (keep, downweight, retire), ``multiplier``, ``flip`` and ``reason`` of factors whose coefficient was ``inside`` the sample and
    is ``outside`` it now, after ``flips`` periods of the other sign in a row. Missing coefficients, or none inside, weigh less; one
    that is noise outside retires a factor; so does a severe flip, or the ``streak``-th in a row; a first mild one weighs less."""
    a, b = F.col(inside), F.col(outside)
    run = F.greatest(F.coalesce(F.col(flips), F.lit(0)) if flips else F.lit(0), F.lit(0)) + 1
    flip = F.coalesce(F.signum(a) != F.signum(b), F.lit(False)) & (a != 0) & (F.abs(b) >= noise)
    cases = [
        (b.isNull(), "downweight", "oos_missing"), (a.isNull(), "downweight", "in_sample_ic_missing"), (F.abs(b) < noise, "retire", "oos_ic_below_threshold"), (a == 0, "downweight", "in_sample_ic_zero"),
        (~flip, "keep", "sign_consistent"), (run >= streak, "retire", F.concat(F.lit("consecutive_flip_streak_"), run.cast("string"))), (F.abs(b) >= severe, "retire", "severe_flip"), (F.lit(True), "downweight", "flip"),
    ]
    action = reason = None
    for test, what, why in cases:
        why = why if isinstance(why, Column) else F.lit(why)
        action = F.when(test, what) if action is None else action.when(test, what)
        reason = F.when(test, why) if reason is None else reason.when(test, why)
    rows = df.withColumn("action", action).withColumn("reason", reason).withColumn("flip", F.coalesce(flip, F.lit(False)))
    return rows.withColumn("multiplier", F.when(F.col("action") == "keep", 1.0).when(F.col("action") == "retire", 0.0).otherwise(reduced))


@dataclass(frozen=True)
class Season:
    """From a day of one month to a day of it or the next; the direction that is claimed (1, -1, or none); whether the rest of the year or
    the whole year is the base."""

    name: str
    first: tuple[int, int]
    last: tuple[int, int]
    direction: int | None = 1
    whole_year: bool = False

    def holds(self, day: Column) -> Column:
        month, of_month = F.month(day), F.dayofmonth(day)
        if self.first[0] == self.last[0]:
            return (month == self.first[0]) & of_month.between(self.first[1], self.last[1])
        return ((month == self.first[0]) & (of_month >= self.first[1])) | ((month == self.last[0]) & (of_month <= self.last[1]))


SEASONS = (Season("new_year_festival", (1, 25), (2, 20)), Season("march_sessions", (3, 1), (3, 14), 1, True), Season("annual_reports", (4, 11), (4, 30), None), Season("third_quarter_reports", (10, 1), (10, 31), None))


def season_effects(daily: DataFrame, value: str, seasons: tuple[Season, ...] = SEASONS, time: str = "date", years: int = 3, win: float = 0.6, difference: float = 0.2, bounds: tuple[float, float] = (0.8, 1.2)) -> DataFrame:
    """One row per season: years and days, mean in it and of its base, relative ``difference``, the share of years in which its mean was
    above the base's, ``significant``, ``verdict`` (supported, unsupported, too_few_years) and a ``multiplier`` for exposure. All
    seasons are told in one pass over the days."""
    marks = F.array(*(F.struct(F.lit(s.name).alias("season"), F.lit(s.direction).cast("int").alias("direction"), s.holds(F.col(time)).alias("inside"), (F.lit(True) if s.whole_year else ~s.holds(F.col(time))).alias("base")) for s in seasons))
    rows = daily.select(F.year(time).alias("year"), F.col(value).cast("double").alias("v"), F.inline(marks))
    mean = lambda test: F.avg(F.when(F.col(test), F.col("v")))
    by_year = rows.groupBy("season", "direction", "year").agg(mean("inside").alias("w"), mean("base").alias("b"))
    both = F.col("w").isNotNull() & F.col("b").isNotNull()
    won = by_year.groupBy("season", "direction").agg(F.count_if(both).alias("years"), F.avg(F.when(both, (F.col("w") > F.col("b")).cast("double"))).alias("win_rate"))
    pooled = rows.groupBy("season").agg(F.count_if("inside").alias("days"), mean("inside").alias("mean"), mean("base").alias("base"))
    out = won.join(pooled, "season").withColumn("difference", safe_div(F.col("mean") - F.col("base"), "base"))
    known = F.col("difference").isNotNull() & F.col("win_rate").isNotNull()
    right = F.col("direction").isNull() | (F.col("difference") * F.col("direction") >= 0)
    sure = F.coalesce(F.abs("difference") >= difference, F.lit(False))
    out = out.withColumn("significant", sure)
    verdict = F.when((F.col("years") < years) | ~known, "too_few_years").when((F.col("win_rate") >= win) & sure & right, "supported").otherwise("unsupported")
    multiplier = F.coalesce(F.round(clip(1 + F.col("difference"), *bounds), 2), F.lit(1.0))
    return out.select("season", "years", "days", "mean", "base", "difference", "win_rate", "significant", verdict.alias("verdict"), multiplier.alias("multiplier"))


def timing_correlation(df: DataFrame, factor: str, forward: str, n: int = 60, least: int = 30, time: str = "date") -> DataFrame:
    """(time, timing): correlation, over the last ``n`` dates, of a factor that all keys share (its mean on a date) with the mean later
    return. One row per date is ordered."""
    daily = df.groupBy(time).agg(F.avg(factor).alias("factor"), F.avg(forward).alias("forward"))
    return daily.select(time, rolling_pair("factor", "forward", "corr", Window.orderBy(time), n, least).alias("timing"))
