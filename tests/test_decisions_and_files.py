"""Rules, seasons, expected returns and files, against direct versions."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import decisions as de
from tessera.sources import catalog as cat
from tessera.sources import files as fs

D = datetime.date


def test_out_of_sample_rule(spark):
    cases = [
        (0.03, None, 0, "downweight", 0.5, False, "oos_missing"), (None, 0.03, 0, "downweight", 0.5, False, "in_sample_ic_missing"), (0.03, 0.001, 0, "retire", 0.0, False, "oos_ic_below_threshold"),
        (0.0, 0.03, 0, "downweight", 0.5, False, "in_sample_ic_zero"), (0.03, 0.01, 3, "keep", 1.0, False, "sign_consistent"), (-0.03, -0.01, None, "keep", 1.0, False, "sign_consistent"),
        (0.03, -0.01, 0, "downweight", 0.5, True, "flip"), (0.03, -0.02, 0, "retire", 0.0, True, "severe_flip"), (-0.03, 0.01, 1, "retire", 0.0, True, "consecutive_flip_streak_2"), (0.03, -0.03, -5, "retire", 0.0, True, "severe_flip"),
    ]
    df = spark.createDataFrame([(k, a, b, n) for k, (a, b, n, *_) in enumerate(cases)], "k int, a double, b double, n int")
    got = {r.k: (r.action, r.multiplier, r.flip, r.reason) for r in de.out_of_sample_rule(df, "a", "b", "n").collect()}
    assert got == {k: tuple(c[3:]) for k, c in enumerate(cases)}


def test_expected_returns_never_look_ahead(spark):
    rng = np.random.default_rng(4)
    day = lambda k: D(2024, 1, 1) + datetime.timedelta(days=k)
    rows = [(f"c{i}", day(t), float(rng.normal()), float(rng.normal()), day(t + 3)) for t in range(40) for i in range(12)]
    df = spark.createDataFrame(rows + [("c0", day(50), 0.5, None, None), ("c1", day(50), None, None, None)], "code string, date date, f double, y double, known date").repartition(3)
    got = {(r.code, r.date): r.expected_ret for r in de.expected_return(df, "f", "y", "known", 4, 5).collect()}
    bucket, share = {}, {}
    for t in range(40):
        mine = sorted((r for r in rows if r[1] == day(t)), key=lambda r: r[2])
        for k, r in enumerate(mine, 1):
            share[r[0], t] = k / 12
            bucket.setdefault((t, int(min(k / 12, 0.999999) * 4)), []).append(r[3])
    for t in range(40):
        known = [s for s in range(40) if s + 3 <= t]
        table = [np.mean([np.mean(bucket[s, b]) for s in known]) if len(known) >= 5 else None for b in range(4)]
        for i in range(12):
            x = min(max(share[f"c{i}", t] * 4 - 0.5, 0), 3)
            lo, hi = int(x), min(int(x) + 1, 3)
            want = None if table[0] is None else table[lo] * (1 - x + lo) + table[hi] * (x - lo)
            have = got[f"c{i}", day(t)]
            assert (have is None) == (want is None) and (want is None or abs(have - want) < 1e-9)
    assert got["c0", day(50)] is not None and got["c1", day(50)] is None


def test_seasons(spark):
    days = [D(2020, 1, 1) + datetime.timedelta(days=k) for k in range(5 * 366)]
    value = lambda d: 30.0 if (d.month == 1 and d.day >= 25) or (d.month == 2 and d.day <= 20) else 9.0 if d.month == 10 else 10.0
    got = {r.season: r for r in de.season_effects(spark.createDataFrame([(d, value(d)) for d in days], "date date, v double"), "v").collect()}
    spring = got["new_year_festival"]
    assert (spring.years, spring.mean, spring.verdict, spring.multiplier, spring.win_rate) == (5, 30.0, "supported", 1.2, 1.0) and spring.days == sum(value(d) == 30 for d in days)
    assert got["third_quarter_reports"].verdict == "unsupported" and got["third_quarter_reports"].mean == 9.0 and got["march_sessions"].difference < 0
    short = de.season_effects(spark.createDataFrame([(d, 1.0) for d in days[:400]], "date date, v double"), "v").collect()
    assert {r.verdict for r in short} == {"too_few_years"} and de.season_effects(spark.createDataFrame([], "date date, v double"), "v").count() == 0


def test_mapped_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("日期,收盘,volume,extra\n2024-01-02,10.5,100,x\n2024-01-03, - ,,y\n")
    rows = fs.read_csv(spark, str(tmp_path / "a.csv"), {"date": ("日期",), "close": ("收盘", "last"), "volume": (), "amount": ("成交额",)}, {"date": "date"}).orderBy("date").collect()
    assert [tuple(r) for r in rows] == [(D(2024, 1, 2), 10.5, 100.0, None), (D(2024, 1, 3), None, None, None)]


def test_panels_of_mixed_files(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two.csv")
    spark.createDataFrame([("000001", D(2024, 1, 2), 1.0, 5.0), ("000001", D(2024, 1, 3), 2.0, 6.0), (None, D(2024, 1, 3), 9.0, 9.0)], "code string, date date, close double, pe double").write.parquet(one)
    (tmp_path / "two.csv").write_text("code,date,close,name\n000001,2024-01-03,7,n\n000002,2024-01-03,bad,m\n")
    rows = fs.load_panel(spark, [one, two]).orderBy("code", "date").collect()
    assert [(r.code, r.date.day, r.close, r.pe) for r in rows] == [("000001", 2, 1.0, 5.0), ("000001", 3, 7.0, None), ("000002", 3, None, None)]
    (tmp_path / "three.csv").write_text("code,day\n1,2\n")
    with pytest.raises(ValueError, match="close"):
        fs.load_panel(spark, [one, str(tmp_path / "three.csv")])


def test_listings_and_freshness(spark, tmp_path):
    for name in ("q_20240105.csv", "q_20240107.csv", "q_20240106.csv", "note.txt"):
        (tmp_path / name).write_text("x")
    assert [p.rsplit("/", 1)[1] for p in fs.newest(spark, str(tmp_path), 2, "*.csv")] == ["q_20240107.csv", "q_20240106.csv"]
    row = fs.freshness(spark, str(tmp_path), "2024-01-08", pattern="*.csv").first()
    assert (row.files, row.last, row.age_days, row.status) == (3, D(2024, 1, 7), 1, "ok")
    assert fs.freshness(spark, str(tmp_path), "2024-03-08", pattern="*.csv").first().status == "stale" and fs.freshness(spark, str(tmp_path), "2024-03-08", pattern="*.none").first().status == "missing"


def test_versions_can_be_deleted(spark, tmp_path):
    table = cat.VersionedTable(spark, f"file://{tmp_path}/v")
    df = spark.createDataFrame([(D(2024, 1, 2), 1)], "date date, x int")
    table.write(df, "a")
    table.write(df.withColumn("x", F.lit(2)), "b")
    assert fs.delete_version(spark, table.path, "b") and not fs.delete_version(spark, table.path, "b")
    assert table.versions() == ["a"] and [r.x for r in table.read().collect()] == [1]
    with pytest.raises(ValueError):
        fs.delete_version(spark, table.path, "../v")
