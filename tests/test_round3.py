"""Whole jobs and exact values at the places where results once differed from their SQL."""

from tessera.plans.queries import QUERIES


def test_anti_join_looks_at_every_order(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(4)], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, 500000.0), (1, 10.0), (1, 450000.0), (2, 400000.0)], "o_custkey bigint, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r.c_custkey for r in QUERIES["join_anti"](spark, str(tmp_path)).collect()] == [3]


def test_places_round_a_double_below_a_half_down(spark):
    from tessera.plans.registry import places

    x = 528.0209375  # the double is less than the decimal
    assert spark.createDataFrame([(x,), (-x,), (0.5,), (None,)], "x double").select(places("x", 6).alias("y")).toPandas()["y"].tolist()[:3] == [528.020937, -528.020937, 0.5]


def test_scan_takes_whole_keys_row_by_row(spark, monkeypatch):
    """States are those of the plain recursion to the last bit; long keys are cut or joined as a tree, with nulls among keys and values."""
    import numpy as np

    from tessera.operators import recursion as rc

    rng = np.random.default_rng(4)
    rows = [(k, t, None if rng.random() < 0.1 else float(rng.normal(100, 9))) for k, n in ((None, 30), (1, 1), (2, 200), (3, 41), (4, 90)) for t in range(n)]
    want = {}
    for k in {r[0] for r in rows}:
        e = mean = fast = slow = None
        dea = 0.0
        for _, t, x in (r for r in rows if r[0] == k):
            if x is not None:
                mean = x if mean is None else (1 - 0.2) * mean + 0.2 * x
                fast, slow = (x, x) if fast is None else (2 / 13 * x + (1 - 2 / 13) * fast, 2 / 27 * x + (1 - 2 / 27) * slow)
                dea = (1 - 0.2) * dea + 0.2 * (fast - slow)
            want[k, t] = (mean, fast, slow, None if fast is None else dea)
    df = spark.createDataFrame(rows, "code int, date int, x double").repartition(5)
    steps = [rc.ewm_mean("x", 0.2, "mean"), rc.macd("x", ("fast", "slow", "dea"))]
    got = lambda: {(r.code, r.date): (r["mean"], r.fast, r.slow, r.dea) for r in rc.scan(df, steps).collect()}
    assert got() == want
    close = lambda a, b: all((p is None) == (q is None) and (p is None or abs(p - q) < 1e-9) for k in want for p, q in zip(a[k], b[k]))
    monkeypatch.setattr(rc, "WHOLE", 80)
    assert len(got()) == len(rows) and close(got(), want)
    monkeypatch.undo()
    starts, lengths = np.array([0, 30]), np.array([30, 7])
    data = {"x": rng.normal(size=37)}
    plain = rc._stepped(steps[0], data, starts, lengths)
    monkeypatch.setattr(rc, "STEPS", 10)
    monkeypatch.setattr(rc, "BATCH", 20)
    assert np.allclose(rc._stepped(steps[0], data, starts, lengths)[:, 2], plain[:, 2])


def test_rank_coefficients_of_many_columns(spark):
    """Side by side they are those of the long table: ties, missing values, NaN, times with few rows, a flat column."""
    import numpy as np
    from pyspark.sql import functions as F

    from tessera.operators import evaluation as ev

    rng = np.random.default_rng(8)
    value = lambda: [None if u < 0.1 else float("nan") if u < 0.15 else float(v) for u, v in zip(rng.random(3), rng.integers(-4, 5, 3))]
    rows = [(t, None if rng.random() < 0.1 else float(rng.integers(0, 6)), *value(), 1.0) for t in range(5) for _ in range(40 if t else 6)]
    names = ["a", "b", "c", "flat"]
    df = spark.createDataFrame(rows, "date int, forward double, a double, b double, c double, flat double")
    long = df.unpivot(["date", "forward"], names, "factor", "value").where("value is not null")
    read = lambda x: {(r.factor, r.date): (None if r.ic is None else round(r.ic, 9), r.n) for r in x.collect()}
    got = read(ev.rank_ics(df, names, "forward", least=8, width=3, parts=4))
    assert got == read(ev.rank_ic(long.withColumn("value", F.col("value")), "value", "forward", least=8, by=("factor",)))
    assert len(got) == 16 and got["flat", 1][0] is None


def test_end_places_count_below_the_last_value(spark):
    """The share of a key's last value, ties averaged and missing values left out, is what a ranking gives; no sort by value."""
    from pyspark.sql import functions as F

    from tessera.functions.expr import ordered, pct_rank
    from tessera.operators.series import _end_places

    rows = [(k, t, v) for k, vs in ((1, [3.0, 1.0, None, 3.0]), (2, [2.0, None]), (3, [5.0]), (4, [1.0, 4.0, 2.0, 2.0, 0.0, 2.0])) for t, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "code int, date int, x double")
    places = _end_places(df, ("x",), ordered("code", "date"))
    got = {r.code: r.x for r in places.groupBy("code").agg(F.max_by("x", "date").alias("x")).collect()}
    want = {r.code: r.p for r in df.withColumn("p", pct_rank("x", ["code"])).groupBy("code").agg(F.max_by("p", "date").alias("p")).collect()}
    assert got == want and places._jdf.queryExecution().executedPlan().toString().count("Sort ") == 1


def test_simulator_holds_one_date_at_a_time():
    """Rows of a date that come in several frames are one date; a strategy begins anew; no frame holds more than a date."""
    import datetime

    import pandas as pd

    from tessera.operators.portfolio import _by_date

    d = [datetime.date(2024, 1, k) for k in (1, 2, 3)]
    rows = pd.DataFrame({"s": ["a"] * 5 + ["b"] * 2, "date": [d[0], d[0], d[1], d[1], d[2], d[2], d[2]], "x": range(7)})
    days = list(_by_date(iter([rows[:1], rows[1:3], rows[3:6], rows[6:]]), "s"))
    assert [(n, t, r["x"].tolist()) for n, t, r in days] == [("a", d[0], [0, 1]), ("a", d[1], [2, 3]), ("a", d[2], [4]), ("b", d[2], [5, 6])]


def test_only_named_recursive_lines_are_computed(spark):
    from tessera.operators import timeseries as ts

    rows = [(k, t, float(10 + (t * 7 + k) % 5)) for k in (1, 2) for t in range(30)]
    df = spark.createDataFrame(rows, "code int, date int, close double")  # the lines that are named need no highs and lows
    out = ts.recursive_indicators(df, names=("ema_12", "macd"))
    assert out.columns == ["code", "date", "close", "ema_12", "macd"] and out.where("date = 0").select("ema_12").first()[0] == rows[0][2]


def test_rolled_is_spark_windows_to_the_last_bit(spark, monkeypatch):
    """Windows reach back over batches, and keys go on through several; null keys and values count as Spark counts them."""
    import numpy as np
    from pyspark.sql import functions as F

    from tessera.functions.expr import ordered, rolling, trailing
    from tessera.operators import rolled as ro
    from tessera.operators.series import steady_corr

    monkeypatch.setattr(ro, "BATCH", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    rng = np.random.default_rng(7)
    rows = [(k, t, None if rng.random() < 0.03 else float(rng.integers(1, 5)), float(rng.normal(9, 1))) for k, n in ((None, 50), (1, 1), (2, 150), (3, 9), (4, 40)) for t in range(n)]
    df = spark.createDataFrame(rows, "code long, date int, x double, y double").repartition(5)
    w = ordered("code", "date")
    specs = {f"{how}_{n}": (how, c, n) for c, how, n in (("x", "mean", 5), ("y", "sum", 20), ("y", "std", 9), ("y", "pop", 7), ("x", "min", 6), ("y", "max", 13), ("y", "skew", 8), ("y", "kurt", 12), ("x", "lag", 3))}
    specs |= {"least": ("max", "x", 30, 2), "fit": ("corr", ("x", "y"), 10), "row": ("row", "x", 1), "up": (lambda x: x > 2, ("x",), 0), "up_3": ("sum", "up", 3), "rising": ("streak", "up", 1)}
    try:
        got = {(r.code, r.date): r for r in ro.rolled(ro.sorted_by(df, "code", "date"), specs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    up = F.coalesce((F.col("x") > 2).cast("double"), F.lit(0.0))
    pop = F.when(F.count("y").over(trailing(w, 7)) >= 7, F.stddev_pop("y").over(trailing(w, 7)))
    want = {n: rolling(c, how, w, k) for n, (how, c, k) in list(specs.items())[:8] if how != "pop"} | {
        "pop_7": pop, "lag_3": F.lag("x", 3).over(w), "least": rolling("x", "max", w, 30, 2), "fit": steady_corr("x", "y", w, 10), "row": F.row_number().over(w).cast("double"),
    }
    flagged = df.withColumn("up", up).withColumns(want).withColumn("up_3", rolling("up", "sum", w, 3))
    flagged = flagged.withColumn("rising", (F.col("row") - F.coalesce(F.max(F.when(F.col("up") == 0, F.col("row"))).over(w.rowsBetween(-10_000, 0)), F.lit(0.0))))
    for r in flagged.collect():
        for n in (*want, "up_3", "rising"):
            a, b = got[r.code, r.date][n], r[n]
            assert (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-13 * max(1, abs(b))), (n, r)
    assert len(got) == len(rows)


def test_level_and_bar_series_need_one_shuffle_and_no_window(spark):
    from tessera.operators import series as sr

    bars = spark.createDataFrame([(1, k, 1.0, 2.0, 0.5, 1.5, 10.0, 15.0) for k in range(3)], "code int, date int, open double, high double, low double, close double, volume double, amount double")
    for make in (sr.level_series, sr.bar_series):
        plan = make(bars)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and plan.count("Exchange") == 1


def test_streaks_are_carried_over_batches_without_a_second_shuffle(spark, monkeypatch):
    from tessera.operators import limitpool as lp
    from tessera.operators import rolled as ro

    monkeypatch.setattr(ro, "BATCH", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    moves = [1.1] * 12 + [1.0] * 30 + [1.1, 1.0, 1.1, 1.1] + [1.0] * 3
    rows, close = [], 100.0
    for k in range(3):
        for t, m in enumerate(moves[k:]):
            close = round(close * m, 2)
            rows.append((k, t, close, close))
    df = spark.createDataFrame(rows, "code int, date int, close double, high double").repartition(3)
    try:
        pool = lp.limit_pool(df)
        got = {(r.code, r.date): (r.locked_up, r.streak) for r in pool.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = pool._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Scan parquet" not in plan
    for k in range(3):
        run = held = 0
        for t in range(len(moves) - k):
            run = run + 1 if got[k, t][0] else 0
            held = run or held
            assert got[k, t][1] == held
    assert max(s for _, s in got.values()) >= 10
