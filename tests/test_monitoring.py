"""Sessions, phases, betas and rolling figures at their edges."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import monitoring as mo

D, T = datetime.date, datetime.datetime


@pytest.mark.parametrize("n", [1, 2, -1, -2, 4, -4])
def test_sessions_after_and_before(spark, n):
    sessions = [D(2024, 1, k) for k in (3, 4, 8, 9)]
    days = [D(2023, 12, 1), *(D(2024, 1, k) for k in range(1, 13)), D(2024, 3, 1), None]
    df = spark.createDataFrame([(k, d) for k, d in enumerate(days)], "k int, day date")
    got = {r.k: r.session for r in mo.shifted_session(df, spark.createDataFrame([(s,) for s in sessions * 2], "date date"), n, "day").collect()}
    for k, d in enumerate(days):
        left = [] if d is None else [s for s in sessions if s > d] if n > 0 else [s for s in reversed(sessions) if s < d]
        assert got[k] == (left[abs(n) - 1] if len(left) >= abs(n) else None), (d, n)
    with pytest.raises(ValueError):
        mo.shifted_session(df, df, 0, "day")


def test_phases(spark):
    cases = {(9, 14): "closed", (9, 15): "opening_auction", (9, 25): "pause", (9, 30): "continuous", (11, 29): "continuous", (11, 30): "lunch", (13, 0): "continuous", (14, 56): "continuous", (14, 57): "closing_auction", (15, 0): "closed"}
    df = spark.createDataFrame([(h, m, T(2024, 1, 2, h, m)) for h, m in cases], "h int, m int, ts timestamp_ntz")
    assert {(r.h, r.m): r.p for r in df.withColumn("p", mo.phase("ts")).collect()} == cases
    assert {r.p for r in df.select(mo.phase("ts", F.lit(False)).alias("p")).collect()} == {"closed"}


def test_betas_and_their_breaks(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=130)
    rows = [("a", D(2024, 1, 1) + datetime.timedelta(days=k), float((2.0 if k >= 70 else 0.5) * m[k]), float(m[k])) for k in range(130)] + [("b", D(2024, 1, 1) + datetime.timedelta(days=k), float(m[k]), float(m[k])) for k in range(100)]
    betas = mo.beta_windows(spark.createDataFrame(rows, "code string, date date, r double, m double"), "r", "m", 60)
    (r,) = betas.collect()
    assert r.code == "a" and abs(r.current - 2.0 * 60 / 59) < 1e-9 and abs(r.previous - 0.5 * 60 / 59) < 1e-9
    held = spark.createDataFrame([("p", "a", 0.4), ("p", "b", 0.6), ("q", "b", 1.0)], "book string, code string, weight double")
    out = {r.book: r for r in mo.beta_break(held, betas, ["book"]).collect()}
    assert set(out) == {"p"} and out["p"].alert and not mo.beta_break(held, betas, ["book"], 9.0).first().alert


def test_rolling_figures(spark):
    r = np.array([0.1, -0.2, 0.05, 0.3, -0.4, 0.1])
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(r)], "code string, date int, r double")
    got = {x.date: x for x in mo.rolling_figures(df, "r", 4, 0.0, 1.0).collect()}
    for t in range(6):
        if t < 3:
            assert got[t].sharpe is None and got[t].max_dd is None
            continue
        part = r[t - 3 : t + 1]
        c = np.cumprod(1 + part)
        assert abs(got[t].sharpe - part.mean() / part.std(ddof=1)) < 1e-12 and abs(got[t].max_dd - (c / np.maximum.accumulate(c) - 1).min()) < 1e-12
