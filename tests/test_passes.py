"""Windows and recursions over the same sorted rows: one shuffle, and the same values however the rows come in batches."""

import numpy as np
import pyarrow as pa

from tessera.operators import chartseries, rolled
from tessera.operators import recursion as rc


def _parts(table, size):
    return iter([table.slice(k, size) for k in range(0, table.num_rows, size)])


def test_recursions_and_windows_go_on_over_batches():
    rng = np.random.default_rng(5)
    key = [None] * 9 + [1] * 40 + [2] + [3] * 23
    x = [None if rng.random() < 0.1 else float(rng.normal(50, 5)) for _ in key]
    table = pa.table({"code": pa.array(key, pa.int64()), "x": pa.array(x, pa.float64())})
    lines = [rc.macd("x", ("fast", "slow", "dea")), rc.ewm_adjusted("x", 1 / 3, "k"), rc.ewm_adjusted("k", 1 / 3, "d"), rc.running_sum("x", "total"), rc.kalman("x", None, ("state", "std"))]
    specs = {"gap": (np.subtract, ("fast", "slow"), 0), "top": ("max", "gap", 5), "slope": ("slope", "total", 4), "fall": ("fall", "x", 3), "off": ("deviation", "x", 3), "oldest": ("first", "total", 6)}
    columns = [*table.column_names, *(c for r in lines for c in r.outputs)]

    def made(size):
        tables = rolled._windows(specs, columns, "code")(rc.carried_on(_parts(table, size), lines, "code"))
        return pa.concat_tables(tables).to_pandas()

    whole = made(1000)
    for size in (1, 2, 7, 30):
        assert made(size).equals(whole), size
    one = np.array(x[9:49], float)
    assert np.allclose(whole["total"][9:49][~np.isnan(one)], np.nancumsum(one)[~np.isnan(one)])
    total = whole["total"].to_numpy()
    assert np.isclose(whole["slope"][20], np.polyfit(range(4), total[17:21], 1)[0]) and np.isnan(whole["slope"][10])
    assert whole["oldest"][20] == total[15] and whole["oldest"][11] == total[9]
    for at in range(51, 73):
        w = np.array(x[at - 2 : at + 1], float)
        if at > 51 and not np.isnan(w).any():
            assert np.isclose(whole["fall"][at], min(0, *(w / np.maximum.accumulate(w) - 1))) and np.isclose(whole["off"][at], abs(w - w.mean()).mean())


def test_chart_series_deal_the_bars_once(spark):
    bars = "open double, high double, low double, close double, volume double, amount double, turnover double"
    rows = chartseries.chart_series(spark.createDataFrame([], f"code int, date int, {bars}"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 0


def test_volume_profile_deals_its_bars_once(spark):
    from tessera.operators import statistics as st

    bars = [(1, 9.0, 12.0, 10.0), (1, 10.1, 10.2, 3.0), (None, 10.0, 10.4, 5.0), (2, 7.0, 7.1, 0.0)]
    rows = st.volume_profile(spark.createDataFrame(bars, "code int, low double, high double, volume double"), 0.05)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(code" in plan
    want = {}
    for k, low, high, v in bars:
        a, b = (int(np.floor(np.log(x) / np.log(1.05))) for x in (low, high))
        for cell in range(a, b + 1):
            want[k, cell] = want.get((k, cell), 0.0) + v / (b - a + 1)
    got = {(r.code, r.cell): r.volume for r in rows.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_kalman_smoother_goes_both_ways_over_rows_dealt_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(k, t, None if rng.random() < 0.1 and t else float(rng.normal(20, 2))) for k, n in ((None, 12), (1, 1), (2, 60), (3, 25)) for t in range(n)]
    df = spark.createDataFrame(rows, "code int, date int, y double").repartition(5)
    copies, stored = [], rc.stored
    monkeypatch.setattr(rc, "stored", lambda rows, name: copies.append(name) or stored(rows, name))
    found = lambda **more: {(r.code, r.date): (r.state, r.state_std, r.smooth) for r in rc.kalman_smooth(df, "y", **more).collect()}
    whole = found()
    assert len(copies) == 1 and len(whole) == len(rows)
    for k in (None, 1, 2, 3):  # the last row has nothing after it
        n = sum(r[0] == k for r in rows)
        assert whole[k, n - 1][2] == whole[k, n - 1][0]
    cut = found(parts=3)
    monkeypatch.setattr(rc, "WHOLE", 30)
    for other in (cut, found()):
        assert all(abs(a - b) < 1e-9 for k in whole for a, b in zip(whole[k], other[k]))
