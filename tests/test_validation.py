"""Barriers, folds, paths, walk-forward, deflation and forests, against direct versions."""

import datetime
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.expr import rolling
from tessera.operators import trees as tr
from tessera.operators import validation as va

D = datetime.date


def test_no_training_time_touches_a_test_run(spark):
    df = spark.createDataFrame([(D(2024, 1, 1) + datetime.timedelta(days=k), k) for k in range(60)], "date date, place int")
    rows = va.combinatorial_folds(df, 6, 2, 3, 2).join(df, "date").collect()
    by = {}
    for r in rows:
        by.setdefault(r.combo, {"train": [], "test": []})[r.part].append(r.place)
    assert len(by) == 15 and all(len(v["test"]) == 20 for v in by.values())
    for v in by.values():
        test = set(v["test"])
        assert not any(t + k in test for t in v["train"] for k in range(-2, 4))  # 3 before, 2 after
        left = [t for t in range(60) if t not in test and not any(t + k in test for k in range(-2, 4))]
        assert sorted(v["train"]) == left
    paths = {}
    for r in va.test_paths(spark, 6, 2).collect():
        paths.setdefault(r.path, {})[r.block] = r.combo
    held = list(itertools.combinations(range(1, 7), 2))
    assert len(paths) == 5 and all(set(p) == set(range(1, 7)) and all(b in held[c] for b, c in p.items()) for p in paths.values())
    assert len({(b, c) for p in paths.values() for b, c in p.items()}) == 30


def test_barriers(spark):
    bars = [(100, 101, 99), (100, 104, 98), (100, 112, 97), (100, 111, 89), (100, 100, 100), (100, 100, 80), (100, 100, 100)]
    df = spark.createDataFrame([("a", D(2024, 1, 1) + datetime.timedelta(days=k), float(c), float(h), float(l)) for k, (c, h, l) in enumerate(bars)], "code string, date date, close double, high double, low double")
    got = [(r.barrier, r.held) for r in va.first_touch(df, 0.1, 0.1, 3).orderBy("date").collect()]
    assert got == [(1, 2), (1, 1), (-1, 1), (-1, 2), (-1, 1), (None, None), (None, None)]


def test_walk_forward_equals_a_loop(spark):
    rng = np.random.default_rng(2)
    prices = {c: 50 + np.cumsum(rng.normal(size=n)) * 0.5 for c, n in (("a", 130), ("b", 77), ("c", 20))}
    df = spark.createDataFrame([(c, D(2024, 1, 1) + datetime.timedelta(days=k), float(v)) for c, x in prices.items() for k, v in enumerate(x)], "code string, date date, close double").repartition(4)
    grid = [{"n": 2}, {"n": 5}, {"n": 9}]
    position = lambda w, p: F.when(F.col("close") > rolling("close", "mean", w, p["n"]), 1.0).otherwise(0.0)
    chosen, returns = va.walk_forward(df, position, grid, 40, 20, 15, 3, 0.001, 250.0)

    def ret(x, n):
        pos = np.array([1.0 if t >= n - 1 and x[t] > x[t - n + 1 : t + 1].mean() else 0.0 for t in range(len(x))])
        held = np.append(0.0, pos[:-1])
        return held * np.append(0.0, x[1:] / x[:-1] - 1) - np.abs(np.diff(held, prepend=0.0)) * 0.001

    want, out = {}, {}
    for c, x in prices.items():
        for w in range(100):
            lo = w * 15
            if lo + 63 > len(x):
                break
            score = []
            for g in grid:
                r = ret(x[lo : lo + 40], g["n"])[:-3]
                s = r.std(ddof=1) * np.sqrt(250)
                score.append(r.mean() * 250 / s if s >= 1e-12 else 0.0)
            want[c, w] = int(np.argmax(score)), max(score)
            for k, v in enumerate(ret(x[lo + 43 : lo + 63], grid[want[c, w][0]]["n"])):
                out.setdefault((c, D(2024, 1, 1) + datetime.timedelta(days=lo + 43 + k)), []).append(v)
    got = {(r.code, r.window): (r.choice, r.score) for r in chosen.collect()}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    traded = {(r.code, r.date): r.ret for r in returns.collect()}
    assert set(traded) == set(out) and all(abs(traded[k] - np.mean(v)) < 1e-12 for k, v in out.items())


def test_deflation(spark):
    z, p = va.deflated(0.1, 1, 250)
    assert abs(z - 0.1 / np.sqrt((1 + 0.5 * 0.01) / 249)) < 1e-12 and 0.05 < p < 0.06
    assert va.deflated(0.1, 100, 250)[0] < z and va.deflated(0.1, 0, 250) == (0.0, 1.0) and abs(va.expected_best(100) - 2.53) < 0.01
    for ratio, trials, skew, kurt in ((0.1, 1, 0.0, 3.0), (0.05, 50, -0.5, 6.0), (1.5, 10, 0.2, 4.0)):
        n = va.least_length(ratio, 0.95, trials, skew, kurt)
        enough = lambda m: va.deflated(ratio, trials, m, skew, kurt)[1] <= 0.05 + 1e-9
        assert enough(n) and (n == 2 or not enough(n - 1))
    with pytest.raises(ValueError):
        va.least_length(-0.1)
    rng = np.random.default_rng(0)
    x = rng.normal(0.05, 1, 400)
    (r,) = va.deflated_sharpe(spark.createDataFrame([("a", float(v)) for v in x] + [("a", None)], "code string, ret double"), 5).collect()
    d = x - x.mean()
    assert abs(r.z - va.deflated(x.mean() / x.std(ddof=1), 5, 400, (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2)[0]) < 1e-9


def exact(x, y, least):
    """The best split of all, by trying each value of each feature."""
    best = None
    for j in range(x.shape[1]):
        for t in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= t
            if min(left.sum(), (~left).sum()) < least:
                continue
            gain = ((y - y.mean()) ** 2).sum() - sum(((y[m] - y[m].mean()) ** 2).sum() for m in (left, ~left))
            if best is None or gain > best[0] * (1 + 1e-9):
                best = (gain, j, t)
    return best


def test_splits_equal_exact_search(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (240, 3)).astype(float)
    y = (x[:, 1] > 5) * 2.0 + (x[:, 0] > 8) * (x[:, 1] <= 5) + 0.1 * rng.normal(size=240)
    df = spark.createDataFrame([(k, *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y))] + [(999, 1.0, 1.0, 1.0, None)], "id long, a double, b double, c double, y double").repartition(4)
    forest = tr.fit(df, ["a", "b", "c"], "y", "id", trees=1, depth=2, bins=64, least=5, tried=3, bootstrap=False)
    masks = [np.ones(240, bool)]
    for node in range(3):
        gain, j, t = exact(x[masks[node]], y[masks[node]], 5)
        assert forest.feature[0, node] == j and forest.threshold[0, node] == t and abs(forest.gain[0, node] - gain) < 1e-8
        masks += [masks[node] & (x[:, j] <= t), masks[node] & (x[:, j] > t)]
    got = {r.id: r.prediction for r in tr.predict(df, forest).collect()}
    for node in range(3, 7):
        assert all(abs(got[k] - y[masks[node]].mean()) < 1e-9 for k in np.flatnonzero(masks[node]))


def test_forest_learns_and_takes_holes(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(3000):
        a, b = rng.normal(size=2)
        p = 0.9 if a * b > 0 else 0.1
        rows.append((k, None if rng.random() < 0.05 else float(a), float(b), 1.0, int(rng.random() < p)))
    df = spark.createDataFrame(rows, "id long, a double, b double, flat double, prediction int").repartition(4)
    forest = tr.fit(df.where("id < 2000"), ["a", "b", "flat"], "prediction", "id", trees=15, depth=5, tried=2)
    again = tr.fit(df.where("id < 2000").repartition(7), ["a", "b", "flat"], "prediction", "id", trees=15, depth=5, tried=2)
    assert (forest.feature == again.feature).all() and np.allclose(forest.value, again.value)
    out = tr.predict(df.where("id >= 2000 AND a IS NOT NULL").withColumnRenamed("prediction", "y"), forest).collect()
    assert np.mean([(r.prediction > 0.5) == (r.y == 1) for r in out]) > 0.8
    shares = forest.importance()
    assert shares["flat"] == 0 and abs(sum(shares.values()) - 1) < 1e-9
    nothing = tr.fit(df.limit(0), ["a", "b", "flat"], "prediction", "id", trees=2, depth=2)
    assert (nothing.feature == -1).all() and tr.predict(df.limit(5), nothing, "p").agg(F.sum("p")).first()[0] == 0.0
