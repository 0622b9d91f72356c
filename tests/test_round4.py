"""What a reviewer found in the fourth round."""


def test_two_means_that_meet_keep_the_weights_order(spark):
    """After 0, x, 0, 0 both means are 4 x / 27, so a last bit decides whether the first is above the second: they are
    added up with weights 1 / 3 and 2 / 3, as the SQL has them."""
    from tessera.operators import recursion as rc

    rows, want = [], {}
    for key in range(200):
        k = d = None
        for t, x in enumerate([None, 0.0, 20 + key * 0.37, 0.0, 0.0, 55.5]):
            if x is not None:
                k = x if k is None else 2.0 / 3 * k + 1.0 / 3 * x
                d = k if d is None else 2.0 / 3 * d + 1.0 / 3 * k
            rows.append((key, t, x))
            want[key, t] = (k, d)
    got = rc.scan(spark.createDataFrame(rows, "code int, date int, x double"), [rc.twice_smoothed("x", ("k", "d"))])
    assert {(r.code, r.date): (r.k, r.d) for r in got.collect()} == want


def _bars(spark, rng):
    """Keys of several lengths with missing, zero and flat values."""
    rows = []
    for key, n in ((None, 70), (1, 1), (2, 130), (3, 9), (4, 66), (5, 64)):
        for t in range(n):
            low = 10.0 if key == 5 else float(rng.normal(50, 9))
            gap = lambda x: None if key != 5 and rng.random() < 0.01 else x
            rows.append((key, t, gap(low + 0.5), gap(low + 1.0), gap(low), gap(low + 0.25), gap(float(rng.integers(0, 4))), gap(0.0 if rng.random() < 0.02 else float(rng.integers(1, 900)))))
    return spark.createDataFrame(rows, "code long, date int, open double, high double, low double, close double, volume double, amount double").repartition(5)


def test_registered_factors_by_arrays_are_those_by_windows(spark):
    import numpy as np

    from tessera.functions import factors as fz
    from tessera.operators.rolled import rolled, sorted_by

    names = sorted(fz.FACTORS)
    df = _bars(spark, np.random.default_rng(2))
    got = {(r.code, r.date): r for r in rolled(sorted_by(df, "code", "date"), fz.rolled_windows(names), keep=names).collect()}
    want = fz.with_factors(df, names).collect()
    assert len(got) == len(want) == 340
    for r in want:
        for n in names:
            a, b = got[r.code, r.date][n], r[n]
            assert (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-12 * max(1, abs(b))), (n, r.code, r.date, a, b)
    assert all(any(r[n] is not None for r in want) for n in names)


def test_registry_moves_blocks_instead_of_rows(spark, tmp_path):
    """No window but that of the later return, one deal of the bars by key, and a row a time and set of columns in the deal by time;
    a factor that has only a column is there too."""
    from pyspark.sql import functions as F

    from tessera.functions import factors as fz
    from tessera.operators import evaluation as ev
    from tessera.plans.queries import QUERIES

    data = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    old = QUERIES["factor_registry_ic"](spark, data)
    assert sum(line.lstrip(" :+-").startswith("Window") for line in plan(old).splitlines()) == 1
    fz.register("later_mom_5", "momentum", -1)(lambda w: fz.pct_change("close", w, 5))
    try:
        rows = {r.factor: r for r in QUERIES["factor_registry_ic"](spark, data).collect()}
    finally:
        del fz.FACTORS["later_mom_5"]
    assert len(rows) == 101 and rows["later_mom_5"].mean == -rows["mom_5"].mean
    df = spark.createDataFrame([(t, float(k), None if k % 7 == 0 else k % 5 * 1.0) for k in range(300) for t in (1, None)], "date int, a double, forward double").coalesce(1)
    sets = ev.sets_of(["a"], "forward", 25)
    blocks = ev._ranked(df, ["a", "forward"], "date", ev.dealt(sets, "date", "int", "forward"))
    assert blocks.count() == 2 and ev.rank_ics_of(blocks, sets).agg(F.sum("n")).first()[0] == 2 * 257


def test_factor_families_deal_blocks_and_rank_as_windows_do(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tessera.functions import factors as fz
    from tessera.operators import evaluation as ev
    from tessera.plans.queries import QUERIES

    assert set(fz.rolled_windows(["range_10"])) == {"__span", "range_10"}
    rng = np.random.default_rng(3)
    value = lambda: None if (u := rng.random()) < 0.1 else float("nan") if u < 0.15 else float(rng.integers(-4, 5))
    df = spark.createDataFrame([(t, *(value() for _ in range(3)), 1.0, value()) for t in range(5) for _ in range(30 if t else 6)], "date int, a double, b double, c double, flat double, forward double")
    names = ["a", "b", "c", "flat"]
    found = ev.rank_correlations(ev._ranked(df, [*names, "forward"], "date", ev.dealt([[*names, "forward"]], "date", "int")), [*names, "forward"]).toPandas()
    pairs = found[found.b != "forward"].groupby(["a", "b"]).rho.agg(["mean", "size"])
    want = {(r.a, r.b): (r.rho, r.times) for r in ev.factor_correlation(df, names, least=1).collect()}
    assert {k for k in want} == set(pairs.index) and all(abs(pairs.loc[k, "mean"] - v[0]) < 1e-12 and pairs.loc[k, "size"] == v[1] for k, v in want.items())
    long = df.unpivot(["date", "forward"], names, "factor", "value").where("value is not null")
    ics = {(r.factor, r.date): (round(r.ic, 9), r.n) for r in ev.rank_ic(long, "value", "forward", least=1, by=("factor",)).where("ic is not null").collect()}
    assert ics == {(r.a, r.date): (round(r.rho, 9), r.n) for r in found[found.b == "forward"].itertuples()}

    seen = []
    from tessera.plans.queries import clustering

    real = clustering.stored
    clustering.stored = lambda rows, name: seen.append(rows._jdf.queryExecution().optimizedPlan().toString()) or real(rows, name)
    try:
        assert QUERIES["ev_factor_families"](spark, "/root/testdata/sf0.001").agg(F.count("*")).first()[0] == 8
    finally:
        clustering.stored = real
    assert len(seen) == 1 and sum(line.lstrip(" :+-").startswith("Window") for line in seen[0].splitlines()) == 1
