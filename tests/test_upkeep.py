"""Incremental tables, the alert gateway, streaks, families, clusters and components, against plain versions."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import clusters as cl
from tessera.operators import learning as le
from tessera.operators import limitpool as lp
from tessera.operators.recursion import scan
from tessera.sources import incremental as inc
from tessera.sources.scratch import new_path
from tessera.streaming import alerts as sa
from tessera.streaming import gateway as gw

D, T = datetime.date, datetime.datetime


def means(rows):
    w = Window.partitionBy("code").orderBy(F.unix_date("date")).rangeBetween(-9, 0)
    return rows.select("code", "date", F.avg("close").over(w).alias("m"), F.count("close").over(w).alias("n"))


@pytest.mark.parametrize("seed", [1])
def test_late_rows_bring_the_table_up_to_date(spark, seed):
    rng = np.random.default_rng(seed)
    day = lambda k: D(2024, 1, 1) + datetime.timedelta(days=int(k))
    rows = {(f"c{c}", day(k)): float(rng.normal()) for c in range(4) for k in range(90) if rng.random() < 0.8}
    frame = lambda d: spark.createDataFrame([(c, t, v) for (c, t), v in d.items()], "code string, date date, close double")
    table = inc.IncrementalTable(spark, new_path(spark, "s"), new_path(spark, "d"), means, 9, ["code", "date"])
    table.create(frame(rows))
    for _ in range(2):
        late = {(f"c{rng.integers(0, 5)}", day(rng.choice([40, 41, 55, 95]))): float(rng.normal()) for _ in range(6)}
        rows |= late
        days = table.merge(frame(late))
        assert days == sorted({t for _, t in late})
        before = {f: m for f, m in stamps(spark, table.derived).items()}
        spans = table.recompute(days)
        same = lambda f: not any(lo <= D.fromisoformat(f.split("day=")[1][:10]) <= hi for lo, hi in spans)
        after = stamps(spark, table.derived)
        assert {f for f in before if same(f)} == {f for f in after if same(f)} and all(f not in after for f in before if not same(f))
        read = [r[0].split("day=")[1][:10] for r in table.inputs(days).select(F.input_file_name()).distinct().collect()]
        assert read and all(any(lo <= D.fromisoformat(d) <= hi for lo, hi in table.spans(days)[1]) for d in read) and min(read) >= str(min(days) - datetime.timedelta(days=9))
        assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, means(frame(rows)).collect()))
    assert table.merge(frame(rows).limit(0)) == [] and table.recompute([]) == []


def stamps(spark, path):
    return {f: True for f in spark.read.parquet(path).inputFiles()}


def test_spans_and_bars(spark):
    assert inc.merged([(D(2024, 1, 5), D(2024, 1, 6)), (D(2024, 1, 1), D(2024, 1, 2)), (D(2024, 1, 3), D(2024, 1, 3)), (D(2024, 1, 9), D(2024, 1, 9))]) == [(D(2024, 1, 1), D(2024, 1, 3)), (D(2024, 1, 5), D(2024, 1, 6)), (D(2024, 1, 9), D(2024, 1, 9))]
    old = spark.createDataFrame([("a", T(2024, 1, 1, 9), 1), ("a", T(2024, 1, 2, 9), 2), ("b", T(2024, 1, 2, 9), 3), ("b", T(2024, 1, 1, 9), 4)], "code string, ts timestamp, n int")
    new = spark.createDataFrame([("a", T(2024, 1, 2, 9), 9), ("a", T(2024, 1, 1, 9), 8)], "code string, ts timestamp, n int")
    got = {(r.code, r.ts.day): r.n for r in inc.merge_bars(old, new, ["code"], "ts", D(2024, 1, 2)).collect()}
    assert got == {("a", 1): 8, ("a", 2): 9, ("b", 1): 4}


def plain_gateway(rows, rules):
    sent, state = [], {}
    for channel, i, ts, mark, level in sorted(rows, key=lambda r: (r[2], r[1])):
        last, hour, n = state.get(channel, ({}, None, 0))
        now = ts.replace(minute=0, second=0, microsecond=0)
        if (now == hour and n >= rules.cap) or ((ts.hour >= 23 or ts.hour < 8) and level != "danger"):
            continue
        if mark in last and (ts - last[mark]).total_seconds() < rules.gap:
            continue
        state[channel] = ({**(last if rules.each else {}), mark: ts}, now, n + 1 if now == hour else 1)
        sent.append(i)
    return sorted(sent)


def floods(n, seed):
    rng = np.random.default_rng(seed)
    start = T(2024, 3, 1)
    return [(f"ch{rng.integers(0, 3)}", k, start + datetime.timedelta(seconds=int(rng.integers(0, 3 * 86400))), f"sig{rng.integers(0, 4)}", str(rng.choice(["info", "danger"]))) for k in range(n)]


ALERTS = "channel string, id long, ts timestamp_ntz, signature string, level string"


@pytest.mark.parametrize("each", [False, True])
def test_gateway_stream_equals_batch_over_triggers_and_a_restart(spark, each):
    rules = gw.Rules(cap=4, each=each)
    rows = sorted(floods(900, 5), key=lambda r: r[2])
    want = plain_gateway(rows, rules)
    assert 0 < len(want) < 700
    assert sorted(r.id for r in gw.gateway(spark.createDataFrame(rows, ALERTS).repartition(5), rules).collect()) == want
    source, out, offsets = (new_path(spark, n) for n in ("alerts", "sent", "offsets"))
    schema = spark.createDataFrame([], ALERTS).withColumn("ts", F.col("ts").cast("timestamp")).schema
    for k in range(6):
        part = spark.createDataFrame(rows[150 * k : 150 * (k + 1)], ALERTS).withColumn("ts", F.col("ts").cast("timestamp"))
        part.coalesce(1).write.mode("append").parquet(source)
        if k in (2, 5):  # two runs, the second from the first one's checkpoint
            got = sa.drain(gw.gateway(sa.stream(spark, source, schema), rules), out, offsets)
    assert sorted(r.id for r in got.collect()) == want


def test_gateway_forgets_idle_channels(spark):
    source, out, offsets = (new_path(spark, n) for n in ("alerts", "sent", "offsets"))
    schema = spark.createDataFrame([], ALERTS).withColumn("ts", F.col("ts").cast("timestamp")).schema
    days = [[(f"old{k}", k, T(2024, 3, 1, 12), "s", "info") for k in range(20)], [("new", 100, T(2024, 3, 5, 12), "s", "info")], [("new", 101, T(2024, 3, 6, 12), "s", "info")], [("new", 102, T(2024, 3, 6, 13), "s", "info")]]
    for rows in days:
        spark.createDataFrame(rows, ALERTS).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
    query = gw.gateway(sa.stream(spark, source, schema)).writeStream.format("parquet").option("checkpointLocation", offsets).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) >= 20 and held[-1] <= 1
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [*range(20), 100, 101]


def test_signatures_leave_prices_out(spark):
    texts = ["002714|x|38.37 up 2.5% of 12.3亿", "002714|x|38.47 up 3.5% of 9.1亿", "002715|x|38.37 up 2.5% of 12.3亿"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(gw.signature(gw.normalized(F.col("t")))).collect()]
    assert got[0] == got[1] != got[2] and len(got[0]) == 12


@pytest.mark.parametrize("parts", [1, 5])
def test_streaks_carry(spark, parts):
    rng = np.random.default_rng(9)
    rows = [(c, D(2024, 1, 1) + datetime.timedelta(days=k), int(rng.random() < p)) for c, p in (("a", 0.5), ("b", 0.9), ("c", 0.05), ("d", 1.0)) for k in range(60)]
    df = scan(spark.createDataFrame(rows, "code string, date date, flag int"), [lp.locked_streak("flag")], parts=parts)
    got = {(r.code, r.date): r.streak for r in df.collect()}
    for code in "abcd":
        streak, before = 0, False
        for c, t, flag in rows:
            if c == code:
                streak = (streak + 1 if before else 1) if flag else streak
                before = bool(flag)
                assert got[c, t] == streak


def plain_ward(d):
    """Merges by looking at all pairs each time."""
    d = {(i, j): d[i, j] for i in range(len(d)) for j in range(i + 1, len(d))}
    size = {k: 1 for k in {i for pair in d for i in pair}}
    at = lambda x, y: d[min(x, y), max(x, y)]
    out = []
    while len(size) > 1:
        (a, b) = min(((i, j) for i in size for j in size if i < j), key=lambda p: (at(*p), p))
        h = at(a, b)
        out.append((a, b, h))
        for k in size:
            if k not in (a, b):
                total = size[a] + size[b] + size[k]
                d[min(a, k), max(a, k)] = np.sqrt(((size[a] + size[k]) * at(a, k) ** 2 + (size[b] + size[k]) * at(b, k) ** 2 - size[k] * h**2) / total)
        size[a] += size.pop(b)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_ward_merges_as_the_plain_way(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(15, 4))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got, want = cl.ward_merges(d), plain_ward(d)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] and np.allclose([h for *_, h in got], [h for *_, h in want])
    for threshold in (0.0, 1.0, 2.0, 99.0):
        label = list(range(15))
        for a, b, h in want:
            if h <= threshold:
                label = [label[a] if v == label[b] else v for v in label]
        names = {v: k for k, v in enumerate(dict.fromkeys(label))}
        assert cl.families(d, threshold).tolist() == [names[v] for v in label]


def test_families_by_group(spark):
    pairs = [(2024, "a", "b", 0.95), (2024, "c", "d", -0.9), (2024, "a", "c", 0.1), (2025, "a", "b", None), (2025, "c", "d", 0.99)]
    df = spark.createDataFrame(pairs, "year int, a string, b string, rho double")
    got = {(r.year, r.factor): r.family for r in cl.hierarchical(df, 0.5, ["a", "b", "c", "d", "e"], ["year"]).collect()}
    assert got == {(2024, "a"): 0, (2024, "b"): 0, (2024, "c"): 1, (2024, "d"): 1, (2024, "e"): 2, (2025, "a"): 0, (2025, "b"): 1, (2025, "c"): 2, (2025, "d"): 2, (2025, "e"): 3}
    chosen = {(r.year, r.factor): r.chosen for r in cl.greedy(df, ["a", "b", "c", "d"], 0.7, ["year"]).collect()}
    assert chosen[2024, "b"] == "a" and chosen[2024, "d"] == "c" and chosen[2025, "b"] == "b" and chosen[2025, "d"] == "c"
    scores = spark.createDataFrame([(2024, "a", 0.2), (2024, "b", -0.7), (2024, "c", None)], "year int, factor string, score double")
    rows = {(r.year, r.factor): r for r in cl.representatives(cl.hierarchical(df, 0.5, None, ["year"]), scores, by=["year"]).collect()}
    assert rows[2024, "b"].representative and not rows[2024, "a"].representative and rows[2024, "a"].size == 2 and rows[2024, "c"].place == 1
    assert cl.hierarchical(df.limit(0)).count() == 0


def lloyd(x, centres, most):
    for _ in range(most):
        at, _ = le.nearest(x, centres)
        centres = np.array([x[at == k].mean(0) if (at == k).any() else centres[k] for k in range(len(centres))])
    return centres, le.nearest(x, centres)[1].sum()


def test_kmeans_is_no_worse_than_lloyd(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(60, 5)) + 6 * rng.normal(size=5) for _ in range(6)])
    rows = [(k, v.tolist(), "kept") for k, v in enumerate(x)] + [(900, None, "bad"), (901, [1.0, None, 0.0, 0.0, 0.0], "bad"), (902, [float("nan")] * 5, "bad"), (903, [1.0], "bad")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string").repartition(4)
    got, centres, costs = le.kmeans(df, 6, size=5, start=x[:6])
    _, want = lloyd(x, x[:6], 30)
    found = got.collect()
    assert len(found) == 360 and sum(r.distance for r in found) <= want * (1 + 1e-4) and all(a >= b for a, b in zip(costs, costs[1:]))
    assert all(le.nearest(np.array([r.embedding]), centres)[0][0] == r.cluster for r in found)
    _, seeded, costs = le.kmeans(df, 6)
    assert len(seeded) == 6 and costs[-1] <= 1.05 * min(lloyd(x, x[rng.choice(360, 6, False)], 20)[1] for _ in range(20))
    again = le.kmeans(df.repartition(7), 6)[1]
    assert np.allclose(seeded, again)
    assert le.kmeans(df.limit(0), 3)[0].count() == 0 and len(le.kmeans(df.where("vec_id < 2"), 5)[1]) == 2


def test_components_equal_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 1000
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got, axes, shares = le.principal_components(df, 2)
    u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    v = v * np.sign(v[np.arange(6), np.abs(v).argmax(1)])[:, None]
    assert np.allclose(axes, v[:2], atol=1e-7) and np.allclose(shares, (s**2 / (s**2).sum())[:2])
    scores = np.array([r.components for r in got.orderBy("vec_id").collect()])
    assert np.allclose(scores, (x - x.mean(0)) @ v[:2].T, atol=1e-6)
    assert le.principal_components(df.limit(0), 2)[0].count() == 0
