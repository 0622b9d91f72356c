"""Recursions along a key of any length, as parallel prefix scans.

A recursion such as an exponentially weighted mean or a Kalman filter is a sequence of steps that compose
associatively. A key's rows are cut into blocks (consecutive ranges of a range sort), every block's steps are joined
side by side into one element, the elements of a key's blocks are chained, and every block is run again from the
element of all that came before it. So a key that holds most rows is spread over as many tasks as it has blocks;
what runs in one task per key is a row a block.

Within a block a scan is a balanced tree over numpy arrays, so each level is a few array operations.

Keys of up to WHOLE rows aren't cut: each task holds some of them together, sorted, and takes the first row of all
of them, then the second, and so on, so that a step is one array operation for all and states are those of the plain recursion.

Rows of a key must differ in time: equal times are run in any order. Null keys are one key, null times come first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import stored

Rows = dict[str, np.ndarray]

#: Rows of the longest key that one task takes whole, rows that are run together, and rows of a key up to which it is run row by row.
WHOLE, BATCH, STEPS = 1 << 17, 1 << 16, 1 << 11


@dataclass(frozen=True)
class Recursion:
    """``elements`` of ``width`` numbers for each row of ``inputs``; ``join(earlier, later)`` of arrays of elements;
    ``finish`` makes the output columns from the joined elements of all rows up to each one. ``begin`` may give an
    element that goes before a key's first block, from that block's rows."""

    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    width: int
    elements: Callable[[Rows], np.ndarray]
    join: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], tuple[np.ndarray, ...]]
    begin: Callable[[Rows], np.ndarray] | None = None
    #: ``join`` of all that came before and one row, where that has a plainer form.
    follow: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None


def joined(elements: np.ndarray, join: Callable) -> np.ndarray:
    """All elements in order as one."""
    while len(elements) > 1:
        pairs = join(elements[:-1:2], elements[1::2])
        elements = np.concatenate([pairs, elements[-1:]]) if len(elements) % 2 else pairs
    return elements[0]


def prefixes(elements: np.ndarray, join: Callable) -> np.ndarray:
    """The join of all elements up to each one."""
    if len(elements) < 2:
        return elements
    odd = prefixes(join(elements[:-1:2], elements[1::2]), join)
    out = np.empty_like(elements)
    out[0], out[1::2] = elements[0], odd
    later = elements[2::2]
    if len(later):
        out[2::2] = join(odd[: len(later)], later)
    return out


def _rows(table: pa.Table, columns: tuple[str, ...]) -> Rows:
    return {c: table.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for c in columns}


def blocks(df: DataFrame, key: str, time: str, parts: int | None = None) -> DataFrame:
    """``df``, stored, with ``__block``: blocks of a key ascend in time and have the rows of one range partition."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(key).asc_nulls_first(), F.col(time).asc_nulls_first()]
    return stored(df.repartitionByRange(parts, *order).withColumn("__block", F.spark_partition_id()), "blocks")


def _key_starts(column: pa.ChunkedArray) -> np.ndarray:
    """Where a key begins in a sorted column."""
    ids = column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))


def _whole_keys(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of some BATCH rows that part no key; rows are sorted by it."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BATCH:
            table = pa.Table.from_batches(held)
            cut = int(_key_starts(table.column(key))[-1])
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            size -= cut
    if size:
        yield pa.Table.from_batches(held)


def _stepped(r: Recursion, rows: Rows, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The joined elements of each key's rows up to each one, row by row for all keys at once. ``before`` is that of the first
    key's earlier rows."""
    elements = r.elements(rows)
    out = np.empty_like(elements)
    order = np.argsort(-lengths, kind="stable")
    at, n = starts[order], lengths[order]
    state = elements[at]
    if r.begin:
        state = r.join(np.array([r.begin({c: rows[c][a : a + k] for c in r.inputs}) for a, k in zip(at.tolist(), n.tolist())]), state)
    if before is not None:
        state[order == 0] = (r.follow or r.join)(before[None], elements[:1])
    out[at] = state
    long = int((n > STEPS).sum())
    for k in range(long):
        out[at[k] : at[k] + n[k]] = prefixes(np.concatenate([state[k : k + 1], elements[at[k] + 1 : at[k] + n[k]]]), r.join)
    at, n, state = at[long:], n[long:], state[long:]
    active = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), side="right")  # keys with at least that many rows
    for t in range(1, len(active)):
        now = at[: active[t]] + t
        state = (r.follow or r.join)(state[: active[t]], elements[now])
        out[now] = state
    return out


def carried_on(tables: Iterator[pa.Table], recursions: list[Recursion], key: str) -> Iterator[pa.Table]:
    """Tables of sorted rows, in which a key may go on from one to the next, with the recursions' outputs; each recursion may use
    those before it."""
    last: pa.Array | None = None
    states: list[np.ndarray] = []
    for table in tables:
        column = table.column(key)
        starts = _key_starts(column)
        goes_on = last is not None and len(_key_starts(pa.chunked_array([last, column[:1].combine_chunks()]))) == 1
        rows = _rows(table, tuple(dict.fromkeys(c for r in recursions for c in r.inputs if c in table.column_names)))
        found: list[np.ndarray] = []
        out = {c: table.column(c) for c in table.column_names}
        for k, r in enumerate(recursions):
            elements = _stepped(r, rows, starts, np.diff(np.append(starts, table.num_rows)), states[k] if goes_on else None)
            found.append(elements[-1])
            rows |= dict(zip(r.outputs, r.finish(elements)))
            out |= {c: pa.array(rows[c], pa.float64(), from_pandas=True) for c in r.outputs}
        last, states = column[-1:].combine_chunks(), found
        yield pa.table(out)


def _scan_whole(df: DataFrame, recursions: list[Recursion], key: str, time: str, reverse: bool, back: list[Recursion]) -> DataFrame:
    outputs = [c for r in (*recursions, *back) for c in r.outputs]
    inputs = tuple(dict.fromkeys(c for r in (*recursions, *back) for c in r.inputs if c in df.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches, key):
            starts = _key_starts(table.column(key))
            lengths = np.diff(np.append(starts, table.num_rows))
            rows = _rows(table, inputs)
            out = {c: table.column(c) for c in table.column_names}
            made = dict(x for r in recursions for x in zip(r.outputs, r.finish(_stepped(r, rows, starts, lengths))))
            if back:
                turned = {c: x[::-1] for c, x in (rows | made).items()}
                ends = (table.num_rows - starts - lengths)[::-1]
                made |= {c: x[::-1] for r in back for c, x in zip(r.outputs, r.finish(_stepped(r, turned, ends, lengths[::-1])))}
            out |= {c: pa.array(x, pa.float64(), from_pandas=True) for c, x in made.items()}
            yield from pa.table(out).to_batches(max_chunksize=10_000)

    line = F.col(time).desc_nulls_last() if reverse else F.col(time).asc_nulls_first()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{c}` double" for c in outputs)])
    return df.repartition(key).sortWithinPartitions(F.col(key).asc_nulls_first(), line).mapInArrow(run, schema)


def scan(df: DataFrame, recursions: list[Recursion], key: str = "code", time: str = "date", reverse: bool = False, parts: int | None = None, back: list[Recursion] | None = None) -> DataFrame:
    """``df`` with the recursions' outputs; ``reverse`` runs them from the last row to the first. ``back`` are run afterwards, the
    other way, and may use the others' outputs. With ``parts`` the rows are cut into that many blocks, else only keys of more
    than WHOLE rows are cut."""

    def in_blocks(rows: DataFrame, parts: int | None = None) -> DataFrame:
        rows = _scan_blocks(rows, recursions, key, time, reverse, parts)
        return _scan_blocks(rows, back, key, time, not reverse, parts) if back else rows

    if parts:
        return in_blocks(df, parts)
    df = stored(df, "steps")
    long = [r[0] for r in df.groupBy(key).count().where(F.col("count") > WHOLE).select(key).collect()]  # a key each WHOLE rows at most
    if not long:
        return _scan_whole(df, recursions, key, time, reverse, back or [])
    is_long = F.coalesce(F.col(key).isin([k for k in long if k is not None]), F.lit(False)) | (F.col(key).isNull() & F.lit(None in long))
    return _scan_whole(df.where(~is_long), recursions, key, time, reverse, back or []).unionByName(in_blocks(df.where(is_long)))


def _scan_blocks(df: DataFrame, recursions: list[Recursion], key: str, time: str, reverse: bool, parts: int | None = None) -> DataFrame:
    df = blocks(df, key, time, parts)
    inputs = tuple(dict.fromkeys(c for r in recursions for c in r.inputs))
    ends = np.cumsum([0, *(r.width for r in recursions)])
    parts_of = [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]
    order = [(time, "descending" if reverse else "ascending")]
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    outputs = [c for r in recursions for c in r.outputs]

    def summary(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        rows = _rows(table, inputs)
        total = np.concatenate([joined(r.elements(rows), r.join) for r in recursions])
        starts = np.concatenate([r.begin(rows) if r.begin else np.full(r.width, np.nan) for r in recursions])
        return pa.table({key: table.column(key)[:1], "__block": table.column("__block")[:1], "__total": [total], "__start": [starts]})

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by([("__block", order[0][1])])
        totals = np.array(table.column("__total").to_pylist(), float)
        first = np.array(table.column("__start")[0].as_py(), float)
        before = np.full_like(totals, np.nan)
        for r, at in zip(recursions, parts_of):
            steps = np.concatenate([first[None, at], totals[:-1, at]]) if r.begin else totals[:-1, at]
            before[len(totals) - len(steps) :, at] = prefixes(steps, r.join) if len(steps) else steps
        first_block = pa.array([k == 0 for k in range(len(totals))])
        return pa.table({key: table.column(key), "__block": table.column("__block"), "__before": pa.array(before.tolist(), pa.list_(pa.float64())), "__first": first_block})

    def run(table: pa.Table, start: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        rows = _rows(table, inputs)
        before, is_first = np.array(start.column("__before")[0].as_py(), float), start.column("__first")[0].as_py()
        out = {c: table.column(c) for c in table.column_names if c != "__block"}
        for r, at in zip(recursions, parts_of):
            elements = r.elements(rows)
            if r.begin or not is_first:
                elements = np.concatenate([before[None, at], elements])
            found = r.finish(prefixes(elements, r.join)[-table.num_rows :])
            out |= {c: pa.array(x, pa.float64(), from_pandas=True) for c, x in zip(r.outputs, found)}
        return pa.table(out)

    small = df.select(key, time, "__block", *(c for c in inputs if c not in (key, time)))
    totals = small.groupBy(key, "__block").applyInArrow(summary, f"`{key}` {kind[key]}, __block int, __total array<double>, __start array<double>")
    before = totals.groupBy(key).applyInArrow(chain, f"`{key}` {kind[key]}, __block int, __before array<double>, __first boolean")
    kept = [c for c in df.columns if c != "__block"]
    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in kept), *(f"`{c}` double" for c in outputs)])
    return df.groupBy(key, "__block").cogroup(before.groupBy(key, "__block")).applyInArrow(run, schema)


def _affine(earlier: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Steps y = a y' + b that give s where nothing came before: (a, b, s), s NaN where they hold no value."""
    a, b = earlier[:, 0] * later[:, 0], later[:, 0] * earlier[:, 1] + later[:, 1]
    s = np.where(np.isnan(earlier[:, 2]), later[:, 2], later[:, 0] * earlier[:, 2] + later[:, 1])
    return np.stack([a, b, s], 1)


def ewm_mean(value: str, alpha: float, name: str) -> Recursion:
    """y = (1 - alpha) y' + alpha x from the first value on (which the weights are not adjusted for); missing values keep
    the state."""

    def elements(rows: Rows) -> np.ndarray:
        x = rows[value]
        known = ~np.isnan(x)
        return np.stack([np.where(known, 1 - alpha, 1.0), np.where(known, alpha * x, 0.0), x], 1)

    return Recursion((value,), (name,), 3, elements, _affine, lambda e: (e[:, 2],))


def running_sum(value: str, name: str) -> Recursion:
    """The sum of all values so far; missing ones add nothing."""
    return linear_chain(value, (name,), [[1.0]], [1.0], [1.0], lambda before, added: [before[0] + added[0]])


def _decayed(earlier: np.ndarray, later: np.ndarray) -> np.ndarray:
    return np.concatenate([earlier[:, :1] * later[:, :1], earlier[:, 1:] * later[:, :1] + later[:, 1:]], 1)


def ewm_adjusted(value: str, alpha: float, name: str) -> Recursion:
    """The mean with weights (1 - alpha)^age over all values so far; a missing value ages the others."""

    def elements(rows: Rows) -> np.ndarray:
        known = ~np.isnan(rows[value])
        return np.stack([np.full(len(known), 1 - alpha), np.where(known, rows[value], 0.0), known.astype(float)], 1)

    return Recursion((value,), (name,), 3, elements, _decayed, lambda e: (np.divide(e[:, 1], e[:, 2], out=np.full(len(e), np.nan), where=e[:, 2] > 0),))


def ewm_deviation(value: str, alpha: float, name: str) -> Recursion:
    """Square root of the exponentially weighted variance about the weighted mean, corrected for bias; the first value
    weighs (1 - alpha)^age, the others alpha times that. Elements: decay, then sums of weights, their squares, values and
    squares, as they continue and as they begin a series."""

    def elements(rows: Rows) -> np.ndarray:
        known = ~np.isnan(rows[value])
        x = np.where(known, rows[value], 0.0)
        sums = lambda w: np.stack([w, w * w, w * x, w * x * x], 1) * known[:, None]
        ones = np.ones(len(x))
        return np.concatenate([np.where(known, 1 - alpha, 1.0)[:, None], sums(alpha * ones), sums(ones)], 1)

    def join(earlier: np.ndarray, later: np.ndarray) -> np.ndarray:
        d = later[:, :1]
        fade = np.concatenate([d, d * d, d, d], 1)
        begun = np.where(earlier[:, 5:6] > 0, later[:, 1:5] + fade * earlier[:, 5:], later[:, 5:])
        return np.concatenate([earlier[:, :1] * d, later[:, 1:5] + fade * earlier[:, 1:5], begun], 1)

    def finish(e: np.ndarray) -> tuple[np.ndarray]:
        w, w2, s, q = e[:, 5:].T
        with np.errstate(divide="ignore", invalid="ignore"):
            biased = np.maximum(q / w - (s / w) ** 2, 0.0)
            free = w * w - w2
            return (np.where(free > 1e-12, np.sqrt(biased * w * w / free), np.nan),)

    return Recursion((value,), (name,), 9, elements, join, finish)


def linear_chain(value: str, names: tuple[str, ...], carry: list[list[float]], gain: list[float], first: list[float], plain: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> Recursion:
    """States that feed one another: s = carry s' + gain x, from ``first`` times the first known x on; rows without x keep them.
    ``plain`` gives s from s' and gain x, one state after the other. Elements: the product of the carries, what was added, the states where a series begins, and whether one has."""
    a, b, s0 = np.array(carry, float), np.array(gain, float), np.array(first, float)
    k = len(b)

    def parts(e: np.ndarray) -> tuple[np.ndarray, ...]:
        return e[:, : k * k].reshape(-1, k, k), e[:, k * k : k * k + k], e[:, k * k + k : -1], e[:, -1:]

    def elements(rows: Rows) -> np.ndarray:
        known = ~np.isnan(rows[value])[:, None]
        x = np.where(known, rows[value][:, None], 0.0)
        return np.concatenate([np.where(known, a.ravel(), np.eye(k).ravel()), x * b, x * s0, known.astype(float)], 1)

    def join(earlier: np.ndarray, later: np.ndarray) -> np.ndarray:
        (a1, c1, s1, seen1), (a2, c2, s2, seen2) = parts(earlier), parts(later)
        on = lambda v: np.einsum("nij,nj->ni", a2, v) + c2
        return np.concatenate([(a2 @ a1).reshape(-1, k * k), on(c1), np.where(seen1 > 0, on(s1), s2), np.maximum(seen1, seen2)], 1)

    def follow(earlier: np.ndarray, later: np.ndarray) -> np.ndarray:
        (*_, s1, seen1), (_, c2, s2, seen2) = parts(earlier), parts(later)
        moved = np.where(seen2 > 0, np.stack(plain(s1.T, c2.T), 1), s1)
        out = later.copy()
        out[:, k * k + k :] = np.concatenate([np.where(seen1 > 0, moved, s2), np.maximum(seen1, seen2)], 1)
        return out

    def finish(e: np.ndarray) -> tuple[np.ndarray, ...]:
        *_, states, seen = parts(e)
        return tuple(np.where(seen > 0, states, np.nan).T)

    return Recursion((value,), names, k * k + 2 * k + 1, elements, join, finish, follow=follow)


def macd(value: str, names: tuple[str, str, str], fast: int = 12, slow: int = 26, smooth: int = 9) -> Recursion:
    """The two means of a value and the mean of their difference."""
    f, s, d = (2 / (n + 1) for n in (fast, slow, smooth))

    def plain(before: np.ndarray, added: np.ndarray) -> list[np.ndarray]:
        near, far = added[0] + (1 - f) * before[0], added[1] + (1 - s) * before[1]
        return [near, far, (1 - d) * before[2] + d * (near - far)]

    return linear_chain(value, names, [[1 - f, 0, 0], [0, 1 - s, 0], [d * (1 - f), -d * (1 - s), 1 - d]], [f, s, d * (f - s)], [1, 1, 0], plain)


def twice_smoothed(value: str, names: tuple[str, str], n: int = 3) -> Recursion:
    """The mean of a value and the mean of that mean, each a new value by 1 / n and what was there by (n - 1) / n. That isn't
    1 - 1 / n to the last bit, on which the order of the two hangs where they are equal."""
    keep, alpha = (n - 1) / n, 1 / n

    def plain(before: np.ndarray, added: np.ndarray) -> list[np.ndarray]:
        once = added[0] + keep * before[0]
        return [once, keep * before[1] + alpha * once]

    return linear_chain(value, names, [[keep, 0], [alpha * keep, keep]], [alpha, alpha * alpha], [1, 1], plain)


def _filtered(earlier: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Of a linear-Gaussian state with one component: conditional mean a x + b and variance c of the state after the
    steps, and information eta, j that they give on the state before."""
    (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = earlier.T, later.T
    m = 1 / (1 + c1 * j2)
    return np.stack([a2 * m * a1, a2 * m * (b1 + c1 * e2) + b2, a2 * a2 * m * c1 + c2, a1 * m * (e2 - j2 * b1) + e1, a1 * a1 * m * j2 + j1], 1)


def kalman(y: str, x: str | None, names: tuple[str, str], observation: float = 1e-3, drift: float = 1e-5, mean: float | None = 1.0, variance: float = 100.0) -> Recursion:
    """A state that drifts at random, seen as y = x * state + noise (x = 1 without ``x``): its mean and deviation given
    all rows so far. ``mean`` and ``variance`` describe it before the first row; without ``mean`` that is the first
    known y of the key's first block. Rows without y or x only let it drift."""

    def elements(rows: Rows) -> np.ndarray:
        seen = rows[y]
        by = rows[x] if x else np.ones(len(seen))
        known = ~(np.isnan(seen) | np.isnan(by))
        seen, by = np.where(known, seen, 0.0), np.where(known, by, 0.0)
        spread = by * by * drift + observation
        gain = drift * by / spread
        return np.stack([1 - gain * by, gain * seen, (1 - gain * by) * drift, by * seen / spread, by * by / spread], 1)

    def begin(rows: Rows) -> np.ndarray:
        seen = rows[y][~np.isnan(rows[y])]
        start = mean if mean is not None else seen[0] if len(seen) else np.nan
        return np.array([0.0, start, variance, 0.0, 0.0])

    return Recursion((y, x) if x else (y,), names, 5, elements, _filtered, lambda e: (e[:, 1], np.sqrt(e[:, 2])), begin)


def _smoothing(state: str, deviation: str, name: str, drift: float) -> Recursion:
    """Backwards over filtered rows: s = c s' + (1 - c) state."""

    def elements(rows: Rows) -> np.ndarray:
        c = rows[deviation] ** 2 / (rows[deviation] ** 2 + drift)
        return np.stack([c, (1 - c) * rows[state], rows[state]], 1)

    return Recursion((state, deviation), (name,), 3, elements, _affine, lambda e: (e[:, 2],))


def kalman_beta(df: DataFrame, y: str, x: str, key: str = "code", time: str = "date", parts: int | None = None) -> DataFrame:
    """``beta`` and ``beta_std``: the coefficient of y on x, drifting in time."""
    return scan(df, [kalman(y, x, ("beta", "beta_std"))], key, time, parts=parts)


def kalman_smooth(df: DataFrame, value: str, key: str = "code", time: str = "date", drift: float = 1e-5, parts: int | None = None) -> DataFrame:
    """``state`` and ``state_std`` of a drifting level from the rows so far, and ``smooth`` from all of them."""
    level = kalman(value, None, ("state", "state_std"), drift=drift, mean=None, variance=10.0)
    return scan(df, [level], key, time, parts=parts, back=[_smoothing("state", "state_std", "smooth", drift)])
