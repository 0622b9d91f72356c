"""Many trailing windows of a key's ordered rows in one pass.

Spark evaluates every aggregate of a sliding frame anew at every row. Here the rows are dealt by key and sorted by Spark,
and a task takes some thousands of rows together, oldest values of all windows first, so that a step is one array
operation for all of them. Sums and moments are added up in the order of Spark's own frames. A task holds a batch and
the rows before it that windows reach back to, however long a key is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.recursion import Recursion, _key_starts, carried_on

BATCH = 1 << 15

#: Column made: how, of which column (two for corr), over how many rows, and at least how many known ones (all of them, if not given;
#: fewer for min and max only). A function instead makes a column of the task out of others, row by row, that isn't returned. lag: the value so many rows ago. streak: rows in a row, this one last, with a value above zero. row: the row's number. held: a streak's
#: length at the last row with one, 0 before any. below: share of the window below the row's value. first: the window's oldest row, however few it has.
#: deviation: mean distance from the window's mean. fall: the deepest fall from a peak in the window. slope: of the values on their places.
#: total: the sum of the known values of the window, however few it has. rho: corr however little the two vary.
Spec = tuple


def quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, missing where b is zero or missing."""
    return np.where(b == 0, np.nan, a / b)


def _extreme(how: str, x: np.ndarray, pos: np.ndarray, n: int) -> np.ndarray:
    take = np.fmin if how == "min" else np.fmax
    out, width = x.copy(), 1

    def joined(shift: int) -> np.ndarray:
        return take(out, np.where(pos >= shift, np.concatenate([np.full(min(shift, len(out)), np.nan), out[: max(len(out) - shift, 0)]]), np.nan))

    while width * 2 <= n:
        out, width = joined(width), width * 2
    return joined(n - width) if n > width else out


_ORDERS = {"skew": 3, "kurt": 4}


def _moments(x: list[np.ndarray], order: int) -> tuple[np.ndarray, ...]:
    mean = m2 = m3 = m4 = np.zeros(len(x[0]))
    for k, v in enumerate(x):
        delta = v - mean
        step = delta / (k + 1.0)
        mean = mean + step
        m2 = m2 + delta * (delta - step)
        if order > 2:
            square, step2 = delta * delta, step * step
            m3 = m3 - 3.0 * step * m2 + delta * (square - step2)
            if order > 3:
                m4 = m4 - 4.0 * step * m3 - 6.0 * step2 * m2 + delta * (delta * square - step * step2)
    return m2, m3, m4


Moments = Callable[[int], tuple[np.ndarray, ...]]


def _aggregate(how: str, x: list[np.ndarray], n: int, y: list[np.ndarray] | None, of_x: Moments, of_y: Moments | None) -> np.ndarray:
    """Of the values of full windows, oldest first, whose moments are ``of_x`` and ``of_y``."""
    if how in ("sum", "mean"):
        total = np.zeros(len(x[0]))
        for v in x:
            total = total + v
        return total if how == "sum" else total / n
    if how in ("corr", "rho"):
        mx, my, both = np.zeros(len(x[0])), np.zeros(len(x[0])), np.zeros(len(x[0]))
        for k, (a, b) in enumerate(zip(x, y)):
            dx = a - mx
            mx, my = mx + dx / (k + 1.0), my + (b - my) / (k + 1.0)
            both = both + dx * (b - my)
        spread = np.sqrt(of_x(2)[0] / n) * np.sqrt(of_y(2)[0] / n)
        return np.where(spread > (1e-12 if how == "corr" else 0.0), both / n / spread, np.nan)
    if how == "deviation":
        mean = _aggregate("mean", x, n, None, of_x, None)
        return _aggregate("mean", [abs(v - mean) for v in x], n, None, of_x, None)
    if how == "fall":
        peak, worst = x[0], np.zeros(len(x[0]))
        for v in x:
            peak = np.fmax(peak, v)
            worst = np.fmin(worst, v / peak - 1)
        return worst
    if how == "slope":
        mean = both = np.zeros(len(x[0]))
        for k, v in enumerate(x):
            mean = mean + (v - mean) / (k + 1.0)
            both = both + (k + 1) / 2 * (v - mean)  # a place less the mean of those before it
        return both / (n * (n * n - 1.0) / 12)
    m2, m3, m4 = of_x(_ORDERS.get(how, 2))
    if how == "std":
        return np.sqrt(m2 / (n - 1.0))
    if how == "pop":
        return np.sqrt(m2 / n)
    m2 = np.where(m2 == 0, np.nan, m2)
    if how == "skew":
        return np.sqrt(n) * m3 / np.sqrt(m2 * m2 * m2) * np.sqrt(n * (n - 1.0)) / (n - 2)
    if how == "kurt":
        return (n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * (n * m4 / (m2 * m2) - 3.0) + 6)
    raise ValueError(f"unknown aggregate {how}")


def _made(rows: dict[str, np.ndarray], pos: np.ndarray, specs: dict[str, Spec]) -> dict[str, np.ndarray]:
    rows, size = dict(rows), len(pos)
    at = np.arange(size)
    orders: dict[tuple[str, int], int] = {}
    for how, source, n, *_ in specs.values():
        for c in () if callable(how) else (source,) if isinstance(source, str) else source:
            orders[c, n] = max(orders.get((c, n), 2), _ORDERS.get(how, 2))
    moments: dict[tuple[str, int], tuple[np.ndarray, ...]] = {}

    def windows(v: np.ndarray, n: int) -> list[np.ndarray]:
        long = np.concatenate([np.full(n - 1, np.nan), v])
        return [long[k : k + size] for k in range(n)]

    def moments_of(c: str, n: int) -> Moments:
        def find(order: int) -> tuple[np.ndarray, ...]:
            if (c, n) not in moments:
                moments[c, n] = _moments(windows(rows[c], n), max(order, orders[c, n]))
            return moments[c, n]

        return find

    with np.errstate(all="ignore"):
        for name, (how, source, n, *least) in specs.items():
            if callable(how):
                rows[name] = np.asarray(how(*(rows[c] for c in source)), float)
                continue
            if how == "row":
                rows[name] = pos + 1.0
                continue
            x, y = [rows[c] for c in source] if how in ("corr", "rho") else (rows[source], None)
            if how == "held":
                last = np.maximum.accumulate(np.where(x > 0, at, -1))
                rows[name] = np.where(last >= at - pos, x[last], 0.0)
                continue
            if how == "lag":
                rows[name] = np.where(pos >= n, np.concatenate([np.full(min(n, size), np.nan), x[: max(size - n, 0)]]), np.nan)
                continue
            if how == "first":
                rows[name] = x[at - np.minimum(pos, n - 1)]
                continue
            if how == "streak":
                last = np.maximum.accumulate(np.where(x > 0, -1, at))
                rows[name] = (at - np.maximum(last, at - pos - 1)).astype(float)
                continue
            seen = np.concatenate([[0], np.cumsum(~np.isnan(x) if y is None else ~(np.isnan(x) | np.isnan(y)))])
            known = seen[1:] - seen[at - np.minimum(pos, n - 1)]
            if how in ("min", "max"):
                value = _extreme(how, x, pos, n)
            elif how == "below":
                value = sum((np.concatenate([np.full(k, np.nan), x])[:size] < x).astype(float) for k in range(1, n)) / n
            elif how == "total":
                value, least = np.zeros(size), [1]
                for k, v in enumerate(windows(x, n)):
                    value = value + np.where((pos >= n - 1 - k) & ~np.isnan(v), v, 0.0)
            else:
                first, *second = (source,) if y is None else source
                value = _aggregate(how, windows(x, n), n, None if y is None else windows(y, n), moments_of(first, n), moments_of(second[0], n) if second else None)
            rows[name] = np.where(known >= (least[0] if least else n), value, np.nan)
    return {name: rows[name] for name in specs}


def sorted_by(df: DataFrame, key: str, time: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(F.col(key).asc_nulls_first(), F.col(time).asc_nulls_first())


Tables = Iterator[pa.Table]


def _windows(specs: dict[str, Spec], columns: list[str], key: str, keep: list[str] | None = None) -> Callable[[Tables], Tables]:
    """The columns of ``specs`` (those in ``keep``, or all but a task's own) beside sorted tables that have ``columns``."""
    kept = [c for c, s in specs.items() if (not callable(s[0]) if keep is None else c in keep)]
    inputs = tuple(dict.fromkeys(c for _, source, *_ in specs.values() for c in ((source,) if isinstance(source, str) else source) if c in columns))
    reach: dict[str, int] = {}
    for name, (_, source, n, *_) in specs.items():
        reach[name] = n + max(reach.get(c, 0) for c in ((source,) if isinstance(source, str) else source))
    back, carried = max(reach.values()), [n for n, s in specs.items() if s[0] in ("row", "streak")]
    held = [(n, s[1]) for n, s in specs.items() if s[0] == "held"]

    def run(tables: Tables) -> Tables:
        tail: pa.Table | None = None
        before: dict[str, float] = {}
        for table in tables:
            small = table.select([key, *(c for c in inputs if c != key)])
            first = tail.num_rows if tail is not None else 0
            whole = pa.concat_tables([tail, small]) if first else small
            starts = _key_starts(whole.column(key))
            at = np.arange(whole.num_rows)
            pos = at - np.repeat(starts, np.diff(np.append(starts, whole.num_rows)))
            rows = {c: whole.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for c in inputs}
            made = _made(rows, pos, specs)
            if first:  # what goes on from rows that are no longer here
                end = starts[starts >= first][0] if (starts >= first).any() else whole.num_rows
                for c in carried:
                    goes_on = (at >= first) & (at < end) & ((made[c] - made[c][first - 1]) == at - first + 1)
                    made[c] = made[c] + np.where(goes_on, before[c] - made[c][first - 1], 0.0)
                for c, streak in held:
                    last = np.maximum.accumulate(np.where((made[streak] > 0) & (at >= first), at, -1))
                    made[c] = np.where((at >= first) & (at < end), np.where(last >= 0, made[streak][last], before[c]), made[c])
            before = {c: made[c][-1] for c in (*carried, *(c for c, _ in held))}
            out = {c: table.column(c) for c in table.column_names}
            out |= {c: pa.array(made[c][first:], pa.float64(), from_pandas=True) for c in kept}
            yield pa.table(out)
            tail = whole.slice(max(whole.num_rows - back, 0))

    return run


def rolled(
    df: DataFrame, specs: dict[str, Spec] | list[dict[str, Spec] | list[Recursion]], key: str = "code", keep: list[str] | None = None,
    into: tuple[Callable[[Tables], Tables], str] | None = None,
) -> DataFrame:
    """``df``, as ``sorted_by`` left it, with the columns of ``specs``, each of which may use those before it; rows stay in place.
    A list holds specs and recursions in turn. ``keep`` names the columns that are wanted (all but a task's own, if not given). Missing
    values are unknown; a window that reaches before the key's first row lacks those rows. ``into`` is what the tables so made go
    through in the same task, and the schema of what comes out."""
    stages: list[Callable[[Tables], Tables]] = []
    given, columns = list(df.columns), list(df.columns)
    steps = [specs] if isinstance(specs, dict) else specs
    for k, step in enumerate(steps):
        if isinstance(step, dict):
            chosen = keep if k == len(steps) - 1 else None
            stages.append(_windows(step, columns, key, chosen))
            columns += [c for c, s in step.items() if (not callable(s[0]) if chosen is None else c in chosen)]
        else:
            stages.append(lambda tables, step=step: carried_on(tables, step, key))
            columns += [c for r in step for c in r.outputs]
    wanted = [c for c in columns[len(given) :] if keep is None or c in keep]
    last, schema = into or (None, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{c}` double" for c in wanted)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = in_tables(batches)
        for stage in stages:
            tables = stage(tables)
        tables = (table.select([*given, *wanted]) for table in tables)
        for table in last(tables) if last else tables:
            yield from table.to_batches(max_chunksize=10_000)

    return df.mapInArrow(run, schema)


def in_tables(batches: Iterator[pa.RecordBatch]) -> Tables:
    """Batches as tables of some BATCH rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= BATCH:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
