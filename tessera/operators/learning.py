"""Clustering and components of vectors: k-means|| seeding with Lloyd's steps, and principal components.

Tasks reduce their rows to sums of the size clusters by dimensions, or dimensions squared; sums are merged by Spark, and
only merged sums reach the driver. Vectors that are null or hold null or non-finite numbers take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.risk import jacobi

ROUNDS = 5


def usable(df: DataFrame, vector: str, size: int) -> DataFrame:
    """Rows whose vector has ``size`` finite numbers, as doubles."""
    x = F.col(vector).cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.withColumn(vector, x).where((F.size(vector) == size) & whole)


def _array(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centre (the first of equals) and its squared distance, computed by differences, block by
    block, so that a row on a centre has distance 0."""
    at, best = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, (1 << 22) // max(1, centres.size))
    for k in range(0, len(x), step):
        part = x[k : k + step]
        d = ((part[:, None, :] - centres[None]) ** 2).sum(2)
        at[k : k + step], best[k : k + step] = d.argmin(1), d.min(1)
    return at, best


def _mapped(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (f(b) for b in batches if b.num_rows)

    return df.mapInArrow(run, schema)


def _sums(df: DataFrame, centres: np.ndarray, vector: str) -> tuple[np.ndarray, np.ndarray, float]:
    """By cluster: rows, sums of vectors; and the sum of squared distances."""
    k, size = centres.shape

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _array(batch.column(0))
        at, d = nearest(x, centres)
        sums = np.zeros((k, size + 2))
        np.add.at(sums, at, np.concatenate([x, np.ones((len(x), 1)), d[:, None]], 1))
        kept = np.flatnonzero(sums[:, size])
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(sums[kept].tolist(), pa.list_(pa.float64()))], names=["cluster", "sums"])

    rows = _mapped(df.select(vector), part, "cluster long, sums array<double>")
    cells = rows.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col").alias("total")).collect()  # clusters by dimensions
    out = np.zeros((k, size + 2))
    for c, pos, total in cells:
        out[c, pos] = total
    return out[:, size], out[:, :size], float(out[:, size + 1].sum())


def _share(id_column: str, seed: int, step: int):
    """A number in [0, 1) that only the row's id and the step decide."""
    return F.pmod(F.xxhash64(F.col(id_column), F.lit(seed), F.lit(step)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def seeds(df: DataFrame, k: int, size: int, vector: str, id_column: str, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means||: each round takes each row with a chance of 2 k times its share of the cost, some 2 k rows; the rows
    taken, weighed by the rows nearest to them, are reduced to k by k-means++."""
    first = df.orderBy(_share(id_column, seed, -1), id_column).select(vector).limit(1).collect()
    if not first:
        return np.zeros((0, size))
    taken = np.array([r[0] for r in first], float)
    for step in range(rounds):
        *_, cost = _sums(df, taken, vector)
        if cost <= 0:
            break
        centres = taken

        def distance(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nearest(_array(batch.column(0)), centres)[1])], names=["v", "u", "d"])

        near = _mapped(df.select(vector, _share(id_column, seed, step).alias("u")), distance, "v array<double>, u double, d double")
        more = near.where(F.col("u") < 2 * k * F.col("d") / cost).select("v").collect()
        taken = np.concatenate([taken, np.array([r[0] for r in more], float).reshape(-1, size)])
    taken = np.unique(taken, axis=0)
    weight, *_ = _sums(df, taken, vector)
    rng = np.random.default_rng(seed)
    chosen = [taken[int(weight.argmax())]]
    while len(chosen) < min(k, len(taken)):
        cost = nearest(taken, np.array(chosen))[1] * np.maximum(weight, 1e-9)
        chosen.append(taken[int(np.searchsorted(np.cumsum(cost), rng.random() * cost.sum(), "right").clip(0, len(taken) - 1))])
    return np.array(chosen)


def kmeans(df: DataFrame, k: int, vector: str = "embedding", id_column: str = "vec_id", size: int | None = None, seed: int = 11, most: int = 30, start: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray, list[float]]:
    """Rows with ``cluster`` and ``distance`` (squared), the centres, and the cost before each step. Steps end when the cost
    falls by less than a millionth; a cluster that loses its rows keeps its centre."""
    size = size or (df.select(F.max(F.size(vector))).first()[0] or 0)
    rows = usable(df, vector, size)
    centres = seeds(rows, k, size, vector, id_column, seed) if start is None else np.array(start, float)
    costs: list[float] = []
    for _ in range(most if len(centres) else 0):
        n, sums, cost = _sums(rows, centres, vector)
        costs.append(cost)
        if len(costs) > 1 and costs[-2] - cost <= 1e-6 * costs[-2]:
            break
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    final, rows = centres, rows.drop("cluster", "distance")
    at = rows.columns.index(vector)

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        cluster, d = nearest(_array(batch.column(at)), final)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster, pa.int64()), pa.array(d)], names=[*batch.schema.names, "cluster", "distance"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "cluster long, distance double"])
    return _mapped(rows, assign, schema), centres, costs


def moments(df: DataFrame, vector: str, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance (of the sample) of vectors. Tasks sum products of their batches; these are merged as
    dimensions squared by Spark. Products are taken about the first row's values, which keeps their digits."""
    first = df.select(vector).limit(1).collect()
    if not first:
        return 0, np.zeros(size), np.zeros((size, size))
    base = np.array(first[0][0], float)

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.concatenate([_array(batch.column(0)) - base, np.ones((batch.num_rows, 1))], 1)
        gram = x.T @ x
        return pa.RecordBatch.from_arrays([pa.array(np.arange(gram.size), pa.int64()), pa.array(gram.ravel())], names=["cell", "v"])

    cells = _mapped(df.select(vector), part, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()  # dimensions squared
    gram = np.zeros((size + 1) ** 2)
    for c, v in cells:
        gram[c] = v
    gram = gram.reshape(size + 1, size + 1)
    n = gram[-1, -1]
    mean = gram[-1, :-1] / n
    cov = (gram[:-1, :-1] - n * np.outer(mean, mean)) / max(n - 1, 1)
    return int(n), base + mean, cov


def principal_components(df: DataFrame, k: int, vector: str = "embedding", size: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Rows with ``components`` (scores on the first ``k``), the axes (rows; the largest entry is positive) and their shares
    of the variance."""
    size = size or (df.select(F.max(F.size(vector))).first()[0] or 0)
    rows = usable(df, vector, size)
    _, mean, cov = moments(rows, vector, size)
    values, vectors = jacobi(cov)
    order = np.argsort(-values, kind="stable")[:k]
    axes = vectors[:, order].T
    if axes.size:
        axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    total = values.sum()
    shares = values[order] / total if total > 0 else np.zeros(len(order))
    rows = rows.drop("components")
    at = rows.columns.index(vector)

    def project(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = (_array(batch.column(at)) - mean) @ axes.T
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores.tolist(), pa.list_(pa.float64()))], names=[*batch.schema.names, "components"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "components array<double>"])
    return _mapped(rows, project, schema), axes, shares
