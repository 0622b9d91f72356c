"""Random forests over a table of any length: one aggregation a level for all trees together.

Features are binned by quantiles once. For each level, tasks add up rows, labels and squares by tree, node, feature and bin (their
size follows from the model, not from the data); Spark merges the sums, and the driver picks the splits of a level from
them. So a forest takes one pass a level, however many trees it has. A row's weight in a tree is Poisson(1), drawn from
its id, and so the same after lost tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import stored

_U = np.uint64


@dataclass
class Forest:
    """Nodes in heap order: node k has children 2k + 1 (at or below the threshold) and 2k + 2 (above it, or missing)."""

    features: list[str]
    feature: np.ndarray  # trees x nodes; -1: a leaf
    threshold: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The mean over trees of the values of the leaves that rows fall into."""
        out = np.zeros(len(x))
        every = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            while True:
                split = f[at] >= 0
                if not split.any():
                    break
                values = x[every, np.maximum(f[at], 0)]
                at = np.where(split, 2 * at + 1 + ~(values <= t[at]), at)
            out += v[at]
        return out / max(len(self.feature), 1)

    def importance(self) -> dict[str, float]:
        """Shares of the reduction in squared error."""
        total = np.zeros(len(self.features))
        np.add.at(total, self.feature[self.feature >= 0], self.gain[self.feature >= 0])
        return dict(zip(self.features, (total / total.sum() if total.sum() > 0 else total).tolist()))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_STEPS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])


def weights(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row counts in a tree."""
    u = (_mix(ids.view(_U) ^ _mix(np.array([tree * 1_000_003 + seed], _U))) >> _U(11)).astype(float) / 2.0**53
    return np.searchsorted(_STEPS, u, "right").astype(float)


def _matrix(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    return np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(columns)], 1) if columns else np.zeros((batch.num_rows, 0))


def fit(df: DataFrame, features: list[str], label: str, id_column: str, trees: int = 20, depth: int = 4, bins: int = 32, least: float = 5.0, tried: int | None = None, bootstrap: bool = True, seed: int = 3) -> Forest:
    """A forest that predicts the mean of ``label`` (of 0 and 1: a chance). Each node looks at ``tried`` features (the square root of all,
    rounded up) and takes the split that lowers the squared error most, the first of equals, with at least ``least`` rows on
    either side. Rows without a label don't count; a missing feature is above every threshold."""
    k = len(features)
    tried = tried or math.ceil(math.sqrt(k))
    rows = df.where(F.col(label).isNotNull()).select(*(F.col(f).cast("double").alias(f"f{j}") for j, f in enumerate(features)), F.col(label).cast("double").alias("y"), F.xxhash64(id_column).alias("id"))
    cuts = [q / bins for q in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(f"f{j}", F.lit(cuts), 10_000).alias(f"f{j}") for j in range(k))).first()
    edges = [np.unique(np.array(found[j] or [], float)) for j in range(k)]
    width = max([len(e) for e in edges], default=0) + 1

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, k)
            codes = [np.where(np.isnan(x[:, j]), len(edges[j]), np.searchsorted(edges[j], x[:, j])) for j in range(k)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int16)) for c in codes), batch.column(k), batch.column(k + 1)], names=batch.schema.names)

    table = stored(rows.mapInArrow(binned, ", ".join([*(f"f{j} smallint" for j in range(k)), "y double, id long"])), "binned")
    nodes = 2 ** (depth + 1) - 1
    feature, at_bin = np.full((trees, nodes), -1), np.zeros((trees, nodes), np.int64)
    value, gain = np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for level in range(depth + 1):
        first, count = 2**level - 1, 2**level
        shape = (trees, count, k, width, 3)

        def sums(batches: Iterator[pa.RecordBatch], feature=feature.copy(), at_bin=at_bin.copy(), first=first, shape=shape) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                codes = np.stack([batch.column(j).to_numpy() for j in range(k)], 1).astype(np.int64)
                y, ids = batch.column(k).to_numpy(), batch.column(k + 1).to_numpy()
                every = np.arange(len(y))
                for t in range(shape[0]):
                    at, alive = np.zeros(len(y), np.int64), np.ones(len(y), bool)
                    while first and alive.any() and at[alive].min() < first:
                        f = feature[t][at]
                        alive &= f >= 0
                        at = np.where(alive, 2 * at + 1 + (codes[every, np.maximum(f, 0)] > at_bin[t][at]), at)
                    w = weights(ids, t, seed) if bootstrap else np.ones(len(y))
                    some = np.flatnonzero(alive & (w > 0))
                    for j in range(k):
                        cell = (at[some] - first) * shape[3] + codes[some, j]
                        for m, v in enumerate((w[some], w[some] * y[some], w[some] * y[some] ** 2)):
                            total[t, :, j, :, m] += np.bincount(cell, v, shape[1] * shape[3]).reshape(shape[1], shape[3])
            kept = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(total.ravel()[kept])], names=["cell", "v"])

        merged = table.mapInArrow(sums, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
        hist = np.zeros(int(np.prod(shape)))
        hist[merged.column("cell").to_numpy()] = merged.column("v").to_numpy()
        hist = hist.reshape(shape)
        for t in range(trees):
            for n in range(count):
                node = first + n
                if node and feature[t, (node - 1) // 2] < 0:
                    continue
                w, s, q = hist[t, n, 0].sum(0) if k else (0.0, 0.0, 0.0)
                value[t, node] = s / w if w > 0 else 0.0
                if level == depth or w < 2 * least:
                    continue
                rng = np.random.default_rng([seed, t, node])
                best = (1e-12 * max(q, 1.0), -1, 0)
                for j in sorted(rng.choice(k, min(tried, k), False).tolist()):
                    left = np.cumsum(hist[t, n, j], 0)[: len(edges[j])]
                    wl, sl = left[:, 0], left[:, 1]
                    wr, sr = w - wl, s - sl
                    ok = (wl >= least) & (wr >= least)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gains = np.where(ok, sl * sl / wl + sr * sr / wr - s * s / w, -np.inf)
                    if len(gains) and gains.max() > best[0] * (1 + 1e-12):
                        best = (float(gains.max()), j, int(gains.argmax()))
                if best[1] >= 0:
                    gain[t, node], feature[t, node], at_bin[t, node] = best
    threshold = np.array([[edges[f][b] if f >= 0 else math.nan for f, b in zip(fs, bs)] for fs, bs in zip(feature, at_bin)]).reshape(trees, nodes)
    return Forest(features, feature, threshold, value, gain)


def predict(df: DataFrame, forest: Forest, name: str = "prediction") -> DataFrame:
    """``df`` with the forest's prediction."""
    rows = df.drop(name)
    at = [rows.columns.index(f) for f in forest.features]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in at], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.predict(x))], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{name}` double"]))
