"""Approximate nearest neighbours (1): multi-index hashing for largest inner products.

Vectors are scaled by the largest norm and get one more component that makes them unit vectors, so that
inner products become angles. Rotations learned on a bounded sample (PCA, then rotations that bring signs
close to values) give binary codes of ``BITS`` bits. Codes are split into substrings, each with a table from
value to rows. By the pigeonhole principle a code within Hamming radius R of a query is within R // tables of
it in one of the first R % tables + 1 substrings or within one less in another: the buckets that near are
looked up, by enumerating the values of such a ball where it is smaller than the table and among the table's
values where not; the codes found are held to R, and the vectors left are ranked by exact inner products in
double precision. R is the radius that holds nearly all true neighbours of the sample, and the width of the
substrings is the one that costs the sample's queries least; a query that finds fewer than it wants widens R.

The query set goes against all rows in blocks: every block of the index has its own tables, meets every
block of queries in a task of its own, and returns each query's best.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; a row is no neighbour of its own id; ties go to the smaller id; fewer candidates
than wanted are all returned; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import materialize

BITS = 128
#: Widths that substrings may have, and what testing a found row costs against testing a table's value.
WIDTHS, ROW_COST = (8, 16, 32, 64), 8
#: Rows the rotations are learned on, and queries among them that set the radius; in hash order.
SAMPLE, PROBES = 8192, 400
#: Share of the sample's true neighbours that the radius must hold.
HELD = 0.965
BLOCK, QUERY_BLOCK, LEAST_BLOCK = 32_768, 8_192, 256


def usable(vector: Column, dim: int) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Unit vectors whose inner products with (q, 0) are those of x over ``top``."""
    x = x / top
    return np.hstack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))[:, None]])


def learn_rotations(x: np.ndarray, bits: int, rounds: int = 25) -> np.ndarray:
    """A (dim, bits) projection: for every ``dim`` bits, principal axes turned so that signs lose least."""
    rng = np.random.default_rng(7)
    dim = x.shape[1]
    axes = np.linalg.eigh(x.T @ x)[1].T[::-1]  # dim x dim; the sample's own decomposition would be rows x rows
    v = x @ axes.T
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(axes.T @ r)
    return np.hstack(parts)[:, :bits]


def codes_of(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """(rows, bits / 8) bytes."""
    return np.packbits(x @ projection >= 0, axis=1)


def hamming(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(many ^ one).sum(1, dtype=np.int64)


def radii(radius: int, tables: int) -> list[int]:
    """How near a code within ``radius`` must be in one of the substrings; -1: that substring needn't be looked at."""
    return [radius // tables - (t > radius % tables) for t in range(tables)]


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(radius + 1))


def fit(sample: np.ndarray, top: float, k: int, bits: int = BITS) -> tuple[np.ndarray, int, int]:
    """The projection, the radius and the width of substrings."""
    x = lifted(sample, top)
    projection = learn_rotations(x, bits)
    codes = codes_of(x, projection)
    apart, asked = [], []
    for i in range(min(PROBES, len(x))):
        q = sample[i] / np.linalg.norm(sample[i])
        own = codes_of(np.append(q, 0.0)[None, :], projection)[0]
        score = sample @ q
        score[i] = -np.inf
        best = np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]
        apart.append(hamming(own, codes[best]))
        asked.append(own)
    known = np.concatenate(apart) if apart else np.zeros(0)
    if not len(known):
        return projection, bits, WIDTHS[1]
    radius = int(np.quantile(known, HELD, method="higher"))
    costs = {}
    for width in WIDTHS:
        index = MultiIndex(codes, width)
        looked = sum(min(ball(width, r), len(t[1])) for r, t in zip(radii(radius, len(index.tables)), index.tables))
        costs[looked + ROW_COST * float(np.mean([len(index.probed(q, radius)) for q in asked[:50]]))] = width
    return projection, radius, costs[min(costs)]


@lru_cache(maxsize=16)
def _masks(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``radius`` ones."""
    out = [0]
    for k in range(1, radius + 1):
        out += [sum(1 << b for b in at) for at in combinations(range(width), k)]
    return np.array(out, np.uint64).astype(f"u{width // 8}")


class MultiIndex:
    """Substring tables over a block of codes."""

    def __init__(self, codes: np.ndarray, width: int = 16):
        self.codes = np.ascontiguousarray(codes).view(np.uint8)
        self.words = self.codes.view(np.uint64)
        self.width, self.tables = width, []
        parts = self.codes.view(f"u{width // 8}")
        for t in range(parts.shape[1]):
            order = np.argsort(parts[:, t], kind="stable")
            values, first = np.unique(parts[order, t], return_index=True)
            self.tables.append((order, values, first, np.append(first[1:], len(order))))

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows in the buckets that a code within ``radius`` must be in one of."""
        seen = np.zeros(len(self.codes), bool)
        own = np.ascontiguousarray(code).view(f"u{self.width // 8}")
        for (order, values, first, last), part, near in zip(self.tables, own, radii(radius, len(self.tables))):
            if near < 0:
                continue
            if ball(self.width, near) < len(values):
                wanted = _masks(self.width, near) ^ part
                hit = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
                hit = hit[values[hit] == wanted]
            else:
                hit = np.flatnonzero(np.bitwise_count(values ^ part) <= near)
            size = last[hit] - first[hit]
            if len(hit) == size.sum():  # buckets of one row each
                seen[order[first[hit]]] = True
            else:
                at = np.arange(int(size.sum())) + np.repeat(first[hit] - (np.cumsum(size) - size), size)
                seen[order[at]] = True
        return np.flatnonzero(seen)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is within ``radius``."""
        rows = self.probed(code, radius)
        own = np.ascontiguousarray(code).view(np.uint64)
        return rows[np.bitwise_count(self.words[rows] ^ own).sum(1, dtype=np.int64) <= radius]


def _search(dim: int, projection: np.ndarray, radius: int, width: int, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(queries):
            ids = index["vec_id"].to_numpy()
            x = np.frombuffer(b"".join(index["vector"]), np.float64).reshape(-1, dim)
            tables = MultiIndex(np.frombuffer(b"".join(index["code"]), np.uint8).reshape(len(ids), -1), width)
            for own, raw in zip(queries["query_id"].to_numpy(), queries["vector"]):
                q = np.frombuffer(raw, np.float64)
                code = codes_of(np.append(q / np.linalg.norm(q), 0.0)[None, :], projection)[0]
                reach = radius
                while True:
                    rows = tables.within(code, reach)
                    rows = rows[ids[rows] != own]
                    if len(rows) >= k or reach >= projection.shape[1]:
                        break
                    reach = min(projection.shape[1], reach + 8)
                score = (x[rows] * q).sum(1)
                if len(rows) > 4 * k:  # all that may be among the best, ties with the last one too
                    few = score >= np.partition(score, len(rows) - k)[len(rows) - k]
                    rows, score = rows[few], score[few]
                best = np.lexsort((ids[rows], -score))[:k]
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids[rows[best]], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return run


def nearest(vectors: DataFrame, every: int, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for every row whose id ``every`` divides."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where("vec_id is not null")
    dim = rows.select(F.mode(F.when(F.size("vector") > 0, F.size("vector")), True)).first()[0] or 1
    rows = rows.where(usable(F.col("vector"), dim))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    facts = rows.agg(F.sqrt(F.max(square)).alias("top"), F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("queries")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(1, -(-facts["n"] // BLOCK))
    n_query_blocks = max(1, -(-facts["queries"] // QUERY_BLOCK), min(-(-2 * cores // n_blocks), facts["queries"] // LEAST_BLOCK))
    top = float(facts["top"] or 1.0) * (1 + 1e-12)
    sample = rows.orderBy(F.xxhash64("vec_id", "vector")).limit(SAMPLE).select("vector").collect()
    x = np.array([r["vector"] for r in sample], float).reshape(-1, dim)
    projection, radius, width = fit(x, top, k) if len(x) > 1 else (np.zeros((dim + 1, BITS)), BITS, WIDTHS[1])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), dim)
            code = codes_of(lifted(v, top), projection)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in v], pa.binary()), pa.array([c.tobytes() for c in code], pa.binary())], names=["vec_id", "vector", "code"])

    index = materialize(rows.mapInArrow(encode, "vec_id bigint, vector binary, code binary"), "codes")
    block = F.pmod(F.xxhash64("vec_id", "code"), F.lit(n_blocks)).alias("block")
    query_block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_query_blocks)).alias("query_block")
    to_all = lambda n, name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias(name)
    left = index.select(block, "vec_id", "vector", "code", to_all(n_query_blocks, "query_block"))
    right = index.where(F.col("vec_id") % every == 0).select(query_block, F.col("vec_id").alias("query_id"), "vector", to_all(n_blocks, "block"))
    tasks = max(n_blocks * n_query_blocks, 1)  # told outright: by their bytes, these few rows would meet in one or two tasks
    left, right = (x.repartition(tasks, "block", "query_block").groupBy("block", "query_block") for x in (left, right))
    found = left.cogroup(right).applyInPandas(_search(dim, projection, radius, width, k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(vectors: np.ndarray, ids: np.ndarray, found: dict[int, list[int]], k: int) -> float:
    """Share of each query's true ``k`` nearest (ties to the smaller id) that were found."""
    place = {int(i): p for p, i in enumerate(ids)}
    right = total = 0
    for query, got in found.items():
        score = (vectors * vectors[place[query]]).sum(1)
        score[place[query]] = -np.inf
        best = ids[np.lexsort((ids, -score))[: min(k, len(ids) - 1)]]
        right += len(set(best.tolist()) & set(got))
        total += len(best)
    return right / max(1, total)
