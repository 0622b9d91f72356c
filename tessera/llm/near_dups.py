"""MinHash near-dedup (8): chosen-path similarity join over 5-word shingles.

Equal shingle sets fall into one class first; one document stands for each. ``trees`` independent trees
then branch the representatives: a node chooses coordinates of the 64-value minwise signature (one at a
root; below it one or two, 1 / threshold on average, so that a pair at the threshold goes on meeting), and
each child holds the documents that agree there. Nodes of at most ``LEAF`` documents are compared
exhaustively by signature, and pairs that may reach the threshold are confirmed on the full sets. Larger nodes branch again; what is still larger at
``DEPTH`` agrees again and again, and its documents form a crowd. A crowd is dealt into blocks, each
compared on the full sets, exhaustively and with a few pivots that go to every block; documents which that
leaves apart from the crowd's largest component are then compared with all others of the crowd that may reach the
threshold with them: two sets that do share one of their first shingles, in whatever order (here those of no
pivot come first). Only spanning links leave a block. Components follow from links on full sets alone.

Defined cases: letters A-Z count as a-z; fewer than five words make one shingle; null texts and texts
without words have an empty set, no links and themselves as component; rows are told apart by themselves,
so a doc_id may repeat or be null, and every distinct set is searched; a null doc_id stands above every
other and comes back as null; of a component the row with the least doc_id is kept, and one only; other
columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import materialize, shuffle_partitions
from tessera.llm.words import Block, blocks, mix, ngram_hashes

SHINGLE, SIGNATURE = 5, 64
LEAF, DEPTH = 64, 4
#: Blocks of those that are compared with a whole crowd widen with the root of its size, up to WIDEN times.
BLOCK, PIVOTS, WIDEN = 128, 4, 4
#: Marks a pivot's copy in a block.
_PIVOT = 2
#: Signatures (64 values of 8 bits) of sets at 0.85 agree in 54 places on average, give or take 2.9. All trees
#: look at one signature, so a pair below the estimate is missed by all of them: by the binomial tail 6 in 10 million at 0.85, 4 in a million at 0.8.
ESTIMATE_SLACK = 0.25
_U = np.uint64
_FACTOR = 0x9FB21C651E98DF25
_NULL_ID = np.iinfo(np.int64).max
_A = (mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64)) >> _U(32)).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(101, SIGNATURE + 101, dtype=np.uint64)).astype(np.uint32)


def shingle_sets(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit shingle hashes of a block, sorted within rows, and the rows' bounds among them."""
    words, row = b.word_hashes(lower=True), b.row_of_word()
    grams = ngram_hashes(words, SHINGLE, _FACTOR)
    inside = np.flatnonzero(row[: len(grams)] == row[SHINGLE - 1 :]) if len(grams) else np.zeros(0, np.int64)
    rows, values = row[inside], grams[inside]
    short = np.flatnonzero((b.n_words > 0) & (b.n_words < SHINGLE))
    if len(short):
        whole = np.array([_short(words[b.word_at[r] : b.word_at[r + 1]]) for r in short], np.uint64)
        rows, values = np.concatenate((rows, short)), np.concatenate((values, whole))
    keys = np.sort((rows.astype(np.uint64) << _U(48)) | (values >> _U(16)))
    if len(keys):
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    bounds = np.searchsorted(keys, np.arange(b.rows + 1, dtype=np.uint64) << _U(48))
    return keys & _U((1 << 48) - 1), bounds


def _short(words: np.ndarray) -> np.uint64:
    out = _U(len(words))
    with np.errstate(over="ignore"):
        for w in words:
            out = out * _U(_FACTOR) + w
    return mix(np.array([out]))[0]


def _signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(rows, 64) least hashes; rows must not be empty."""
    low = (mix(values + _U(1)) >> _U(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, SIGNATURE), np.uint32)
    for i in range(SIGNATURE):
        out[:, i] = np.minimum.reduceat(low * _A[i] + _B[i], bounds[:-1])
    return out


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch.column(2), 1 << 19):
            values, bounds = shingle_sets(b)
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            sums = np.zeros((2, b.rows), np.uint64)
            signature: list[bytes | None] = [None] * b.rows
            if len(some):
                at = bounds[:-1][some]
                for k in range(2):
                    sums[k, some] = np.add.reduceat(mix(values * _U(2 * k + 3) + _U(k + 1)), at)
                for r, s in zip(some.tolist(), _signatures(values, np.append(at, len(values)))):
                    signature[r] = s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*batch.slice(b.first, b.rows).columns, pa.array(n, pa.int64()), *(pa.array(x.view(np.int64), pa.int64()) for x in sums), pa.array(signature, pa.binary())],
                names=[*batch.schema.names, "n", "h1", "h2", "sig"],
            )


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch.column(1)):
            values, bounds = shingle_sets(b)
            wide = values.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()  # 48 bits each
            sets = [wide[6 * i : 6 * j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.rows), pa.array(sets, pa.binary())], names=["id", "shingles"])


def _matrix(column: pa.Array) -> np.ndarray:
    _, offsets, data = column.buffers()
    n = len(column)
    start = int(np.frombuffer(offsets, np.int32)[column.offset]) if n else 0
    return np.frombuffer(data, np.uint32, n * SIGNATURE, start).reshape(n, SIGNATURE) if n else np.zeros((0, SIGNATURE), np.uint32)


def _root_batches(trees: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
            nodes = [mix(_U((t + 1) * _FACTOR % (1 << 64)) ^ mix(sig[:, t % SIGNATURE].astype(np.uint64) + _U(t))) for t in range(trees)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes).view(np.int64)), pa.array(np.tile(ids, trees))], names=["node", "id"])

    return run


def _branch_batches(share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, ids, sig = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), _matrix(batch.column(2))
            # the node decides, for all its documents alike, whether it has a second coordinate
            twice = (mix(node + _U(9)) >> _U(11)).astype(np.float64) / (1 << 53) < 1 / share - 1
            children, whose = [], []
            for k, rows in ((1, np.arange(len(node))), (2, np.flatnonzero(twice))):
                path = mix(node[rows] + _U(k))
                chosen = sig[rows, (path % _U(SIGNATURE)).astype(np.int64)].astype(np.uint64)
                children.append(mix(path ^ mix(chosen + _U(k))))
                whose.append(ids[rows])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(children).view(np.int64)), pa.array(np.concatenate(whose))], names=["node", "id"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that no group of equal first values (rows are sorted by it) is parted."""
    held: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        first = held.column(0).to_numpy()
        cut = int(np.searchsorted(first, first[-1]))
        if cut:
            yield held.slice(0, cut).combine_chunks().to_batches()[0]
            held = held.slice(cut)
    if held is not None:
        yield held.combine_chunks().to_batches()[0]


def _leaf_pairs(share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (node, id, n, crowd, sig) sorted by node and id: the pairs in a node, not of one crowd, whose sizes
    and signatures let them reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches):
            node, ids, n, crowd = (batch.column(k).to_numpy() for k in range(4))
            sig = _matrix(batch.column(4)).astype(np.uint8)
            left, right = [], []
            need = (share - ESTIMATE_SLACK) * SIGNATURE
            alive = np.arange(len(node))
            for d in range(1, len(node)):
                alive = alive[alive + d < len(node)]
                alive = alive[node[alive] == node[alive + d]]
                if not len(alive):
                    break
                i, j = alive, alive + d
                fit = (np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j])) & (ids[i] != ids[j]) & (crowd[i] != crowd[j])
                i, j = i[fit], j[fit]
                near = (sig[i] == sig[j]).sum(1) >= need
                left.append(ids[i[near]])
                right.append(ids[j[near]])
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    return run


def _spanning(ids: np.ndarray, chosen: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of the documents whose sets reach the threshold pairwise. Pairs count
    if ``chosen`` differs between them, or everywhere if nobody is chosen."""
    size = np.array([len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = times[column] > 1
    place = np.cumsum(times > 1) - 1
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (low, low + 4096))
        table = np.zeros((len(sets), 4096), np.float32)
        table[row[a:b], column[a:b] - low] = 1
        both += table @ table.T
    linked = 100.0 * both >= percent * (size[:, None] + size[None, :] - both.astype(float))
    if chosen.any():
        linked &= chosen[:, None] != chosen[None, :]
    np.fill_diagonal(linked, True)
    label = np.arange(len(sets))
    while True:
        low = np.where(linked, label[None, :], len(sets)).min(1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    out = np.flatnonzero(label != np.arange(len(sets)))
    return ids[label[out]], ids[out]


def _block_links(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (node, id, chosen, shingles) sorted by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches):
            node, ids, chosen = (batch.column(k).to_numpy() for k in range(3))
            heads = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(node)]):
                sets = [_shingles(x.as_py()) for x in batch.column(3).slice(a, b - a)]
                one, two = _spanning(ids[a:b], chosen[a:b], sets, percent)
                fresh = one != two
                if fresh.any():
                    one, two = one[fresh], two[fresh]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two), pa.int64()), pa.array(np.maximum(one, two), pa.int64())], names=["a", "b"])

    return run


def _first_shingles(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (node, id, chosen, shingles, crowd) sorted by node; for each that is no pivot, as many of its shingles, those in
    the fewest pivots first, that a set which reaches the threshold with it shares one of those it gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches):
            node, ids, chosen, crowd = (batch.column(k).to_numpy() for k in (0, 1, 2, 4))
            heads = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(node)]):
                sets = [_shingles(x.as_py()) for x in batch.column(3).slice(a, b - a)]
                pivot = chosen[a:b] == _PIVOT
                common, times = np.unique(np.concatenate([sets[k] for k in np.flatnonzero(pivot)]), return_counts=True)
                found, rows = [], np.flatnonzero(~pivot)
                for k in rows:
                    x = sets[k]
                    at = np.minimum(np.searchsorted(common, x), len(common) - 1)
                    found.append(x[np.lexsort((x, np.where(common[at] == x, times[at], 0)))][: len(x) + -percent * len(x) // 100 + 1])
                if found:
                    of = a + np.repeat(rows, [len(x) for x in found])
                    yield pa.RecordBatch.from_arrays([pa.array(crowd[of]), pa.array(np.concatenate(found).view(np.int64)), pa.array(ids[of]), pa.array(chosen[of])], names=["crowd", "shingle", "id", "chosen"])

    return run


def _confirm_batches(share_percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            last, known = None, None
            for x, y in zip(batch.column(2), batch.column(3)):
                one, two = x.as_py(), y.as_py()
                if one is not last:
                    last, known = one, _shingles(one)
                other = _shingles(two)
                both = len(np.intersect1d(known, other, assume_unique=True))
                keep.append(100 * both >= share_percent * (len(known) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _shingles(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id that ``links`` (a, b) join to another: the least id reachable. In each round
    every id goes to its least neighbour's least neighbour, and what is left are the links between these."""
    ordered = lambda e: e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = materialize(ordered(links), "edges")
    labels = edges.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    for k in range(rounds):
        if edges.isEmpty():
            return labels
        ends = edges.select(F.col("b").alias("id"), F.col("a").alias("to")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("to")))
        near = materialize(ends.groupBy("id").agg(F.min("to").alias("to")), "near")
        step = materialize(near.join(near.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to")), "steps")
        first = edges.join(step.select(F.col("id").alias("a"), F.col("to").alias("one")), "a")
        both = first.join(step.select(F.col("id").alias("b"), F.col("to").alias("two")), "b")
        edges = materialize(ordered(both.select(F.col("one").alias("a"), F.col("two").alias("b"))), "edges")
        moved = labels.join(step.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        labels = materialize(moved if k else step.withColumnRenamed("to", "component"), "labels")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _sized(members: DataFrame) -> DataFrame:
    members = materialize(members, "members")  # read twice below: branching is done once
    sizes = members.groupBy("node").agg(F.count("*").alias("size"), F.min("id").alias("least")).where("size > 1")
    return materialize(members.join(sizes, "node"), "nodes")


def _with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (node, id, chosen and others) with their shingles, those of a node together."""
    return rows.join(sets, "id").select("node", "id", "chosen", "shingles", *rows.columns[3:]).repartition("node").sortWithinPartitions("node")


def _in_blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    return _with_sets(rows, sets).mapInArrow(_block_links(percent), "a bigint, b bigint")


def _crowd_links(members: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """``links`` and the links inside crowds; members: (id, crowd)."""
    sizes = members.groupBy("crowd").agg(F.count("*").alias("size"), F.array_distinct(F.array(F.min("id"), *(F.min_by("id", F.xxhash64("id", F.lit(k))) for k in range(1, PIVOTS)))).alias("pivots"))
    blocks_of = F.ceil(F.col("size") / BLOCK)
    dealt = materialize(members.join(sizes.select("crowd", blocks_of.alias("blocks")), "crowd").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))), "crowds")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks_of - 1)).alias("block")
    pivots = sizes.where(blocks_of > 1).select("crowd", "pivots", every).select("crowd", "block", F.explode("pivots").alias("id"))
    rows = dealt.select("crowd", "block", "id").unionByName(pivots).distinct()
    first = _in_blocks(rows.select(F.xxhash64("crowd", "block").alias("node"), "id", F.lit(0).alias("chosen")), sets, percent)
    links = materialize(links.unionByName(first).distinct(), "links")

    placed = materialize(dealt.join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    largest = placed.groupBy("crowd", "component").agg(F.count("*").alias("n")).groupBy("crowd").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    apart = materialize(placed.join(largest, "crowd").where("component <> main and blocks > 1").select("crowd", "id"), "apart")
    if apart.limit(1).count() == 0:
        return links
    # only what shares a first shingle with one that is apart can be linked to it: the others go no further
    crowded = apart.select("crowd").distinct()
    told = dealt.join(crowded, "crowd", "left_semi").join(apart.select("id", F.lit(1).alias("chosen")), "id", "left").select("crowd", "block", "id", F.coalesce("chosen", F.lit(0)).alias("chosen"))
    told = told.unionByName(pivots.join(crowded, "crowd", "left_semi").withColumn("chosen", F.lit(_PIVOT)))
    told = _with_sets(told.select(F.xxhash64("crowd", "block").alias("node"), "id", "chosen", "crowd"), sets)
    first = materialize(told.mapInArrow(_first_shingles(percent), "crowd bigint, shingle bigint, id bigint, chosen int"), "first")
    shared = first.groupBy("crowd", "shingle").agg(F.count("*").alias("n"), F.max("chosen").alias("any")).where("n > 1 and any = 1")
    met = materialize(first.join(shared, ["crowd", "shingle"], "left_semi").select("crowd", "id", "chosen").distinct(), "met")

    # every block of these meets every slice of those that are apart
    wide = F.lit(BLOCK) * F.least(F.lit(WIDEN), F.ceil(F.sqrt(F.count("*") / (2 * BLOCK))))
    counts = met.groupBy("crowd").agg(F.ceil(F.count("*") / wide).alias("blocks"), F.ceil(F.sum("chosen") / wide).alias("slices"))
    met = met.join(counts, "crowd")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    ours = met.where("chosen = 1").select("crowd", "id", F.pmod(F.xxhash64("id", F.lit(1)), F.col("slices")).alias("slice"), upto("blocks").alias("block"), "chosen")
    theirs = met.select("crowd", "id", upto("slices").alias("slice"), F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.lit(0).alias("chosen"))
    rows = ours.unionByName(theirs).select(F.xxhash64("crowd", "slice", "block").alias("node"), "id", "chosen")
    return links.unionByName(_in_blocks(rows, sets, percent))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that hold on the full shingle sets."""
    first = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("one")), "a")
    both = first.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("two")), "b").select("a", "b", "one", "two")
    return both.mapInArrow(_confirm_batches(percent), "a bigint, b bigint")


def _verdicts(rows: DataFrame, percent: int, trees: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (row, id, text and others) as stored with their features, and for each row its n, class_id,
    component_id and whether it is kept. ``row`` is unique; a class goes by one of its rows in the search."""
    share = percent / 100
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema)
    features = materialize(rows.mapInArrow(_feature_batches, fields + "n bigint, h1 bigint, h2 bigint, sig binary"), "features")
    same = ["n", "h1", "h2"]
    first = F.min(F.struct("id", "row"))
    classes = features.where("n > 0").groupBy(*same).agg(first.alias("first"))
    classes = materialize(classes.select(*same, F.col("first.row").alias("rep"), F.col("first.id").alias("class_id")), "classes")
    # with up to five shingles no two different sets reach 0.85, nor 0.8
    long = F.col("n") > share / (1 - share) - 1e-9
    reps = features.where(long).select(F.col("row").alias("id"), "n", "sig").join(classes.where(long).select(F.col("rep").alias("id")), "id", "left_semi")
    reps = materialize(reps, "representatives")

    leaves = None
    nodes = _sized(reps.select("id", "sig").mapInArrow(_root_batches(trees), "node bigint, id bigint"))
    for depth in range(DEPTH):
        small = nodes.where(F.col("size") <= LEAF).select("node", "id")
        leaves = small if leaves is None else leaves.unionByName(small)
        nodes = nodes.where(F.col("size") > LEAF)
        if depth == DEPTH - 1 or nodes.limit(1).count() == 0:
            break
        wide = nodes.select("node", "id").join(reps.select("id", "sig"), "id").select("node", "id", "sig")
        nodes = _sized(wide.mapInArrow(_branch_batches(share), "node bigint, id bigint"))
    stars = nodes.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    crowds = components(stars).withColumnRenamed("component", "crowd")

    met = leaves.join(reps, "id").join(crowds, "id", "left").select("node", "id", "n", F.coalesce("crowd", "id").alias("crowd"), "sig")
    pairs = met.repartition("node").sortWithinPartitions("node", "id").mapInArrow(_leaf_pairs(share), "a bigint, b bigint")
    pairs = materialize(pairs.distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(crowds.select("id")).distinct()
    # texts move by their rows at every size: what is wanted grows with the documents
    texts = features.select(F.col("row").alias("id"), "text").join(wanted.hint("merge"), "id", "left_semi")
    sets = materialize(texts.mapInArrow(_set_batches, "id bigint, shingles binary"), "sets")
    links = _confirmed(pairs, sets, percent)
    if crowds.limit(1).count():
        links = _crowd_links(crowds, sets, links, percent)
    found = components(links).withColumnRenamed("id", "rep").join(classes, "rep")
    heads = found.groupBy("component").agg(F.min(F.struct("class_id", "h1", "h2", "rep")).alias("head"))
    linked = materialize(found.join(heads, "component").select("rep", F.col("head.class_id").alias("component_id"), F.col("head.rep").alias("head")), "linked")
    settled = classes.join(linked, "rep", "left").select(*same, "class_id", F.coalesce("component_id", "class_id").alias("component_id"), F.coalesce("head", "rep").alias("head"))
    alone = [F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id")]
    return features, features.select("row", "id", *same).join(settled, same, "left").select("row", "id", "n", *alone, F.coalesce(F.col("head") == F.col("row"), F.lit(True)).alias("kept"))


def _rows(docs: DataFrame, doc_id: str, text: str) -> list:
    return [F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_NULL_ID)).alias("id"), F.col(text).cast("string").alias("text")]


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85, trees: int = 12) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (least doc_id with the same set), component_id, kept."""
    _, final = _verdicts(docs.select(*_rows(docs, doc_id, text)), percent, trees)
    back = lambda c, name: F.when(F.col(c) != _NULL_ID, F.col(c)).alias(name)
    return final.select(back("id", doc_id), F.col("n").alias("n_shingles"), back("class_id", "class_id"), back("component_id", "component_id"), "kept")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, trees: int = 12) -> DataFrame:
    """One document of each component, with its own columns."""
    names = {c: "text" if c == text and docs.schema[c].dataType.simpleString() == "string" else f"__c{k}" for k, c in enumerate(docs.columns)}
    others = [F.col(f"`{c}`").alias(n) for c, n in names.items() if n != "text"]
    stored, final = _verdicts(docs.select(*_rows(docs, doc_id, text), *others), percent, trees)
    gone = materialize(final.where("not kept").select("row"), "gone")
    return stored.join(gone, "row", "left_anti").select(*(F.col(n).alias(c) for c, n in names.items()))
