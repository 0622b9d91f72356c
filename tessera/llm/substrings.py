"""Substring dedup (6): a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words of one document. Neighbouring windows whose least 5-word hash
(their anchor) is the same travel as one entry: the 64-bit anchor, their count, and 40 bits of each
window's own hash, so a window is known by 104 bits (not by its words). The index is a list of immutable runs, each a table
of entries sorted by anchor within hash buckets. Every batch's entries are merge-joined, bucket by
bucket, with all runs and with each other; equal keys are verified on all 104 bits; the batch's own new
entries become the next run; and runs are compacted into one when there are too many. Buckets follow the
bytes of the first load.

Copies inside one task are resolved before the shuffle (only the smallest document's entry travels), so
a passage that a third of all documents share sends one entry per task.

Defined cases: null and empty texts have no words and come back as they are; texts shorter than a window
lose nothing; rows that share a doc_id are no copies of each other; a null doc_id counts as larger than
every other; other columns pass through.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.scratch import discard, materialize, new_path, shuffle_partitions, store
from tessera.llm.words import SPACE, Block, blocks, mix, ngram_hashes, span_hashes

WINDOW, ANCHOR = 13, 5
_U = np.uint64
_ANCHOR_FACTOR, _WINDOW_FACTOR = 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25
#: Entries that a task gathers before it resolves and sends them; bounds its memory.
_FLUSH = 600_000
#: Where a bulk load is cut into batches, as quantiles of doc_id: two older tenths, then the rest. The runs of the
#: first two are compacted into one, which the third meets.
CUTS, RUNS = (0.1, 0.2), 1
#: Bytes of text whose fingerprints make a bucket; a task holds one bucket at a time.
BUCKET_BYTES = 4 << 20
_LONGEST = 96  # windows in one entry
_ROWS = "kind int, part int, data binary"
_HIT, _ENTRY, _RUN = 0, 1, 2


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps([np.ascontiguousarray(a) for a in arrays], protocol=5), 1)


def _unpack(data: bytes) -> list[np.ndarray]:
    return pickle.loads(zstandard.decompress(data))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each count, in one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - begin, counts)


def block_entries(b: Block) -> tuple[np.ndarray, ...]:
    """row, first word in the row, windows, anchor and content hash of a block's entries, and the hashes of
    all their windows (32 and 8 bits)."""
    words, row = b.word_hashes(), b.row_of_word()
    m = len(words) - WINDOW + 1
    if m <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64), z.view(np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    low = ngram_hashes(words, ANCHOR, _ANCHOR_FACTOR)
    for step in (1, 2, 4, 1):  # the least of 2, 4, 8, 9 neighbours
        low = np.minimum(low[:-step], low[step:])
    at = np.flatnonzero(row[:m] == row[WINDOW - 1 :])
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64), z.view(np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (low[at[1:]] != low[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    if count.max() > _LONGEST:  # words that go on repeating
        pieces = -(-count // _LONGEST)
        step = _ranges(np.zeros(len(count), np.int64), pieces)
        first = np.repeat(first, pieces) + step * _LONGEST
        count = np.minimum(_LONGEST, np.repeat(count, pieces) - step * _LONGEST)
    start = at[first]
    content = span_hashes(words, start, start + count + WINDOW - 1)
    own = ngram_hashes(words, WINDOW, _WINDOW_FACTOR)[at]
    return row[start], start - b.word_at[row[start]], count, low[start], content, (own >> _U(32)).astype(np.uint32), (own & _U(255)).astype(np.uint8)


def _begins(count: np.ndarray) -> np.ndarray:
    """Where each entry's windows begin."""
    return np.cumsum(count.astype(np.int64)) - count


def _places(doc: np.ndarray, void: np.ndarray, old: np.ndarray | None = None) -> np.ndarray:
    """The places of documents in their order, equal ones the same: ascending ids, then those without one (``void``). Before
    them all, at 0, come entries of the index (``old``)."""
    order = np.lexsort((doc, void))
    step = np.ones(len(doc), np.int64)
    step[1:] = (doc[order][1:] != doc[order][:-1]) | (void[order][1:] != void[order][:-1])
    out = np.empty(len(doc), np.int64)
    out[order] = np.cumsum(step)
    if old is not None:
        out[old] = 0
    return out


class _Gathered:
    """Entries of one task, resolved among themselves when they are sent."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.n = buckets, [], 0

    def add(self, doc: np.ndarray, void: np.ndarray, mark: np.ndarray, entries: tuple[np.ndarray, ...]) -> None:
        row, start, count, anchor, content, wide, narrow = entries
        if len(row):
            self.parts.append((doc[row], void[row], mark[row], start.astype(np.int32), count.astype(np.int16), anchor, content, wide, narrow))
            self.n += len(row)

    def send(self) -> Iterator[tuple[int, int, bytes]]:
        if not self.n:
            return
        doc, void, mark, start, count, anchor, content, wide, narrow = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.n = [], 0
        place = _places(doc, void)
        order = np.lexsort((place, content))
        same = np.zeros(len(order), bool)  # by content, anchor and count: 64 bits alone would be too few
        same[1:] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (content, anchor, count)])
        least = place[order][np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        later = np.zeros(len(order), bool)
        later[order] = place[order] > least
        yield from _hits(doc[later], void[later], mark[later], start[later], count[later], self.buckets)
        begin = _begins(count)
        kept = np.flatnonzero(~later)
        part = (anchor[kept] % _U(self.buckets)).astype(np.int64)
        kept = kept[np.argsort(part, kind="stable")]
        bounds = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=self.buckets))))
        for k in np.flatnonzero(np.diff(bounds)):
            own = kept[bounds[k] : bounds[k + 1]]
            windows = _ranges(begin[own], count[own].astype(np.int64))
            yield _ENTRY, int(k), _pack(doc[own], void[own], mark[own], start[own], count[own], anchor[own], wide[windows], narrow[windows])


def _hits(doc: np.ndarray, void: np.ndarray, mark: np.ndarray, start: np.ndarray, count: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """Windows to remove, dealt out by document."""
    if not len(doc):
        return
    part = (mix(doc.astype(np.uint64) + mix(mark.astype(np.uint64)) + _U(5)) % _U(parts)).astype(np.int64)
    order = np.lexsort((start, mark, void, doc, part))
    bounds = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))
    for k in np.flatnonzero(np.diff(bounds)):
        own = order[bounds[k] : bounds[k + 1]]
        yield _HIT, int(k), _pack(doc[own], void[own], mark[own], start[own].astype(np.int32), count[own].astype(np.int16))


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, part, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(data, pa.binary())], names=["kind", "part", "data"])


def _in_batches(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if size > 4 << 20:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _entries_of(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            held = _Gathered(buckets)
            for batch in batches:
                doc = batch.column(0).to_numpy(zero_copy_only=False)
                void = batch.column(1).to_numpy(zero_copy_only=False)
                mark = batch.column(2).to_numpy(zero_copy_only=False)
                for b in blocks(batch.column(3)):
                    rows_of = slice(b.first, b.first + b.rows)
                    held.add(doc[rows_of], void[rows_of], mark[rows_of], block_entries(b))
                    if held.n >= _FLUSH:
                        yield from held.send()
            yield from held.send()

        return _in_batches(rows())

    return run


def _merged(blobs: list[bytes], old: list[bytes]) -> tuple[np.ndarray, ...]:
    """Entries of a batch and then of the index, and which are of the index."""
    parts = [_unpack(x) for x in blobs]
    new = sum(len(x[0]) for x in parts)
    for x in old:
        anchor, count, wide, narrow = _unpack(x)
        n = len(anchor)
        parts.append([np.zeros(n, np.int64), np.zeros(n, np.int8), np.zeros(n, np.int32), np.zeros(n, np.int32), count, anchor, wide, narrow])
    merged = [np.concatenate(x) for x in zip(*parts)]
    return *merged, np.arange(len(merged[0])) >= new


def resolve(place_of: np.ndarray, count: np.ndarray, anchor: np.ndarray, wide: np.ndarray, narrow: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: its entry and place in it, and whether an earlier document (by ``place_of``) has it."""
    entry = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(entry)) - _begins(count)[entry]
    lead = anchor[entry]
    key = mix(lead ^ ((wide.astype(np.uint64) << _U(8)) | narrow) * _U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")

    def equal() -> np.ndarray:
        a, b = order[1:], order[:-1]
        return (lead[a] == lead[b]) & (wide[a] == wide[b]) & (narrow[a] == narrow[b])

    k = key[order]
    same = k[1:] == k[:-1]
    if not np.array_equal(same, same & equal()):  # two windows with one key: sort on all that is known of them
        order = np.lexsort((narrow, wide, lead))
        same = equal()
    owner = place_of[entry][order]
    heads = np.flatnonzero(np.concatenate(([True], ~same)))[: len(order)]
    repeated = np.zeros(len(order), bool)
    if len(order):
        least = np.minimum.reduceat(owner, heads)
        repeated[order] = owner > np.repeat(least, np.diff(np.append(heads, len(order))))
    return entry, place, repeated


def _bucket_job(parts: int, keep_run: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by bucket; all of a bucket's rows are in one partition."""

    def close(part: int, blobs: dict[int, list[bytes]]) -> Iterator[tuple[int, int, bytes]]:
        for x in blobs.get(_HIT, []):
            yield _HIT, part, x
        if not blobs.get(_ENTRY):
            return
        doc, void, mark, start, count, anchor, wide, narrow, old = _merged(blobs[_ENTRY], blobs.get(_RUN, []))
        entry, place, repeated = resolve(_places(doc, void, old), count, anchor, wide, narrow)
        hit = np.flatnonzero(repeated)
        if len(hit):
            new = np.ones(len(hit), bool)
            new[1:] = (entry[hit][1:] != entry[hit][:-1]) | (place[hit][1:] != place[hit][:-1] + 1)
            first = np.flatnonzero(new)
            e = entry[hit][first]
            yield from _hits(doc[e], void[e], mark[e], start[e] + place[hit][first].astype(np.int32), np.diff(np.append(first, len(hit))), parts)
        if keep_run:
            seen = np.ones(len(count), bool)  # an entry is new unless each of its windows is in an older place
            known = np.bincount(entry[repeated], minlength=len(count)) == count
            seen[known] = False
            own = np.flatnonzero(seen & ~old)
            own = own[np.argsort(anchor[own], kind="stable")]
            windows = _ranges(_begins(count)[own], count[own].astype(np.int64))
            yield _RUN, part, _pack(anchor[own], count[own], wide[windows], narrow[windows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes]]:
            part, blobs = -1, {}
            for batch in batches:
                for kind, p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    if p != part:
                        if blobs:
                            yield from close(part, blobs)
                        part, blobs = p, {}
                    blobs.setdefault(kind, []).append(data)
            if blobs:
                yield from close(part, blobs)

        return _in_batches(rows())

    return run


def _spans_job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From all hits of a part to one row per document: first words and lengths of its spans to remove."""

    def close(blobs: list[bytes]) -> pa.RecordBatch:
        doc, void, mark, start, count = (np.concatenate(x) for x in zip(*map(_unpack, blobs)))
        order = np.lexsort((start, mark, void, doc))
        doc, void, mark, start, count = doc[order], void[order], mark[order], start[order], count[order]
        head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (void[1:] != void[:-1]) | (mark[1:] != mark[:-1]))))
        to = np.append(head, len(doc)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(x.astype(np.int32), pa.int32())) for x in (start, count)]
        return pa.RecordBatch.from_arrays([pa.array(doc[head], pa.int64()), pa.array(void[head], pa.int8()), pa.array(mark[head], pa.int32()), *lists], names=["__id", "__void", "__mark", "__start", "__count"])

    part, blobs = -1, []
    for batch in batches:
        for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if p != part and blobs:
                yield close(blobs)
                blobs = []
            part = p
            blobs.append(data)
    if blobs:
        yield close(blobs)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> list:
    """A row's id, whether it has none, and its text's hash: rows may share an id."""
    number = F.col(doc_id).cast("bigint")
    return [F.coalesce(number, F.lit(0)).alias("__id"), number.isNull().cast("tinyint").alias("__void"), F.hash(F.col(text)).alias("__mark")]


class FingerprintIndex:
    """Runs of fingerprints of everything that was added so far; ``paths`` names them, so an index can be
    kept and opened again."""

    def __init__(self, spark: SparkSession, paths: list[str] | None = None, buckets: int | None = None, max_runs: int = 4):
        self.spark, self.paths, self.max_runs, self.superseded = spark, list(paths or []), max_runs, []
        self.buckets = buckets or 2 * shuffle_partitions(spark)

    def _runs(self) -> DataFrame | None:
        runs = [self.spark.read.schema(_ROWS).parquet(p).where(F.col("kind") == _RUN) for p in self.paths]
        out = None
        for r in runs:
            out = r if out is None else out.unionByName(r)
        return out

    def add(self, batch: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
        """Spans of the batch's documents that the index or a smaller document of the batch has; the batch's
        fingerprints then join the index if ``keep``."""
        entries = batch.select(*_keyed(batch, doc_id, text), F.col(text).cast("string").alias("__text")).mapInArrow(_entries_of(self.buckets), _ROWS)
        runs = self._runs()
        rows = entries if runs is None else entries.unionByName(runs)
        found = rows.repartition(self.buckets, "part").sortWithinPartitions("part").mapInArrow(_bucket_job(self.buckets, keep), _ROWS)
        path = new_path(self.spark, "fingerprints")
        store(found, path)
        if keep:
            self.paths.append(path)
            if len(self.paths) > self.max_runs:
                self.compact()
        hits = self.spark.read.schema(_ROWS).parquet(path).where(F.col("kind") == _HIT).select("part", "data")
        spans = hits.repartition("part").sortWithinPartitions("part").mapInArrow(_spans_job, "__id bigint, __void tinyint, __mark int, __start array<int>, __count array<int>")
        return spans

    def compact(self) -> None:
        """Merge all runs into one."""
        path = new_path(self.spark, "fingerprints")
        store(self._runs().repartition(self.buckets, "part").sortWithinPartitions("part").mapInArrow(_compact_job, _ROWS), path)
        self.superseded += self.paths
        self.paths = [path]

    def forget(self) -> None:
        """Delete runs that compaction has replaced; to be called when the spans that ``add`` returned are stored."""
        for path in self.superseded:
            discard(path)
        self.superseded = []


def _compact_job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def close(part: int, blobs: list[bytes]) -> tuple[int, int, bytes]:
        anchor, count, wide, narrow = (np.concatenate(x) for x in zip(*map(_unpack, blobs)))
        begin = np.append(_begins(count), len(wide))
        content = span_hashes(((wide.astype(np.uint64) << _U(8)) | narrow) + _U(1), begin[:-1], begin[1:])
        order = np.lexsort((content, anchor))
        fresh = np.concatenate(([True], (anchor[order][1:] != anchor[order][:-1]) | (content[order][1:] != content[order][:-1])))
        own = order[fresh]
        windows = _ranges(begin[:-1][own], count[own].astype(np.int64))
        return _RUN, part, _pack(anchor[own], count[own], wide[windows], narrow[windows])

    def rows() -> Iterator[tuple[int, int, bytes]]:
        part, blobs = -1, []
        for batch in batches:
            for p, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if p != part and blobs:
                    yield close(part, blobs)
                    blobs = []
                part = p
                blobs.append(data)
        if blobs:
            yield close(part, blobs)

    return _in_batches(rows())


def _removed_words(b: Block, spans: list[tuple[np.ndarray, np.ndarray] | None]) -> np.ndarray:
    delta = np.zeros(len(b.starts) + 1, np.int32)
    for r, s in enumerate(spans):
        if s is not None:
            at = s[0].astype(np.int64) + b.word_at[r]
            np.add.at(delta, at, 1)
            np.add.at(delta, np.minimum(at + s[1] + WINDOW - 1, len(b.starts)), -1)
    return np.cumsum(delta[:-1]) > 0


def _cut_batches(full: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Columns: the ones to pass on, the text, and the spans' starts and counts. Adds n_words, n_removed and
    the kept words: joined by a space as a digest, or (``full``) as text with the white space byte before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *passed, text, starts, counts = batch.columns
            words, gone, kept = [], [], []
            spans = [None if s is None else (np.array(s), np.array(c)) for s, c in zip(starts.to_pylist(), counts.to_pylist())]
            texts = text if full else None
            for b in blocks(text):
                own = spans[b.first : b.first + b.rows]
                removed = _removed_words(b, own)
                solid = ~SPACE[b.data]
                keep = ~removed
                hide = np.zeros(len(b.data) + 1, np.int8)
                np.add.at(hide, b.starts[removed], 1)
                np.add.at(hide, b.ends[removed], -1)
                mask = solid & (np.cumsum(hide[:-1], dtype=np.int8) == 0)
                mask[b.starts[keep] - 1] = True
                totals = np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))
                left = totals[b.word_at[1:]] - totals[b.word_at[:-1]]
                some = np.flatnonzero(left)
                firsts = np.flatnonzero(keep)[totals[b.word_at[:-1][some]]]
                mask[b.starts[firsts] - 1] = False
                data = b.data if full else np.where(solid, b.data, np.uint8(32))
                out = data[mask].tobytes()
                size = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[b.row_start]
                words.append(b.n_words)
                gone.append(b.n_words - left)
                for r in range(b.rows):
                    piece = out[size[r] : size[r + 1]]
                    if full:
                        kept.append(piece.decode() if own[r] is not None else texts[b.first + r].as_py())
                    else:
                        kept.append(hashlib.sha256(piece).hexdigest())
            n = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (words, gone)]
            yield pa.RecordBatch.from_arrays([*passed, *n, pa.array(kept, pa.string())], names=[*batch.schema.names[:-3], "__words", "__removed", "__kept"])

    return run


def _fields(df: DataFrame) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cuts: tuple[float, ...] = CUTS, index: FingerprintIndex | None = None) -> DataFrame:
    """Spans of all documents, which enter the index in batches: ranges of doc_id that end near the quantiles
    ``cuts``. The result doesn't depend on these."""
    key = F.col(doc_id).cast("bigint")
    ends = F.percentile_approx(F.col(doc_id).cast("bigint"), F.lit(list(cuts)), 1000) if cuts else F.lit(None)
    facts = docs.agg(ends.alias("ends"), F.sum(F.octet_length(F.col(text).cast("string"))).alias("bytes")).first()
    ends = sorted(set(facts["ends"] or []))
    spark = docs.sparkSession
    index = index or FingerprintIndex(spark, buckets=max(shuffle_partitions(spark), -(-(facts["bytes"] or 0) // BUCKET_BYTES)), max_runs=RUNS)
    spans = None
    for low, high in zip([None, *ends], [*ends, None]):
        part = docs
        part = part if low is None else part.where((key > low) | (key.isNull() if high is None else F.lit(False)))  # no id: the last
        part = part if high is None else part.where(key <= high)
        own = materialize(index.add(part, doc_id, text, keep=high is not None), "spans")
        index.forget()
        spans = own if spans is None else spans.unionByName(own)
    return spans


def _with_spans(docs: DataFrame, passed: list[str], doc_id: str, text: str, cuts: tuple[float, ...], index: FingerprintIndex | None) -> DataFrame:
    spans = repeated_spans(docs, doc_id, text, cuts, index)
    chosen = docs.select(*passed, F.col(text).cast("string").alias("__text"), *_keyed(docs, doc_id, text))
    joined = chosen.join(spans, ["__id", "__void", "__mark"], "left")
    return joined.select(*passed, "__text", "__start", "__count")


def removal_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cuts: tuple[float, ...] = CUTS) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""
    joined = _with_spans(docs.select(doc_id, text), [doc_id], doc_id, text, cuts, None)
    schema = ", ".join([*_fields(docs.select(doc_id)), "__words bigint, __removed bigint, __kept string"])
    out = joined.mapInArrow(_cut_batches(False), schema)
    return out.select(doc_id, F.col("__words").alias("n_words"), F.col("__removed").alias("n_removed"), F.col("__kept").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cuts: tuple[float, ...] = CUTS, index: FingerprintIndex | None = None) -> DataFrame:
    """The documents with repeated passages cut out of their texts; texts without any stay as they are. Columns may be called
    anything."""
    names = {c: f"__c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    passed = [n for c, n in names.items() if c != text]
    joined = _with_spans(rows, passed, names[doc_id], names[text], cuts, index)
    schema = ", ".join([*_fields(rows.select(*passed)), "__words bigint, __removed bigint, __kept string"])
    out = joined.mapInArrow(_cut_batches(True), schema).withColumnRenamed("__kept", names[text])
    return out.select(*(F.col(n).alias(c) for c, n in names.items()))
