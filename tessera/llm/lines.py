"""Line dedup (12): sharded cuckoo filters backed by exact reference-count tables.

An index holds, for each key of a line, the number of documents that have it; documents can be added and taken
out again, and cleaning follows the index as it stands. A key is dropped where at least ``threshold`` documents have
it. Those frequent keys are kept in cuckoo filters as well, one for each shard of the hash space, so that a line is
judged without a join. A filter takes insertions and deletions: an update touches only the keys that
crossed the threshold, upwards or downwards. Against the reference counts a filter is exact: the keys below
the threshold that it would accept (of 32 bits a fingerprint, some two in 10^9) are listed beside it, by their text,
each time the counts change. So a line of an indexed document is dropped if and only if its key is frequent.

Counting moves each distinct key of a task once, with its number of documents, so that a line on a third of all pages
costs a row a task. Filters and exceptions are sent to all tasks if they take at most ``SENT`` bytes together;
beyond that, keys go to their shards instead (dealt over ``SPREAD`` tasks each) and only those that pass come back.

Key: the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z lower-cased. Keys shorter than ``min_chars`` code
points are neither counted nor dropped.

Defined cases: a document is a row; rows that repeat count each, a key that repeats within one counts once. A null
or empty text is one empty line. Null and repeated doc_ids are of no concern, as ids are only passed through. Taking out
more documents than have a key is an error, and leaves the index as it was. Other columns pass through ``clean``.
An empty table gives an empty index, which drops nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.scratch import filesystem, materialize, new_path, store

THRESHOLD, MIN_CHARS = 10, 1
#: Bytes of keys that a task counts before it hands them on; bytes of filters and exceptions that all tasks may get.
HELD, SENT = 16 << 20, 64 << 20
#: Frequent keys that a shard is laid out for, and tasks that its keys are dealt over.
SHARD_KEYS, SPREAD = 1 << 20, 16
_SEED = 42  # of Spark's xxhash64
_SLOTS, _KICKS, _LOAD = 4, 500, 0.85
_U = np.uint64


def key_of(line: bytes) -> bytes:
    """``strip`` and ``lower`` of bytes know exactly ``[\\x20\\x09-\\x0D]`` and A-Z."""
    return line.strip().lower()


def _keys(lines: list[bytes], min_chars: int) -> list[bytes]:
    keys = [key_of(line) for line in lines]
    return keys if min_chars < 2 else [k if len(k.decode()) >= min_chars else b"" for k in keys]


def key_hash(key: bytes) -> int:
    """As Spark's xxhash64 of the key, without its sign."""
    return xxhash.xxh64_intdigest(key, _SEED)


class CuckooFilter:
    """A set of 64-bit hashes as 32-bit fingerprints in buckets of four: the low half is the fingerprint, the high half
    picks the bucket, and either bucket of an entry follows from the other and the fingerprint."""

    def __init__(self, buckets: np.ndarray):
        self.table = buckets.reshape(-1, _SLOTS)

    @classmethod
    def over(cls, hashes: list[int]) -> CuckooFilter:
        """A filter with room for some more than ``hashes``."""
        n = 4
        while n * _SLOTS * _LOAD < 1.25 * len(hashes):
            n *= 2
        while True:
            made = cls(np.zeros(n * _SLOTS, np.uint32))
            if all(map(made.insert, hashes)):
                return made
            n *= 2

    @staticmethod
    def print_of(h: int) -> int:
        return (h & 0xFFFFFFFF) or 1

    def first(self, h: int) -> int:
        return (h >> 32) & (len(self.table) - 1)

    def other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 >> 7) & 0xFFFFFFFF & (len(self.table) - 1))

    def insert(self, h: int) -> bool:
        """False if there was no room: the filter has lost an entry then and must be laid out anew."""
        mark, bucket = self.print_of(h), self.first(h)
        for b in (bucket, self.other(bucket, mark)):
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return True
        for k in range(_KICKS):
            slot = k % _SLOTS
            self.table[bucket, slot], mark = mark, int(self.table[bucket, slot])
            bucket = self.other(bucket, mark)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, h: int) -> bool:
        mark, bucket = self.print_of(h), self.first(h)
        for b in (bucket, self.other(bucket, mark)):
            held = np.flatnonzero(self.table[b] == mark)
            if len(held):
                self.table[b, held[0]] = 0
                return True
        return False

    def accepts(self, hashes: np.ndarray) -> np.ndarray:
        """Of an array of hashes, which may be in the set: all that are, and few others."""
        last = _U(len(self.table) - 1)
        marks = hashes & _U(0xFFFFFFFF)
        marks[marks == 0] = 1
        first = (hashes >> _U(32)) & last
        second = first ^ ((marks * _U(0x5BD1E995) >> _U(7)) & _U(0xFFFFFFFF) & last)
        marks = marks.astype(np.uint32)[:, None]
        return (self.table[first.astype(np.int64)] == marks).any(1) | (self.table[second.astype(np.int64)] == marks).any(1)


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """By the hash's top bits; within a shard the bits below them pick the bucket."""
    return (hashes >> _U(64 - (shards.bit_length() - 1))).astype(np.int64) if shards > 1 else np.zeros(len(hashes), np.int64)


class Filters:
    """The filters of some shards: which hashes are accepted."""

    def __init__(self, shards: int, tables: dict[int, bytes]):
        self.shards = shards
        self.of = {s: CuckooFilter(np.frombuffer(b, np.uint32)) for s, b in tables.items()}

    def accepts(self, hashes: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(hashes), bool), _shard(hashes, self.shards)
        for s in np.unique(at).tolist():
            if s in self.of:
                mine = at == s
                out[mine] = self.of[s].accepts(hashes[mine])
        return out


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(key_hash, keys), np.uint64, len(keys))


def _texts(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[bytes]:
    for batch in batches:
        for text in batch.column(at).cast(pa.binary() if not pa.types.is_large_string(batch.schema.field(at).type) else pa.large_binary()):
            yield text.as_py() or b""


def _count_batches(min_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["key", "docs"])

        for text in _texts(batches):
            before = len(counts)
            counts.update({k for k in _keys(text.split(b"\n"), min_chars) if k})
            held += len(text) * (len(counts) > before)
            if held > HELD:
                yield out()
                counts.clear()
                held = 0
        yield out()

    return run


def key_counts(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Documents by key."""
    rows = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(_count_batches(max(1, min_chars)), "key binary, docs bigint")
    return rows.groupBy("key").agg(F.sum("docs").alias("docs"))


def _shard_column(shards: int):
    return F.shiftrightunsigned("hash", 64 - (shards.bit_length() - 1)) if shards > 1 else F.lit(0).cast("bigint")


class LineIndex:
    """Reference counts and filters of a set of documents, in the shared folder. Versions are written whole before they
    take the place of the last, so a lost task or driver leaves the one before intact."""

    def __init__(self, spark: SparkSession, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS):
        self.spark, self.threshold, self.min_chars, self.shard_keys = spark, threshold, max(1, min_chars), shard_keys
        self.shards = 1
        #: key, docs, hash; shard, filter; key
        self.counts: DataFrame | None = None
        self.filters: DataFrame | None = None
        self.exceptions: DataFrame | None = None
        self._filter_path = ""
        self.changes: dict[str, int] = {}  # of the last update: keys that became frequent, and ceased to be, filters laid out

    def insert(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """Add the rows of ``docs``."""
        return self._update(docs, text, 1)

    def delete(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """Take the rows of ``docs`` out again."""
        return self._update(docs, text, -1)

    def _update(self, docs: DataFrame, text: str, sign: int) -> LineIndex:
        change = key_counts(docs, text, self.min_chars).select("key", F.lit(0).cast("bigint").alias("was"), (sign * F.col("docs")).alias("more"))
        if self.counts is not None:
            change = self.counts.select("key", F.col("docs").alias("was"), F.lit(0).cast("bigint").alias("more")).union(change)
        merged = change.groupBy("key").agg(F.sum("was").alias("was"), (F.sum("was") + F.sum("more")).alias("docs"))
        counts = materialize(merged.withColumn("hash", F.xxhash64("key")), "line-counts")
        frequent, was = F.col("docs") >= self.threshold, F.col("was") >= self.threshold
        facts = counts.agg(F.min("docs"), F.count_if(frequent), F.count_if(frequent & ~was), F.count_if(was & ~frequent)).first()
        if (facts[0] or 0) < 0:
            raise ValueError("documents are to be taken out that the index does not hold")
        shards = self.shards
        while shards * self.shard_keys < facts[1]:
            shards *= 2
        filters, laid_out = self._updated_filters(counts.where(frequent | was), shards)
        self.counts, self.shards = counts.where("docs > 0").select("key", "docs", "hash"), shards
        self._filter_path, self.filters = filters
        self.changes = {"frequent": facts[2], "ceased": facts[3], "laid_out": laid_out}
        self.exceptions = materialize(self._accepted(self.counts.where(F.col("docs") < self.threshold).select("key", "hash")).select("key"), "line-exceptions")
        return self

    def _updated_filters(self, changed: DataFrame, shards: int) -> tuple[tuple[str, DataFrame], int]:
        """Each shard's filter with the hashes that enter and leave it; a shard's task sees its frequent keys' hashes,
        of which shards are laid out to have at most SHARD_KEYS on average."""
        threshold = self.threshold

        def run(rows: pa.Table, old: pa.Table) -> pa.Table:
            empty = pa.table({"shard": pa.array([], pa.int64()), "filter": pa.array([], pa.binary()), "fresh": pa.array([], pa.bool_())})
            if not rows.num_rows:
                return empty
            hashes = rows.column("hash").to_numpy().view(np.uint64)
            after, before = (set(hashes[rows.column(c).to_numpy() >= threshold].tolist()) for c in ("docs", "was"))
            made = None
            if old.num_rows:
                made = CuckooFilter(np.frombuffer(old.column("filter")[0].as_py(), np.uint32).copy())
                fits = all(map(made.delete, before - after)) and len(after) <= _LOAD * made.table.size and all(map(made.insert, after - before))
                made = made if fits else None
            fresh = made is None
            made = CuckooFilter.over(sorted(after)) if made is None else made
            return pa.table({"shard": rows.column("shard")[:1], "filter": pa.array([made.table.tobytes()], pa.binary()), "fresh": [fresh]})

        rows = changed.select(_shard_column(shards).alias("shard"), "hash", "was", "docs")
        old = self.filters if self.filters is not None and shards == self.shards else self.spark.createDataFrame([], "shard long, filter binary")
        path = new_path(self.spark, "line-filters")
        made = rows.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(run, "shard long, filter binary, fresh boolean")
        store(made, path)
        made = self.spark.read.parquet(path)
        return (path, made.select("shard", "filter")), made.where("fresh").count()

    def _accepted(self, rows: DataFrame) -> DataFrame:
        """Of rows with ``key`` and ``hash``, those whose key its shard's filter accepts."""
        at = rows.columns.index("hash")
        if (self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0) <= SENT:
            sent = self._send_filters()
            return rows.mapInArrow(_by_hash(at, lambda: Filters(*sent.value)), rows.schema)
        shards, path = self.shards, self._filter_path
        dealt = rows.withColumn("__shard", _shard_column(shards)).withColumn("__salt", F.pmod(F.xxhash64(*(c for c in rows.columns if c != "hash")), F.lit(SPREAD)))
        dealt = dealt.repartition("__shard", "__salt").sortWithinPartitions("__shard").drop("__salt")
        tested = dealt.mapInArrow(_by_shard(at, dealt.columns.index("__shard"), shards, path), dealt.schema)
        return tested.drop("__shard")

    def _send_filters(self):
        return self.spark.sparkContext.broadcast((self.shards, {r.shard: bytes(r.filter) for r in self.filters.toLocalIterator()}))

    def size(self) -> int:
        """Bytes of filters and exceptions."""
        one = lambda df, c: df.agg(F.sum(F.length(c))).first()[0] or 0
        return one(self.filters, "filter") + one(self.exceptions, "key")

    def frequent(self) -> DataFrame:
        """The keys that are dropped, with their documents."""
        return self.counts.where(F.col("docs") >= self.threshold).select(F.col("key").cast("string").alias("key"), "docs")

    def clean(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Rows of documents that the index holds, with their other columns, the text without its frequent lines,
        and ``n_lines`` and ``n_dropped`` (which take the place of columns so called)."""
        names = {c: f"__c{k}" for k, c in enumerate(docs.columns) if c not in ("n_lines", "n_dropped")}
        rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
        at = names[text]
        rows = rows.withColumn(at, F.coalesce(F.col(at).cast("string"), F.lit("")))
        if self.size() <= SENT:
            sent = self._send_filters()
            spared = self.spark.sparkContext.broadcast({bytes(r.key) for r in self.exceptions.toLocalIterator()})
            cleaned = rows.mapInArrow(_clean_batches(rows.columns.index(at), None, self.min_chars, lambda: (Filters(*sent.value), spared.value)), f"{_ddl(rows)}, n_lines long, n_dropped long")
        else:
            mark = [F.col(c).eqNullSafe(F.col(f"__of{c}")) for c in ("__mark", "__length")]
            rows = rows.withColumn("__mark", F.xxhash64(at)).withColumn("__length", F.octet_length(at))
            keys = rows.select("__mark", "__length", at).mapInArrow(_key_batches(self.min_chars), "__mark long, __length int, key binary, hash long")
            dropped = self._accepted(keys).join(self.exceptions, "key", "left_anti").groupBy("__mark", "__length").agg(F.collect_set("key").alias("__keys"))
            dropped = dropped.select(F.col("__mark").alias("__of__mark"), F.col("__length").alias("__of__length"), "__keys")
            rows = rows.join(dropped, mark, "left").drop("__mark", "__length", "__of__mark", "__of__length")
            cleaned = rows.mapInArrow(_clean_batches(rows.columns.index(at), rows.columns.index("__keys"), self.min_chars, None), f"{_ddl(rows.drop('__keys'))}, n_lines long, n_dropped long")
        return cleaned.select(*(F.col(n).alias(c) for c, n in names.items()), "n_lines", "n_dropped")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _by_hash(at: int, filters: Callable[[], Filters]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filters()
        for batch in batches:
            yield batch.filter(pa.array(known.accepts(batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64))))

    return run


def _by_shard(at: int, shard_at: int, shards: int, path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by shard: one shard's filter is held at a time, read from the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, inside = filesystem(path)
        loaded, known = None, None
        for batch in batches:
            found = np.zeros(batch.num_rows, bool)
            of = batch.column(shard_at).to_numpy(zero_copy_only=False)
            hashes = batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64)
            for s in np.unique(of).tolist():
                if s != loaded:
                    rows = pq.read_table(inside, filesystem=files, columns=["filter"], filters=[("shard", "=", s)]).column("filter").to_pylist()
                    loaded, known = s, Filters(shards, {s: b for b in rows})
                found[of == s] = known.accepts(hashes[of == s])
            yield batch.filter(pa.array(found))

    return run


def _key_batches(min_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows of two columns and a text to the same two with each distinct key and its hash, of distinct texts once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by(batch.schema.names).aggregate([])
            for part in table.to_batches(max_chunksize=256):
                keys = [sorted({k for k in _keys(t.split(b"\n"), min_chars) if k}) for t in _texts(iter([part]), 2)]
                rows = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
                flat = [k for ks in keys for k in ks]
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(flat, pa.binary()), pa.array(_hashes(flat).view(np.int64))], names=["__mark", "__length", "key", "hash"])

    return run


def _clean_batches(at: int, keys_at: int | None, min_chars: int, state: Callable[[], tuple[Filters, set[bytes]]] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, spared = state() if state else (None, None)
        for batch in batches:
            lines = [t.split(b"\n") for t in _texts(iter([batch]), at)]
            keys = [_keys(ls, min_chars) for ls in lines]
            if filters is not None:
                flat = [k for ks in keys for k in ks]
                accepted = filters.accepts(_hashes(flat))
                for k in np.flatnonzero(accepted).tolist():
                    accepted[k] = bool(flat[k]) and flat[k] not in spared
                ends = np.cumsum([0, *map(len, keys)])
                verdicts = [accepted[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
            else:
                dropped = [set(d or ()) for d in batch.column(keys_at).to_pylist()]
                verdicts = [[k in d for k in ks] for ks, d in zip(keys, dropped)]
            kept = [b"\n".join(line for line, gone in zip(ls, v) if not gone) for ls, v in zip(lines, verdicts)]
            columns = {batch.schema.names[k]: batch.column(k) for k in range(batch.num_columns) if k != keys_at}
            columns[batch.schema.names[at]] = pa.array(kept, pa.binary()).cast(pa.string())
            counts = [pa.array([len(ls) for ls in lines], pa.int64()), pa.array([sum(v) for v in verdicts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns.values(), *counts], names=[*columns, "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, text: str = "text") -> DataFrame:
    """``docs`` without the lines that at least ``threshold`` of them have."""
    return LineIndex(docs.sparkSession, threshold, min_chars).insert(docs, text).clean(docs, text)


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    rows = dedup_lines(docs.select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


#: The same rows in DuckDB's SQL.
ORACLE_SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM texts
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f USING (key) GROUP BY row
"""
