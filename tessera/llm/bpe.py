"""BPE encoding and decoding (3): a minimal acyclic transducer as lexicon, exact merges for the rest.

Word counts over all documents give the frequent words (at most ``LEXICON`` of them). The driver merges
these once and compiles them into a minimal acyclic automaton with shared suffixes; the number of words
passed on the way to a word is its place among the id outputs. Tasks get the compiled bytes, map them
from a file of their own that is unlinked at once, look words up in it, many at a time, and merge every
other word exactly. A bounded memo stands before both.

Defined cases: a null text is empty; an empty text has no ids; the special strings of the tokenizer file
become their ids wherever they stand in a text; long words are merged with a heap; texts with code points that
Python's Unicode tables don't list are cased and parted by the library's own tables; other columns pass.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import sys
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.scratch import materialize

LEXICON = 1 << 17
MEMO = 300_000
_BATCH_CHARS = 1 << 22
#: Bytes of the longest words that are merged side by side.
_SIDE_BY_SIDE = 48
#: Fixed values of the format: how the file's pre-tokenizer parts lower-cased text.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
_END = "</w>"
_BLANK = regex.compile(r"\p{White_Space}+")
_WIDE_BLANK = regex.compile(r"[^\p{ASCII}\P{White_Space}]")
_SEPARATOR = regex.compile("[\x1c-\x1f]")  # split() takes these for white space, the format doesn't
#: Stands before a special string among tokens; no lower-cased token has it.
_MARK = "S"


@functools.cache
def _unlisted() -> np.ndarray:
    """Marks code points that Python's tables don't list, as newer ones may: how these are cased and parted is asked of the
    tokenizers library itself."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _has_unlisted(text: str) -> bool:
    return bool(_unlisted()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it is visible, else the next free letter from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class Merges:
    """The tokenizer file's vocabulary and merge ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + _END] for c in letters]
        self.ranks = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.ranks[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])
        self.path, self.bytes_of, self._library = path, {c: b for b, c in enumerate(letters)}, None
        self._arrays = self._strings = None
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merge(self, word: str) -> list[int]:
        data = word.encode()
        ids = [self.inner[b] for b in data[:-1]]
        ids.append(self.last[data[-1]])
        if len(ids) > _SIDE_BY_SIDE:
            return self._merge_long(ids)
        ranks = self.ranks
        while len(ids) > 1:
            best, at = None, -1
            for i, pair in enumerate(zip(ids, ids[1:])):
                found = ranks.get(pair[0] << 20 | pair[1])
                if found is not None and (best is None or found < best):
                    best, at = found, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def merge_all(self, words: list[str]) -> list[bytes]:
        """``merge`` of many words, those of about one length side by side, as the bytes of 32-bit ids."""
        out, groups = [b""] * len(words), {}
        data = [w.encode() for w in words]
        for i, d in enumerate(data):
            groups.setdefault(-(-len(d) // 8) * 8, []).append(i)
        for width, at in groups.items():
            if width > _SIDE_BY_SIDE:
                for i in at:
                    out[i] = np.array(self.merge(words[i]), np.int32).tobytes()
                continue
            for rows, ids in self._merged([data[i] for i in at], width):
                size = (ids >= 0).sum(1)
                flat, ends = ids[ids >= 0].tobytes(), (np.cumsum(size) * 4).tolist()
                for row, start, end in zip(rows.tolist(), [0, *ends], ends):
                    out[at[row]] = flat[start:end]
        return out

    def _merged(self, data: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows as they are done, and their ids (then -1): in each step every row merges the first of its pairs of least rank."""
        pairs, ranks, merged, inner, last = self.arrays()
        none = len(merged)

        def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = a.astype(np.int64) << 20 | b
            at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
            return np.where((b >= 0) & (pairs[at] == key), ranks[at], none)

        size, columns = np.array([len(d) for d in data]), np.arange(width)
        flat, rows = np.frombuffer(b"".join(data), np.uint8), np.arange(len(data))
        ids = np.full((len(data), width), -1, np.int32)
        ids[columns < size[:, None]] = inner[flat]
        ids[rows, size - 1] = last[flat[np.cumsum(size) - 1]]
        found = np.full(ids.shape, none)
        found[:, :-1] = rank(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at, here = found.argmin(1), np.arange(len(rows))
            best = found[here, at]
            going = best < none
            if not going.all():
                yield rows[~going], ids[~going]
                rows, ids, found, at, best = rows[going], ids[going], found[going], at[going], best[going]
                here = np.arange(len(rows))
            if not len(rows):
                break
            ids[here, at] = merged[best]
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids, found = np.take_along_axis(ids, source, 1), np.take_along_axis(found, source, 1)
            ids[:, -1], found[:, -1] = -1, none
            after = np.minimum(at + 1, width - 1)
            found[here, at] = np.where(after > at, rank(ids[here, at], ids[here, after]), none)
            inside = np.flatnonzero(at > 0)
            found[inside, at[inside] - 1] = rank(ids[inside, at[inside] - 1], ids[inside, at[inside]])

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Pairs, ascending, and their ranks; what each rank merges to; ids of bytes inside and at the end of a word."""
        if self._arrays is None:
            pairs = np.array(sorted(self.ranks), np.int64)
            ranks = np.array([self.ranks[p][0] for p in pairs.tolist()])
            merged = np.zeros(int(ranks.max(initial=-1)) + 1, np.int32)
            merged[ranks] = [self.ranks[p][1] for p in pairs.tolist()]
            self._arrays = pairs, ranks, merged, np.array(self.inner, np.int32), np.array(self.last, np.int32)
        return self._arrays

    def strings(self) -> tuple[pa.Array, pa.Array]:
        """Of each id, its decimal and its string."""
        if self._strings is None:
            ids = range(max(self.tokens) + 1)
            self._strings = pa.array(map(str, ids), pa.large_string()), pa.array([self.tokens.get(i, "") for i in ids], pa.large_string())
        return self._strings

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.ranks.get(ids[i] << 20 | ids[j])):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merged, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]

    def lowered(self, text: str) -> str:
        """The text in lower case, its white space in ASCII. Lower-casing goes letter by letter: no special final sigma."""
        if text.isascii():
            return text.lower()
        if _has_unlisted(text):
            return self.library().normalizer.normalize_str(text)
        return _WIDE_BLANK.sub(" ", unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def tokens_of(self, text: str) -> list[str]:
        """Lower-cased runs without white space, which no piece crosses."""
        text = self.lowered(text)
        return text.split() if _SEPARATOR.search(text) is None else [t for t in _BLANK.split(text) if t]

    def tokens_in(self, texts: list[str | None]) -> tuple[np.ndarray, pa.DictionaryArray]:
        """The tokens of all texts in a row, special strings marked, and where each text's begin and end."""
        plain = [self.lowered(t or "") if "<" not in (t or "") else " ".join([_MARK + s if s is not None else self.lowered(p) for s, p in self.parts(t)]) for t in texts]
        parted = pc.ascii_split_whitespace(pa.array(plain, pa.large_string()))
        real = pc.greater(pc.binary_length(parted.values), 0)
        before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
        return before[parted.offsets.to_numpy()], parted.values.filter(real).dictionary_encode()

    def pieces_of(self, token: str) -> list[str]:
        if token.isalpha():
            return [token]
        if not token.isprintable() and _has_unlisted(token):  # what isn't listed isn't printable
            parts = (p for p, _ in self.library().pre_tokenizer.pre_tokenize_str(token))
            return [bytes(self.bytes_of[c] for c in p).decode() for p in parts]
        return _PIECE.findall(token)

    def library(self) -> Tokenizer:
        """The file as the tokenizers library reads it."""
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
        return self._library

    def parts(self, text: str) -> Iterator[tuple[str | None, str]]:
        """Plain stretches as (None, text), special strings as (string, "")."""
        at = 0
        if self.at_special is not None and "<" in text:
            for m in self.at_special.finditer(text):
                yield None, text[at : m.start()]
                yield m[0], ""
                at = m.end()
        yield None, text[at:]


_merges: dict[str, Merges] = {}


def merges_of(path: str) -> Merges:
    if path not in _merges:
        _merges[path] = Merges(path)
    return _merges[path]


def compile_lexicon(words: list[str], outputs: list[list[int]]) -> bytes:
    """A minimal acyclic automaton over the UTF-8 bytes of ``words`` (in ascending byte order), built word by
    word: when a word leaves the last one's path, the states left behind are final and are replaced by equal
    ones that exist. Layout: five lengths, then edge keys (state << 8 | byte, ascending), targets, words
    skipped by taking an edge, final flags, output bounds and outputs."""
    register: dict[tuple, int] = {}
    done: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # final, [(byte, state)]
    last = b""

    def close(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(done)
            done.append(key)
        return register[key]

    def cut(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            path[-1][1].append((last[len(path) - 1], close(state)))

    for w in words:
        data = w.encode()
        common = len(os.path.commonprefix([last, data]))
        cut(common)
        for _ in data[common:]:
            path.append([False, []])
        path[-1][0] = True
        last = data
    cut(0)
    root = close(path[0])
    reach = np.zeros(len(done), np.int64)
    keys, targets, skips = [], [], []
    for s, (final, edges) in enumerate(done):  # children are closed before their parents
        n = int(final)
        for byte, t in edges:
            keys.append(s << 8 | byte)
            targets.append(t)
            skips.append(n)
            n += int(reach[t])
        reach[s] = n
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in outputs]))).astype(np.int32)
    flat = np.array([i for x in outputs for i in x], np.int32)
    arrays = [np.array(keys, np.int64), np.array(targets, np.int32), np.array(skips, np.int32), np.array([f for f, _ in done], np.uint8), bounds, flat]
    head = np.array([root, *(len(a) for a in arrays)], np.int64)
    return head.tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """The compiled automaton, mapped from a file."""

    def __init__(self, data: bytes):
        fd, name = tempfile.mkstemp(prefix="lexicon-")
        with os.fdopen(fd, "wb") as f:
            f.write(data)
        mapped = np.memmap(name, np.uint8, "r")
        os.unlink(name)  # the mapping stays
        head = mapped[:56].view(np.int64)
        self.root, at, views = int(head[0]), 56, []
        for n, kind in zip(head[1:].tolist(), (np.int64, np.int32, np.int32, np.uint8, np.int32, np.int32)):
            size = n * np.dtype(kind).itemsize
            views.append(np.frombuffer(mapped, kind, n, at))
            at += size
        self.keys, self.targets, self.skips, self.final, self.bounds, self.outputs = views

    def find(self, words: list[str]) -> list[list[int] | None]:
        """The ids of each word, or None where the automaton doesn't accept it."""
        data = [w.encode() for w in words]
        size = np.array([len(d) for d in data], np.int64)
        flat = np.frombuffer(b"".join(data), np.uint8)
        begin = np.cumsum(size) - size
        state, passed = np.full(len(words), self.root), np.zeros(len(words), np.int64)
        alive = np.arange(len(words)) if len(self.keys) else np.zeros(0, np.int64)
        dead = np.ones(len(words), bool)
        dead[alive] = False
        step = 0
        while len(alive):
            alive = alive[size[alive] > step]
            if not len(alive):
                break
            key = (state[alive] << 8) | flat[begin[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            dead[alive[~ok]] = True
            alive, at = alive[ok], at[ok]
            state[alive] = self.targets[at]
            passed[alive] += self.skips[at]
            step += 1
        good = ~dead & (self.final[state] == 1)
        return [self.outputs[self.bounds[p] : self.bounds[p + 1]].tolist() if g else None for g, p in zip(good.tolist(), passed.tolist())]


class Encoder:
    """Encodes texts in one task. The ids of tokens and pieces are kept as bytes, which join. Words of the lexicon stay known; the
    rest is forgotten when it is much."""

    def __init__(self, path: str, lexicon: bytes, digest: bool):
        self.merges, self.lexicon, self.digest = merges_of(path), Lexicon(lexicon), digest
        self.ids = {_MARK + s: np.array([i], np.int32).tobytes() for s, i in self.merges.special.items()}
        self.lasting = dict(self.ids)

    def _learn(self, tokens: list[str]) -> None:
        fresh = [t for t in tokens if t not in self.ids]
        if len(self.ids) + len(fresh) > MEMO:
            self.ids = dict(self.lasting)
            fresh = [t for t in tokens if t not in self.ids]
        parted = {t: self.merges.pieces_of(t) for t in fresh}
        pieces = [*{p for own in parted.values() for p in own}.difference(self.ids)]
        rest = []
        for p, ids in zip(pieces, self.lexicon.find(pieces)):
            if ids is None:
                rest.append(p)
                continue
            self.ids[p] = np.array(ids, np.int32).tobytes()
            if len(self.lasting) <= LEXICON:
                self.lasting[p] = self.ids[p]
        self.ids.update(zip(rest, self.merges.merge_all(rest)))
        for t, own in parted.items():
            if len(own) != 1 or own[0] != t:
                self.ids[t] = b"".join([self.ids[p] for p in own])

    def encoded(self, texts: list[str | None]) -> tuple[np.ndarray, list[pa.Array]]:
        """How many ids each text has, and either all ids in a row or, of each text, ids and strings joined by a space."""
        bounds, tokens = self.merges.tokens_in(texts)
        words = tokens.dictionary.to_pylist()
        self._learn(words)
        known = [self.ids[w] for w in words]
        ends = np.cumsum([0, *map(len, known)]) // 4
        passed = np.concatenate(([0], np.cumsum(np.diff(ends)[tokens.indices.to_numpy()])))[bounds]
        ids = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.frombuffer(b"".join(known), np.int32))).take(tokens.indices).flatten()
        if not self.digest:
            return np.diff(passed), [ids]
        of_text = lambda strings: pa.LargeListArray.from_arrays(pa.array(passed, pa.int64()), strings.take(ids))
        return np.diff(passed), [pc.binary_join(of_text(x), pa.scalar(" ", pa.large_string())) for x in self.merges.strings()]


def _sha256(texts: pa.Array) -> list[str]:
    """Lowercase hex, of each text's bytes."""
    bounds, data = texts.buffers()[1], texts.buffers()[2]
    ends = np.frombuffer(bounds, np.int64, len(texts) + 1, texts.offset * 8).tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])]


def _in_bits(texts: list[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size > _BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _count_batches(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(merges: Merges, tokens: Counter) -> pa.RecordBatch:
        seen: dict[str, int] = {}
        for token, n in tokens.items():
            for p in merges.pieces_of(token):
                seen[p] = seen.get(p, 0) + n
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, tokens = merges_of(path), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for special, plain in merges.parts(text or ""):
                    if special is None:
                        tokens.update(merges.tokens_of(plain))
                if len(tokens) > 2 * MEMO:
                    yield rows(merges, tokens)
                    tokens = Counter()
        if tokens:
            yield rows(merges, tokens)

    return run


def frequent_words(docs: DataFrame, path: str, text: str = "text", most: int = LEXICON) -> list[str]:
    """The words that occur at least so often that no more than ``most`` do, counted over all whole texts."""
    counted = docs.select(F.col(text).cast("string")).mapInArrow(_count_batches(path), "word string, n bigint")
    level = F.floor(F.log2(F.col("n")) * 4).cast("int")
    totals = materialize(counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").withColumn("level", level), "words")
    kept, least = 0, None
    for row in totals.groupBy("level").count().orderBy(F.desc("level")).collect():  # at most 256 levels
        kept += row["count"]
        if kept > most:
            break
        least = row["level"]
    if least is None:
        return []
    return sorted((r["word"] for r in totals.where(F.col("level") >= least).select("word").collect()), key=str.encode)


def build_lexicon(docs: DataFrame, path: str, text: str = "text", most: int = LEXICON) -> bytes:
    words = frequent_words(docs, path, text, most)
    merges = merges_of(path)
    return compile_lexicon(words, [merges.merge(w) for w in words])


def _encode_batches(path: str, shared: object, digest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, shared.value, digest)
        for batch in batches:
            *passed, text = batch.columns
            at = 0
            for texts in _in_bits(text.to_pylist()):
                n, made = encoder.encoded(texts)
                columns = [c.slice(at, len(texts)) for c in passed]
                at += len(texts)
                names = [*batch.schema.names[:-1], "__n", "__ids"]
                if digest:
                    sums = [pa.array(_sha256(x), pa.string()) for x in made]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), *sums], names=[*names, "__back"])
                else:
                    bounds = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), made[0])], names=names)

    return run


def _decode_batches(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = merges_of(path).tokens
        for batch in batches:
            *passed, ids = batch.columns
            texts = [" ".join([tokens[i] for i in x or [] if i in tokens]) for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([*passed, pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "__text"])

    return run


def _fields(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)


def _encoded(docs: DataFrame, path: str, text: str, passed: list[str], digest: bool, lexicon: bytes | None) -> DataFrame:
    spark = docs.sparkSession
    data = build_lexicon(docs, path, text) if lexicon is None else lexicon
    shared = spark.sparkContext.broadcast(data)  # bounded by LEXICON words
    chosen = docs.select(*passed, F.col(text).cast("string").alias("__text"))
    more = "__n bigint, __ids string, __back string" if digest else "__n bigint, __ids array<int>"
    return chosen.mapInArrow(_encode_batches(path, shared, digest), _fields(chosen.drop("__text")) + more)


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), lexicon: bytes | None = None) -> DataFrame:
    """``keep``, n_tokens and ids (array of int) of each whole text."""
    out = _encoded(docs, path, text, list(keep), False, lexicon)
    return out.select(*keep, F.col("__n").alias("n_tokens"), F.col("__ids").alias("ids"))


def decode(encoded: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the text that the ids stand for: their strings joined by one space, as the file has no
    decoder; unknown ids are passed over."""
    chosen = encoded.select(*keep, ids)
    return chosen.mapInArrow(_decode_batches(path), _fields(chosen.drop(ids)) + "__text string").withColumnRenamed("__text", "text")


def round_trip_digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", lexicon: bytes | None = None) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (decimal, joined by one space) and of what they decode to."""
    out = _encoded(docs, path, text, [doc_id], True, lexicon)
    return out.select(doc_id, F.col("__n").alias("n_tokens"), F.col("__ids").alias("ids_sha256"), F.col("__back").alias("decoded_sha256"))
