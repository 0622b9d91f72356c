"""Token counts (5): greedy word-piece lengths in linear time, without building pieces.

The vocabulary becomes a trie. Each node has a failure link and the number of pieces that are complete
once matching goes on along that link, both computed breadth first: a node that is a piece pops that one
piece and fails to the root; any other pops what its parent pops, and on along the links until the next
byte fits. A word is then read byte by byte, adding popped counts; its end pops the rest. Distinct words of
a block are walked together.

A word is read with a space before it, so pieces with a leading space start words. Words that the
vocabulary can't cover count as one piece, as an unknown word does.

Defined cases: null and empty texts have no words and no pieces; repeated rows count each; other columns
pass through; very long words take time in proportion to their length.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import blocks


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a rank file: base64 piece and rank on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Trie with failure links and popped counts, as arrays; node 0 is the root, -1 stands for none."""

    def __init__(self, vocabulary: list[bytes]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                nxt = children[node].get(byte)
                if nxt is None:
                    nxt = children[node][byte] = len(children)
                    children.append({})
                    final.append(False)
                node = nxt
            final[node] = node != 0
        fail, popped = [-1] * len(children), [0] * len(children)
        level = [(0, byte, node) for byte, node in children[0].items()]
        while level:
            for parent, byte, node in level:
                if final[node]:
                    fail[node], popped[node] = 0, 1
                    continue
                link, count = fail[parent], popped[parent]
                while link >= 0 and byte not in children[link]:
                    count += popped[link]
                    link = fail[link]
                fail[node], popped[node] = (children[link][byte], count) if link >= 0 else (-1, 0)
            level = [(node, byte, child) for _, _, node in level for byte, child in children[node].items()]
        edges = sorted((node << 8 | byte, child) for node, own in enumerate(children) for byte, child in own.items())
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.targets = np.array([t for _, t in edges], np.int32)
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int32)
        self.space = children[0].get(32, -1)

    def lengths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of " " + data[s:e] for each span."""
        n = len(starts)
        node = np.full(n, self.space, np.int64)
        count = np.zeros(n, np.int64)
        lost = node < 0
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        step = 0
        alive = order[~lost[order]]
        while len(alive):
            alive = alive[: np.searchsorted(-size[alive], -step)]  # still longer than step
            todo = alive
            byte = data[starts[todo] + step].astype(np.int64)
            while len(todo):
                key = (node[todo] << 8) | byte
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                fits = self.keys[at] == key
                node[todo[fits]] = self.targets[at[fits]]
                todo, byte = todo[~fits], byte[~fits]
                count[todo] += self.popped[node[todo]]
                node[todo] = self.fail[node[todo]]
                gone = node[todo] < 0
                if gone.any():
                    lost[todo[gone]] = True
                    todo, byte = todo[~gone], byte[~gone]
            if lost.any():
                alive = alive[~lost[alive]]
            step += 1
        rest = np.flatnonzero(~lost & (node > 0))
        while len(rest):
            count[rest] += self.popped[node[rest]]
            node[rest] = self.fail[node[rest]]
            lost[rest[node[rest] < 0]] = True
            rest = rest[node[rest] > 0]
        return np.where(lost, 1, count)


def _count_batches(shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            *passed, text = batch.columns
            words, pieces = [], []
            for b in blocks(text):
                _, first, again = np.unique(b.word_hashes(), return_index=True, return_inverse=True)
                each = automaton.lengths(b.data, b.starts[first], b.ends[first])[again] if len(first) else np.zeros(0, np.int64)
                sums = np.concatenate(([0], np.cumsum(each)))
                words.append(b.n_words)
                pieces.append(sums[b.word_at[1:]] - sums[b.word_at[:-1]])
            counts = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (words, pieces)]
            yield pa.RecordBatch.from_arrays([*passed, *counts], names=[*batch.schema.names[:-1], "__words", "__pieces"])

    return run


def piece_counts(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_words and n_pieces of each whole text; ``vocabulary`` is the path of a rank file."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(read_vocabulary(vocabulary)))  # as large as the vocabulary
    chosen = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema[:-1])
    out = chosen.mapInArrow(_count_batches(shared), fields + "__words bigint, __pieces bigint")
    return out.select(*keep, F.col("__words").alias("n_words"), F.col("__pieces").alias("n_pieces"))
