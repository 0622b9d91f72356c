"""Filter interaction audit (11): what each filter removes in every order of the filters.

Each document gets a mask, one bit a filter. All bits but that of exact copies come from its own text. Copies
are found by a fingerprint-routed RDD: rows are dealt to partitions by the xxhash of their text and sorted by
it there; the rows of one fingerprint form a collision chain that keeps each full text once with its least id,
and every row that turns out not to be the least goes on with its bit set. A task resolves the copies among
its own rows before anything is routed, ``HELD`` bytes of text at a time: a text that fills a third of the
table is routed once by each such batch, without the rows that lost there, and no chain holds more
than one copy of a text. ``combineByKey`` then merges vectors of documents by mask, one vector a part, and as masks
tell everything that an order of filters can do, all orders are read off the 32 counts of a part.

Defined cases: a null text is an empty one, a null part the empty string; a null doc_id has no order: such a row is
no copy and makes none; rows that share text and least id are none either, repeated rows count each; labels
repeated for a doc_id count once, as 1 if one of them is; labels of null doc_ids or null values count as 0;
other columns are not read, whatever they are called. Empty tables give no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import shuffle_partitions

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
#: Bytes of text that a task holds before it routes what it has, and that a partition is laid out for.
HELD, PART = 32 << 20, 32 << 20
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_CAPITALS, _MARKS = bytes(range(65, 91)), b"#$%&*|"


def own_mask(data: bytes) -> int:
    """The bits A to D of a text in UTF-8. ``bytes.split`` parts at exactly ``[\\x20\\x09-\\x0D]``."""
    words = data.split()
    chars = len(data) if data.isascii() else len(data.decode())
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * (len(data) - len(data.translate(None, _CAPITALS))) > 3 * chars) << 2
        | (len(data) != len(data.translate(None, _MARKS))) << 3
    )


class Chain:
    """The texts of one fingerprint, each once: [text, least id, own mask, rows of that id by part]."""

    def __init__(self) -> None:
        self.links: list[list] = []

    def add(self, text: bytes, doc_id: int, mask: int | None, parts: dict[str, int]) -> Iterator[tuple[int, str, int, int]]:
        """Take rows of one text and id in; yields (id, part, mask, rows) of those that are known to be copies."""
        for link in self.links:
            if link[0] == text:
                if doc_id == link[1]:
                    for part, n in parts.items():
                        link[3][part] = link[3].get(part, 0) + n
                    return
                lost_id, lost = (doc_id, parts) if doc_id > link[1] else (link[1], link[3])
                if doc_id < link[1]:
                    link[1], link[3] = doc_id, parts
                for part, n in lost.items():
                    yield lost_id, part, link[2] | COPY, n
                return
        self.links.append([text, doc_id, own_mask(text) if mask is None else mask, parts])


def _spread(doc_id: int | None) -> int:
    return xxhash.xxh64_intdigest(str(doc_id))


def route(rows: Iterator[tuple[int | None, str | None, str | None]]) -> Iterator[tuple[int, tuple]]:
    """From (id, part, text) to (fingerprint, (text, id, mask, part, rows)) of what this task can't decide, and
    (any number, (None, id, mask, part, rows)) of what it can."""
    chains: dict[int, Chain] = {}
    held = 0

    def release() -> Iterator[tuple[int, tuple]]:
        for key, chain in chains.items():
            for text, doc_id, mask, parts in chain.links:
                for part, n in parts.items():
                    yield key, (text, doc_id, mask, part, n)
        chains.clear()

    for doc_id, part, text in rows:
        data, part = (text or "").encode(), part or ""
        if doc_id is None:
            yield _spread(None), (None, None, own_mask(data), part, 1)
            continue
        key = xxhash.xxh64_intdigest(data)
        chain = chains.setdefault(key, Chain())
        known = len(chain.links)
        for lost_id, lost_part, mask, n in chain.add(data, doc_id, None, {part: 1}):
            yield _spread(lost_id), (None, lost_id, mask, lost_part, n)
        if len(chain.links) > known:
            held += len(data)
        if held > HELD:
            yield from release()
            held = 0
    yield from release()


def settle(routed: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int | None, str, int, int]]:
    """(id, part, mask, rows) of rows sorted by fingerprint: one chain is held at a time."""

    def least(chain: Chain) -> Iterator[tuple[int, str, int, int]]:
        return ((doc_id, part, mask, n) for _, doc_id, mask, parts in chain.links for part, n in parts.items())

    at, chain = None, Chain()
    for key, (text, doc_id, mask, part, n) in routed:
        if text is None:
            yield doc_id, part, mask, n
            continue
        if key != at:
            yield from least(chain)
            at, chain = key, Chain()
        yield from chain.add(text, doc_id, mask, {part: n})
    yield from least(chain)


def document_masks(docs: DataFrame, doc_id: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    """One row per document, repeated rows summed in ``docs``: doc_id, part, mask, docs."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{part}`").cast("string"), F.col(f"`{text}`").cast("string").alias("text"))
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # nothing sizes an RDD's partitions at run time
    routed = chosen.rdd.mapPartitions(route).repartitionAndSortWithinPartitions(max(shuffle_partitions(spark), -(-size // PART)), partitionFunc=int)
    return spark.createDataFrame(routed.mapPartitions(settle), "doc_id long, part string, mask int, docs long", verifySchema=False)


def _vector(row: tuple[int, int, int, int]) -> np.ndarray:
    return _count(np.zeros((3, MASKS), np.int64), row)


def _count(vector: np.ndarray, row: tuple[int, int, int, int]) -> np.ndarray:
    mask, good, toxic, n = row
    vector[:, mask] += (n, n * good, n * toxic)
    return vector


def _by_part(part: str) -> int:
    return xxhash.xxh32_intdigest(part)


def orders(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """The rows of SCHEMA for one part, from its documents by mask: all, good and toxic ones."""
    masks = np.arange(MASKS)
    docs, good, toxic = counts
    has = [(masks >> k & 1).astype(bool) for k in range(len(FILTERS))]
    found, shapley = [], [0] * len(FILTERS)
    for order in itertools.permutations(range(len(FILTERS))):
        gone = np.zeros(MASKS, bool)
        for step, f in enumerate(order, 1):
            lost = has[f] & ~gone
            redundant = int(docs[has[f] & gone].sum())
            gone = gone | has[f]
            removed = int(docs[lost].sum())
            shapley[f] += removed
            found.append(("".join(FILTERS[k] for k in order), step, int(docs[~gone].sum()), removed, redundant, int(docs[1 << f]), int(good[lost].sum()), int(toxic[lost].sum()), f))
    return ((part, *row[:-1], shapley[row[-1]]) for row in found)


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    """One row per part, order of the filters and step (SCHEMA)."""
    spark = docs.sparkSession
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    marks = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    masks = document_masks(docs, doc_id, part, text).join(marks, "doc_id", "left")
    rows = masks.select("part", F.struct("mask", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)), "docs")).rdd
    vectors = rows.map(tuple).combineByKey(_vector, _count, np.add, shuffle_partitions(spark), partitionFunc=_by_part)
    return spark.createDataFrame(vectors.flatMap(lambda x: orders(*x)), SCHEMA, verifySchema=False)


#: The same rows in DuckDB's SQL.
ORACLE_SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), counted AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM texts
), failing AS (
  SELECT doc_id, part,
         (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask
  FROM counted
), masks AS (
  SELECT part, mask, count(*) AS docs, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM failing LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), letters(letter, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5
), steps AS (
  SELECT filter_order, step, bit,
         (SELECT coalesce(sum(bit), 0) FROM letters WHERE contains(filter_order[:step - 1], letter))::INT AS earlier
  FROM orders, range(1, 6) s(step), letters WHERE filter_order[step] = letter
), rows AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(docs) FILTER (WHERE mask & (earlier | bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(docs) FILTER (WHERE mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
         coalesce(sum(docs) FILTER (WHERE mask & bit > 0 AND mask & earlier > 0), 0)::BIGINT AS redundant,
         coalesce(sum(docs) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM rows
"""
