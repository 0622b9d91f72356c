"""Quality rules (7): adaptive limits from mergeable quantile sketches.

Per document, exact counts over the whole text; per language and source, one quantile sketch for each
ratio of these counts: documents by logarithmic bin (a known relative error), merged by adding counts, so
the result is the same in every order, partitioning and repeated task. The limits that replace fixed
cutoffs come from the sketches' quantiles alone (for the length of words on both sides), are joined
back, and decide.

Defined cases: a null or empty text has no words and fails the base rule; null ``lang`` or ``source``
form groups of their own; repeated rows are judged each alone; ties at a limit are kept; other
columns pass through, and the operator's own columns replace input columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import materialize
from tessera.llm.words import SPACE, Block, blocks, mix, ngram_hashes, span_hashes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_U = np.uint64


def _by_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _twice(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs at least twice."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def block_counts(b: Block) -> dict[str, np.ndarray]:
    """The five counts of each row of a block."""
    data, at = b.data, b.row_start
    # lines: the byte before each row and each \n part them
    cut = np.union1d(np.flatnonzero(data == 10), at[:-1])
    starts, ends = cut + 1, np.append(cut[1:], len(data))
    solid = np.concatenate(([0], np.cumsum(~SPACE[data], dtype=np.int64)))
    full = solid[ends] > solid[starts]
    row = (np.searchsorted(at, starts, "right") - 1)[full]
    lines = mix(span_hashes(data.astype(np.uint64) + _U(1), starts[full], ends[full]) ^ mix(row.astype(np.uint64) + _U(7)))
    order = np.lexsort((lines, row))
    again = (lines[order][1:] == lines[order][:-1]) & (row[order][1:] == row[order][:-1])
    dup_lines = np.bincount(row[order][1:][again], minlength=b.rows)

    row_of = b.row_of_word()
    words = b.word_hashes()
    repeat = np.zeros(len(words) + 2, bool)
    if len(words) >= 3:
        inside = np.flatnonzero(row_of[2:] == row_of[:-2])
        keys = mix(ngram_hashes(words, 3, 0xA24BAED4963EE407)[inside] ^ mix(row_of[inside].astype(np.uint64) + _U(11)))
        hit = inside[_twice(keys)]
        for k in range(3):
            repeat[hit + k] = True
    return {
        "n_words": b.n_words,
        "word_chars": _by_row(~SPACE[data] & ((data & 0xC0) != 0x80), at),
        "n_symbols": _by_row(_SYMBOL[data], at),
        "n_dup_lines": dup_lines,
        "n_repeat_words": _by_row(repeat[: len(words)], b.word_at),
    }


def _count_batches(text_at: int, keep_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [block_counts(b) for b in blocks(batch.column(text_at))]
            passed = [k for k in range(batch.num_columns) if keep_text or k != text_at]
            counts = [pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in passed), *counts], names=[*(batch.schema.names[k] for k in passed), *COUNTS])

    return run


def text_counts(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """The rows of ``docs``, without the text unless ``keep_text``, and the five counts of each whole text."""
    fields = [f for f in docs.schema if keep_text or f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{c} bigint" for c in COUNTS)])
    return docs.mapInArrow(_count_batches(docs.columns.index(text), keep_text), schema)


def _ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "word_length": F.col("word_chars") / n,
        "symbols": F.col("n_symbols") / n,
        "dup_lines": F.col("n_dup_lines") / n,
        "repeats": F.col("n_repeat_words") / n,
    }


#: A ratio is out of range beyond its group's median by more than SPREAD times a distance from the median:
#: upwards that to the lower quartile, which bad rows with high ratios don't move while they are fewer than
#: half; downwards the larger of those to the upper quartile and to the quantile 1 - TOP. Where the lower half is
#: one value (most texts have no symbols), the typical group's distance takes its place: the median over groups,
#: to the lower quartile or, if that is nothing too, to the quantile TOP. Groups of n rows on average tell it
#: as far as such a group has a row beyond the quantile TOP, 1 - TOP^n; for the rest all documents do.
SPREAD, TOP = 10.0, 0.9
AT = (1 - TOP, 0.25, 0.5, 0.75, TOP)
#: A count may exceed its limit by three standard deviations of a count of that size (of one, at least).
NOISE = 3.0
#: A group's own limits count for n / (n + PRIOR); for the rest those of the median of all documents with the
#: typical group's distances.
PRIOR = 20.0
#: Ratios of which too little is a fault too; of the others the least is none at all.
TWO_SIDED = ("word_length",)
RATIOS = ("word_length", "symbols", "dup_lines", "repeats")


#: A sketch tells a value to this relative error; values from 10^-6 to 10^3 fill at most some 10,000 bins.
ERROR = 0.001


def ratio_sketches(usable: DataFrame, by: list[str], error: float = ERROR) -> DataFrame:
    """Mergeable sketches by group, ``__ratio`` and ``__bin`` (null: zero): documents in ``__size``, the largest value
    in ``__top``. Sums of sizes and the largest tops merge them."""
    step = math.log((1 + error) / (1 - error))
    bins = [F.struct(F.lit(r).alias("__ratio"), F.when(c > 0, F.ceil(F.log(c) / step)).alias("__bin"), c.alias("__value")) for r, c in _ratios().items()]
    return usable.select(*by, F.inline(F.array(*bins))).groupBy(*by, "__ratio", "__bin").agg(F.count("*").alias("__size"), F.max("__value").alias("__top"))


def _quantiles(sketches: DataFrame, by: list[str], tag: str) -> DataFrame:
    """By group: documents, and each ratio's quantiles AT. Windows run over the bins of one ratio of one group."""
    merged = sketches.groupBy(*by, "__ratio", "__bin").agg(F.sum("__size").alias("__size"), F.max("__top").alias("__top"))
    group = Window.partitionBy(*by, "__ratio")
    placed = merged.select(
        *by, "__ratio", "__top",
        F.sum("__size").over(group.orderBy(F.col("__bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)).alias("__upto"),
        F.sum("__size").over(group).alias("__total"),
    )
    found = F.array(*(F.min(F.when(F.col("__upto") >= q * F.col("__total"), F.col("__top"))) for q in AT))
    by_ratio = placed.groupBy(*by, "__ratio").agg(F.max("__total").alias("__total"), found.alias("__found"))
    wide = [F.max(F.when(F.col("__ratio") == r, F.col("__found"))).alias(f"__{tag}_{r}") for r in RATIOS]
    return by_ratio.groupBy(*(F.col(c).alias(f"__by_{c}") for c in by)).agg(F.max("__total").alias(f"__{tag}_n"), *wide)


def group_limits(counts: DataFrame, by: tuple[str, ...], error: float = ERROR) -> DataFrame:
    """One row per group with documents that the base rules pass: ``__by_*``, and each ratio's
    ``__limit_low_*`` and ``__limit_high_*``. What a group's own spread adds must not lift a limit above that of all documents."""
    usable = counts.where(~F.col("base_failed"))
    sketches = materialize(ratio_sketches(usable, list(by), error), "sketches")
    own = _quantiles(sketches, list(by), "own")
    gaps = {"low": (2, 1), "top": (4, 2), "up": (3, 2), "bottom": (2, 0)}
    typical = own.agg(*(F.percentile_approx(F.col(f"__own_{r}")[i] - F.col(f"__own_{r}")[j], 0.5, 10_000).alias(f"__{g}_{r}") for r in RATIOS for g, (i, j) in gaps.items()), F.avg("__own_n").alias("__mean_n"))
    rows = own.crossJoin(F.broadcast(_quantiles(sketches, [], "all"))).crossJoin(F.broadcast(typical))  # one row each
    share = F.col("__own_n") / (F.col("__own_n") + PRIOR)
    known = 1 - F.pow(F.lit(TOP), F.col("__mean_n"))
    limits = []
    for r in RATIOS:
        bottom, low, mid, up = (F.col(f"__own_{r}")[k] for k in range(4))
        middle = F.col(f"__all_{r}")[2]
        group = {g: F.col(f"__{g}_{r}") for g in gaps}
        every = {g: F.col(f"__all_{r}")[i] - F.col(f"__all_{r}")[j] for g, (i, j) in gaps.items()}
        above, below = ([F.when(d["low"] > 0, d["low"]).otherwise(d["top"]) for d in (group, every)], [F.greatest(d["up"], d["bottom"]) for d in (group, every)])
        usual, under = (known * x + (1 - known) * y for x, y in (above, below))
        top, base = middle + SPREAD * usual, middle - SPREAD * under
        high = F.least(mid + SPREAD * F.when(mid > low, mid - low).otherwise(usual), F.greatest(mid, top))
        least = mid - SPREAD * F.greatest(up - mid, mid - bottom)
        limits += [(share * high + (1 - share) * top).alias(f"__limit_high_{r}"), (share * least + (1 - share) * base).alias(f"__limit_low_{r}")]
    return rows.select(*(f"__by_{c}" for c in by), *limits)


def _based(counts: DataFrame) -> DataFrame:
    n = F.col("n_words")
    return counts.withColumn("base_failed", (n < 50) | (100 * F.col("n_repeat_words") > 50 * n))


def judge(counts: DataFrame, limits: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Add ``kept`` to rows that have the five counts, ``base_failed`` and the ``by`` columns."""
    n = F.col("n_words")
    joined = counts.join(limits, [counts[c].eqNullSafe(limits[f"__by_{c}"]) for c in by], "left")
    fits = F.lit(True)
    for r, ratio in _ratios().items():
        high = F.col(f"__limit_high_{r}")
        noise = NOISE * F.sqrt(F.greatest(high * n, F.lit(1.0))) / F.greatest(n, F.lit(1))
        fits = fits & F.coalesce(ratio <= high + noise, F.lit(True))
        if r in TWO_SIDED:
            fits = fits & F.coalesce(ratio >= F.col(f"__limit_low_{r}") - noise, F.lit(True))
    return joined.select(*counts.columns, (~F.col("base_failed") & fits).alias("kept"))


def quality_verdicts(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per document: ``keys``, ``by``, the counts, ``base_failed`` and ``kept``."""
    chosen = docs.select(*dict.fromkeys([*keys, *by]), F.col(text).cast("string").alias("__text"))
    counts = _based(materialize(text_counts(chosen, "__text"), "quality-counts"))
    return judge(counts, materialize(group_limits(counts, by), "limits"), by)


def quality_filter(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The documents that pass, with their own columns and whatever these are called. Texts are counted twice, for
    the limits and for the verdicts: that moves and stores none of them."""
    names = {c: f"__c{k}" for k, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    groups = tuple(names[c] for c in by)
    seen = _based(materialize(text_counts(renamed.select(*groups, names[text]), names[text]), "quality-counts"))
    limits = materialize(group_limits(seen, groups), "limits")  # stored, its true size lets the planner broadcast it
    kept = judge(_based(text_counts(renamed, names[text], keep_text=True)), limits, groups).where("kept")
    return kept.select(*(F.col(n).alias(c) for c, n in names.items()))
