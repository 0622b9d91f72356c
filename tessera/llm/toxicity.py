"""Toxicity (9): weak supervision.

Voters look at a text: a fixed lexicon, words and word beginnings that labelled rows of the learning fold
single out, how dense these are, and patterns of writing; others vote "clean" where their kind of evidence
is missing. Learned evidence must stand in many different surroundings: what copies of one text share doesn't
count again. Vote patterns of all documents are counted; from these counts, and the labels of the learning
fold, a generative label model estimates, by EM, every voter's behaviour for toxic and clean texts, with the
weight of voters that vote alike (beyond what their class explains) shared between them. Its posterior labels
profiles of evidence, on which a linear classifier is trained: the most frequent ones and a weighted sample of
the rest. Only rows whose ``crc32(doc_id) mod 3`` isn't 1 teach.

Bounds, all on what the classifier learns from: ``LEARN_ROWS`` labelled rows and ``TRAIN_ROWS`` profiles. The
number of vote patterns is bounded by the voters themselves: three states for each of five lengths of
beginnings, at most 15 for words, two each for lexicon and shouting: 14,580.

Defined cases: a null or empty text has no evidence and gets the score of none; rows without a label only
vote; repeated rows count each; a null doc_id is outside the held-out fold and never labelled; without any
toxic label the fixed lexicon votes alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import materialize

#: Fixed lexicon of insults.
LEXICON = ("clown", "disgusting", "dumb", "freak", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
PREFIXES = (3, 4, 5, 6, 7)
#: At most so many labelled rows (in hash order) teach the evidence, and so many profiles the classifier.
LEARN_ROWS, TRAIN_ROWS = 60_000, 20_000
#: Characters on either side of a word that tell its surroundings apart.
AROUND = 12
#: How many unlabelled documents a labelled one counts for in the label model.
LABEL_WEIGHT = 3.0
PARTS = 3  # voters that the learned words, and each length of beginnings, are dealt to
_WORD = regex.compile(r"\p{L}+")


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _learn_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each word and word beginning, by label."""
    seen: dict[str, list[int]] = {}

    def rows() -> pa.RecordBatch:
        names = list(seen)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[n][k] for n in names], pa.int64()) for k in (1, 0))], names=["mark", "toxic", "clean"])

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(_WORD.findall((text or "").lower()))
            marks = {"=" + w for w in words if len(w) >= 4}
            for n in PREFIXES:
                marks.update(f"{n}{w[:n]}" for w in words if len(w) > n)
            for m in marks:
                seen.setdefault(m, [0, 0])[1 if label == 1 else 0] += 1
        if len(seen) > 400_000:
            yield rows()
            seen.clear()
    if seen:
        yield rows()


def learning_fold(labels: DataFrame) -> DataFrame:
    """(__id, __toxic) of at most LEARN_ROWS labelled rows outside the held-out fold: under a megabyte, so it
    goes to the documents and not they to it."""
    known = labels.where(~held_out("doc_id") & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__toxic"))
    return materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LEARN_ROWS).withColumnRenamed("doc_id", "__id"), "learning-fold")


def _context_batches(marks: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(mark, context, toxic): the distinct surroundings of each mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of = set(marks), {}
        for batch in batches:
            found: set[tuple[str, int, int]] = set()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low = (text or "").lower()
                for m in _WORD.finditer(low):
                    w = m[0]
                    own = of.get(w)
                    if own is None:
                        own = of[w] = [x for x in ("=" + w, *(f"{n}{w[:n]}" for n in PREFIXES if len(w) > n)) if x in known]
                    if own:
                        a, b = m.span()
                        context = zlib.crc32(f"{low[max(0, a - AROUND) : a]}\n{low[b : b + AROUND]}".encode())
                        found.update((x, context, label) for x in own)
            if len(of) > 400_000:
                of.clear()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int32()))], names=["mark", "context", "toxic"])

    return run


def _beyond_chance(base: float, candidates: int) -> tuple[Column, Column]:
    """The gain over the base rate of a mark with ``toxic`` and ``clean`` cases, and whether it outweighs the
    number of candidates."""
    n, hits = F.col("toxic") + F.col("clean"), F.col("toxic").cast("double")
    rate = (hits + 0.5) / (n + 1)
    gain = hits * F.log(rate / base) + (n - hits) * F.log((1 - rate) / (1 - base))
    return gain, (rate >= max(0.35, min(0.9, 2.5 * base))) & (gain > float(np.log(max(2, candidates))) + 2.0)


def learned_marks(docs: DataFrame, fold: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list[str]:
    """Words ("=word") and beginnings ("4begi") that are toxic far beyond chance, both by their documents and by
    the distinct surroundings that they stand in."""
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text")).join(F.broadcast(fold), "__id").select("__text", "__toxic")
    rows = materialize(rows, "labelled-texts")  # of the bounded fold
    counts = rows.mapInArrow(_learn_batches, "mark string, toxic bigint, clean bigint").groupBy("mark").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = materialize(counts.where("toxic >= 3"), "marks")
    totals = fold.agg(F.sum(F.when(F.col("__toxic") == 1, 1).otherwise(0)).alias("toxic"), F.count("*").alias("n")).first()
    if not totals["n"] or not totals["toxic"] or totals["toxic"] == totals["n"]:
        return []
    gain, beyond = _beyond_chance(totals["toxic"] / totals["n"], counts.count())
    likely = [r["mark"] for r in counts.where(beyond).select("mark").collect()]
    if not likely:
        return []
    contexts = rows.mapInArrow(_context_batches(likely), "mark string, context bigint, toxic int").distinct()
    apart = contexts.groupBy("mark").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean"))
    return [r["mark"] for r in apart.where(beyond).orderBy(F.desc(gain), "mark").select("mark").collect()]


class Evidence:
    """Finds marks in texts; a mark's number is its place in ``marks``."""

    def __init__(self, marks: list[str]):
        self.marks = marks
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, bool]]] = {}
        for k, m in enumerate(marks):
            found.setdefault(m[1:], []).append((k, m[0] == "="))
        for word, what in found.items():
            self.automaton.add_word(word, (len(word), what))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def counts(self, text: str) -> dict[int, int]:
        out: dict[int, int] = {}
        if not self.any:
            return out
        low = text.lower()
        for end, (size, what) in self.automaton.iter(low):
            if end >= size and low[end - size].isalpha():
                continue
            whole = end + 1 == len(low) or not low[end + 1].isalpha()
            for k, exact in what:
                if whole == exact:  # a beginning is shorter than its word
                    out[k] = out.get(k, 0) + 1
        return out


class Voter(NamedTuple):
    name: str
    marks: frozenset[int]
    kind: str  # "any" and "dense" vote toxic where they find a mark, or many; "none" clean where they find none


def voters_of(marks: list[str]) -> list[Voter]:
    kinds = {"words": [k for k, m in enumerate(marks) if m[0] == "="]} | {f"begin{n}": [k for k, m in enumerate(marks) if m[0] == str(n)] for n in PREFIXES}
    out = [Voter(f"words-{p}", frozenset(kinds["words"][p::PARTS]), "any") for p in range(PARTS)]
    for kind, own in kinds.items():
        if kind != "words":
            out.append(Voter(kind, frozenset(own), "any"))
        out.append(Voter(f"dense-{kind}", frozenset(own), "dense"))
        out.append(Voter(f"no-{kind}", frozenset(own), "none"))
    fixed = [k for k, m in enumerate(marks) if m[0] == "=" and m[1:] in LEXICON]
    return [*out, Voter("lexicon", frozenset(fixed), "any")]


def votes(found: dict[int, int], text: str, voters: list[Voter]) -> int:
    """Two bits a voter: 0 abstains, 1 clean, 2 toxic; the last voter is the pattern of shouting."""
    out, words = 0, text.count(" ") + text.count("\n") + 1
    for k, v in enumerate(voters):
        times = max((found[m] for m in v.marks & found.keys()), default=0)
        if v.kind == "none":
            vote = 1 if not times else 0
        else:
            vote = 2 if times >= (max(2, 0.01 * words) if v.kind == "dense" else 1) else 0
        out |= vote << (2 * k)
    shouting = text.count("!") > 0.1 * words
    return out | (2 if shouting else 0) << (2 * len(voters))


def _evidence_batches(marks: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence, voters = Evidence(marks), voters_of(marks)
        for batch in batches:
            cast, at, times = [], [], []
            for text in batch.column(1).to_pylist():
                found = evidence.counts(text or "")
                cast.append(votes(found, text or "", voters))
                at.append(sorted(found))
                times.append([found[k] for k in at[-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cast, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], names=["doc_id", "votes", "at", "times"])

    return run


def label_model(patterns: np.ndarray, counts: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_voters: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of "toxic" for each vote pattern, and each voter's weight. The last two voters, the lexicon and shouting, need no
    labels; without a toxic label they decide alone. ``counts`` are a pattern's documents,
    ``toxic`` and ``clean`` those among them whose label is known; these stay what they are. Every round
    re-estimates how often each voter casts each vote for either class, and how far pairs of voters agree
    beyond their class; a voter's say is divided by its redundancy."""
    cast = (patterns[:, None] >> (2 * np.arange(n_voters))) & 3
    unknown = np.maximum(counts - toxic - clean, 0).astype(float)
    ups = (cast == 2).sum(1)
    post = np.where(toxic + clean > 0, (toxic + 0.1) / (toxic + clean + 1), np.clip(ups / n_voters, 0.02, 0.9))
    weight = np.ones(n_voters)
    if not toxic.any():  # nothing tells which class is which but the voters that need no labels
        lexicon, shouting = cast[:, -2] == 2, cast[:, -1] == 2
        return np.where(lexicon, 0.95, np.where(shouting, 0.3, 0.02)), weight
    one_hot = np.stack([cast == v for v in range(3)], 2).astype(float)  # pattern, voter, vote
    signed = (cast == 2).astype(float) - (cast == 1)
    for _ in range(rounds):
        sides = (post * unknown + LABEL_WEIGHT * toxic, (1 - post) * unknown + LABEL_WEIGHT * clean)
        total = sides[0].sum() + sides[1].sum()
        prior = np.clip(sides[0].sum() / total, 0.001, 0.5)
        tables, residual = [], 0.0
        for w in sides:
            tables.append((np.einsum("p,pjv->jv", w, one_hot) + 0.5) / (w.sum() + 1.5))
            mean = (w @ signed) / max(w.sum(), 1e-9)
            centred = signed - mean
            cov = (centred * w[:, None]).T @ centred / max(w.sum(), 1e-9)
            sd = np.sqrt(np.diag(cov)) + 1e-6
            residual = residual + np.abs(cov / np.outer(sd, sd)) * 0.5
        np.fill_diagonal(residual, 0.0)
        weight = 1.0 / (1.0 + np.where(residual > 0.2, residual, 0.0).sum(1))
        log_ratio = np.log(tables[0]) - np.log(tables[1])
        logit = np.log(prior / (1 - prior)) + np.einsum("pjv,jv,j->p", one_hot, log_ratio, weight)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            return new, weight
        post = new
    return post, weight


def fit_linear(row: np.ndarray, column: np.ndarray, value: np.ndarray, columns: int, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Logistic regression on soft labels over sparse rows, by Newton steps, each solved by conjugate gradients;
    the last coefficient is the constant."""
    row, column, value = np.append(row, np.arange(len(y))), np.append(column, np.full(len(y), columns)), np.append(value, np.ones(len(y)))
    forth = lambda b: np.bincount(row, value * b[column], len(y))
    back = lambda r: np.bincount(column, value * r[row], columns + 1)
    beta, penalty = np.zeros(columns + 1), np.full(columns + 1, ridge)
    penalty[-1] = 1e-4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(forth(beta), -30, 30)))
        slope = back(weight * (y - p)) - penalty * beta
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        scale = np.bincount(column, value * value * curve[row], columns + 1) + penalty
        step, left = np.zeros(columns + 1), slope.copy()
        near = left / scale
        way, size = near.copy(), left @ near
        for _ in range(200):
            if size < 1e-12:
                break
            image = back(curve * forth(way)) + penalty * way
            far = size / (way @ image)
            step += far * way
            left -= far * image
            near = left / scale
            way, size = near + (left @ near) / size * way, left @ near
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _profiles(rows: DataFrame) -> list[tuple]:
    """(votes, at, times, weight) of at most TRAIN_ROWS profiles: the half that most documents have, and of the
    rest a sample in hash order, weighted up to what it stands for."""
    half = TRAIN_ROWS // 2
    each = rows.groupBy("votes", "at", "times").agg(F.count("*").alias("n")).withColumn("place", F.xxhash64("votes", "at", "times"))
    each = materialize(each, "profiles")
    first = each.orderBy(F.desc("n"), "place").limit(half).collect()
    out = [(r["votes"], r["at"], r["times"], float(r["n"])) for r in first]
    if len(first) == half:
        last = first[-1]
        rest = each.where((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("place") > last["place"])))
        sample, total = rest.orderBy("place", "n").limit(half).collect(), rest.agg(F.sum("n")).first()[0] or 0
        held = sum(r["n"] for r in sample)
        out += [(r["votes"], r["at"], r["times"], r["n"] * total / held) for r in sample]
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score in 0..1 and predicted (score >= 0.7)."""
    fold = learning_fold(labels)
    marks = [*dict.fromkeys([*(f"={w}" for w in LEXICON), *learned_marks(docs, fold, doc_id, text)])]
    fields = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, votes bigint, at array<int>, times array<int>"
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_evidence_batches(marks), fields)
    rows = materialize(rows, "evidence")
    n_voters = len(voters_of(marks)) + 1
    known = rows.join(F.broadcast(fold), F.col("doc_id") == F.col("__id"), "left")
    label = F.col("__toxic")
    per = known.groupBy("votes").agg(F.count("*").alias("n"), F.count_if(label == 1).alias("toxic"), F.count_if(label == 0).alias("clean"))
    seen = per.orderBy(F.desc("n"), "votes").collect()
    beta = np.zeros(len(marks) + len(marks) + 1)
    if seen:
        patterns, n, toxic, clean = (np.array([r[c] for r in seen], np.int64) for c in ("votes", "n", "toxic", "clean"))
        post, _ = label_model(patterns, n, toxic, clean, n_voters)
        said = dict(zip(patterns.tolist(), post.tolist()))
        votes_of, at, times, weight = zip(*_profiles(rows))
        row = np.repeat(np.arange(len(at)), [len(x) for x in at])
        column, often = np.array([k for x in at for k in x], np.int64), np.array([t for x in times for t in x], float)
        y = np.array([said[v] for v in votes_of])
        beta = fit_linear(np.append(row, row), np.append(column, column + len(marks)), np.append(np.ones(len(row)), np.log(often)), 2 * len(marks), y, np.array(weight))
    once, more = (F.lit([float(b) for b in beta[k * len(marks) : (k + 1) * len(marks)]]) for k in (0, 1))
    each = F.zip_with("at", "times", lambda k, t: F.element_at(once, k + 1) + F.element_at(more, k + 1) * F.log(t.cast("double")))
    total = F.aggregate(each, F.lit(float(beta[-1])), lambda a, b: a + b)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), (1 / (1 + F.exp(-total))).alias("score")).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
