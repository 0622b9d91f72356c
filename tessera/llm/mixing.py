"""Mixing sources to target weights (2): weighted fair queueing, with DataFrame functions alone.

Each source's documents stand in a hashed order and are served again and again, at most ``REPEATS`` times.
A document's virtual finish time is the words its source has served up to its end over the source's target.
All documents are range-sorted by it. As the weights are the targets and these sum to the budget, the
budget is spent at virtual time 1 in every source: there the queue is truncated, and a document in service
at that time is taken in part.

Running sums over a source that holds most rows are made in two steps: sums of ``source x hash slot``, then
windows inside a slot. One row per source is all that is ever ordered in one task.

Defined cases: a null text or one without words has size 0 and takes nothing; a null source is a source,
the last one; equal hashes are ordered by doc_id and size; other columns, whatever they are called, pass through ``take``. As the budget is spent at virtual
time 1 in every source, the global sort is the order of delivery: what is taken of a document follows from its place in its
source and that time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import materialize

REPEATS = 3
WEIGHTS = (1, 2, 3)
_WORD = r"[^\x20\x09-\x0D]+"
_HEX = 3  # digits of the hash that name a slot: 4,096 slots a source


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """From rows (no_source, source, total) to these and ``target``: the sum of all totals, shared by weight,
    where no source gets more than ``repeats`` times its total and what is over is shared again.

    In ascending order of cap over weight a source is at its cap if its share of what the ones before leave
    is above the cap; the first one that isn't fixes the share of one unit of weight for all after it."""
    everything = Window.partitionBy()
    by_name = Window.orderBy("no_source", "source")
    weight = F.element_at(F.lit(list(weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("bigint")).withColumn("cap", F.col("total") * repeats)
    rows = rows.withColumn("budget", F.sum("total").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "source").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest = F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("unit", left.cast("double") / rest.cast("double"))
    free = F.col("unit") * F.col("weight") <= F.col("cap")
    rows = rows.withColumn("unit", F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), "no_source", "source", "unit"))).over(everything)["unit"])
    share = F.col("unit") * F.col("weight")
    return rows.select("no_source", "source", "total", F.when(F.col("total") == 0, 0.0).when(share < F.col("cap"), share).otherwise(F.col("cap").cast("double")).alias("target"))


def queue(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", keep: tuple[Column, ...] = (), weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per document, range-sorted by virtual finish time: doc_id, size, source_size, target, start
    (words its source serves before it in the first round), finish, taken, copies (rounds that take at least half)."""
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    place = F.md5(F.concat(F.lit("mix-"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).isNull().alias("no_source"), name.alias("source"), n_words(text).alias("size"), place.alias("place"), *keep)
    sized = materialize(sized.withColumn("slot", F.substring("place", 1, _HEX)), "sizes")
    slots = sized.groupBy("no_source", "source", "slot").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("no_source", "source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = materialize(slots.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0))), "slots")
    totals = slots.groupBy("no_source", "source").agg(F.sum("words").alias("total"))
    shares = materialize(targets(totals, weights, repeats), "targets")
    inside = Window.partitionBy("no_source", "source", "slot").orderBy("place", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = sized.withColumn("upto", F.sum("size").over(inside)).join(slots.drop("words"), ["no_source", "source", "slot"]).join(shares, ["no_source", "source"])
    start = F.col("before") + F.col("upto") - F.col("size")
    room = [F.floor(F.col("target")) - F.col("total") * k - F.col("start") for k in range(repeats)]
    taken = [F.greatest(F.lit(0), F.least(F.col("size"), r)) for r in room]
    copies = [F.when((t > 0) & (2 * t >= F.col("size")), 1).otherwise(0) for t in taken]
    rows = rows.withColumn("start", start)
    rows = rows.select(
        "doc_id", "size", F.col("total").alias("source_size"), "target", "start",
        F.when(F.col("target") > 0, (F.col("start") + F.col("size")) / F.col("target")).alias("finish"),
        sum(taken[1:], taken[0]).cast("bigint").alias("taken"), sum(copies[1:], copies[0]).cast("int").alias("copies"),
        *(c for c in sized.columns if c not in ("doc_id", "no_source", "source", "size", "place", "slot")),
    )
    return rows.orderBy(F.col("finish").asc_nulls_last(), F.col("doc_id").asc_nulls_last())


def take(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself, in whole documents: each row of ``docs`` as often as rounds take at least half of it.
    Rows equal in doc_id and text share one place in the queue."""
    names = {c: f"__c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    own_id, own_text = F.col(names[doc_id]), F.col(names[text])
    queued = queue(rows, names[doc_id], names[source], names[text], (F.xxhash64(own_text).alias("__mark"),))
    chosen = queued.where("copies > 0").groupBy("doc_id", "__mark").agg(F.max("copies").alias("__copies"))
    chosen = chosen.select(F.col("doc_id").alias("__id"), F.col("__mark").alias("__text_mark"), "__copies")
    joined = rows.join(chosen, own_id.eqNullSafe(F.col("__id")) & (F.xxhash64(own_text) == F.col("__text_mark")))
    joined = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return joined.select(*(F.col(n).alias(c) for c, n in names.items()))


#: The same rows in DuckDB's SQL.
ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix-' || coalesce(doc_id::VARCHAR, 'null')) AS place
  FROM documents
), totals AS (
  SELECT no_source, source, sum(size)::BIGINT AS total,
         (row_number() OVER (ORDER BY no_source, source) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY no_source, source
), caps AS (
  SELECT *, 3 * total AS cap, sum(total) OVER () AS budget, sum(weight) OVER () AS weights FROM totals
), units AS (
  SELECT *, (budget - coalesce(sum(cap) OVER before, 0))::DOUBLE / (weights - coalesce(sum(weight) OVER before, 0))::DOUBLE AS unit
  FROM caps
  WINDOW before AS (ORDER BY cap / weight, no_source, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), free AS (
  SELECT arg_min(unit, (cap / weight, no_source, source)) AS unit FROM units WHERE unit * weight <= cap
), targets AS (
  SELECT c.no_source, c.source, c.total,
         CASE WHEN c.total = 0 THEN 0.0 ELSE least(f.unit * c.weight, c.cap::DOUBLE) END AS target
  FROM caps c, free f
), placed AS (
  SELECT s.doc_id, s.size, t.total, t.target,
         sum(s.size) OVER (PARTITION BY s.no_source, s.source ORDER BY s.place, s.doc_id NULLS LAST, s.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS start
  FROM sized s JOIN targets t USING (no_source, source)
)
SELECT doc_id, size, total AS source_size, target::DOUBLE AS target,
       (greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - total - start))
        + greatest(0, least(size, floor(target) - 2 * total - start)))::BIGINT AS taken
FROM placed
"""
