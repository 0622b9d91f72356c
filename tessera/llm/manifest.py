"""Merkle dataset manifest (13): a digest of every row, of every source and of the table, with proofs.

A source's leaves, in ascending order of doc_id, are joined in runs of ``fanout``, level by level, until one node is
left; the sources' nodes are joined in the same way to the root. Work goes by aligned blocks of fanout^``LEVELS``
leaves: a recursive postorder traversal of a block returns its digest and, while it unwinds, appends to each
contained leaf the siblings met on the way. Blocks are independent of one another, so all of them are walked
side by side, whatever source they are of; their digests are the leaves of the next, as distributed, traversal.
On the way down each block gets the path of its own digest and hands it to its leaves. No task sees more than a
block, and places in order come from a range sort and running sums over its partitions.

Defined cases: nulls in any column enter the leaf as ``-``; a null source is a source, the first one, and not the
empty one; null doc_ids come first; rows that share a doc_id are ordered by their leaves (equal rows have equal
proofs up to their own place); texts are taken whole; a column that is missing is an error, others are not
read, whatever they are called. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import materialize, shuffle_partitions

FANOUT, LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<at int, siblings array<string>>>"
_ARROW_PATH = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.list_(pa.string()))]))


def framed(value: Column) -> Column:
    """A value so that no two rows run into one another: ``-`` if null, else its bytes in UTF-8, a colon, itself."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(framed, values)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""

    def up(digest: Column, level: Column) -> Column:
        here, all_of = level["at"], level["siblings"]
        run = F.concat(F.slice(all_of, F.lit(1), here), F.array(digest), F.slice(all_of, here + 1, F.size(all_of)))
        return F.sha2(F.array_join(run, ""), 256)

    return F.aggregate(path, leaf, up)


def walk(leaves: list[str], height: int, fanout: int, paths: list[list[dict]] | None = None, lo: int = 0) -> str:
    """The digest of the node of ``height`` over the leaves from ``lo``. With ``paths``, each contained leaf gets
    its place among, and the digests of, its siblings at each level, lowest first."""
    if height == 0:
        return leaves[lo]
    width = fanout ** (height - 1)
    starts = range(lo, min(lo + width * fanout, len(leaves)), width)
    nodes = [walk(leaves, height - 1, fanout, paths, start) for start in starts]
    if paths is not None:
        for k, start in enumerate(starts):
            level = {"at": k, "siblings": nodes[:k] + nodes[k + 1 :]}
            for path in paths[start : start + width]:
                path.append(level)
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _height(total: int, fanout: int, levels: int) -> int:
    """Levels that a block of a tree over ``total`` nodes has: all, unless the tree ends within it."""
    height = 0
    while height < levels and fanout**height < total:
        height += 1
    return height


def ranked(nodes: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``nodes``, stored, with ``pos`` (from 0) in each group and the group's ``total``. Rows are range-sorted; a place is
    that in its partition plus the rows of its group in the partitions before, however large a group is."""
    parts = shuffle_partitions(nodes.sparkSession)
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    placed = nodes.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed, name).withColumn("__task", F.shiftright("__at", 33))
    chunks = placed.groupBy(group, "__task").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    in_group = Window.partitionBy(group)
    chunks = chunks.withColumn("__before", F.coalesce(F.sum("__rows").over(in_group.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    chunks = chunks.withColumn("total", F.sum("__rows").over(in_group))
    return placed.join(chunks, [group, "__task"]).withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__task", "__first", "__before", "__rows")


def _blocks(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Nodes with the number of their block. It and the group alone are what a group of rows is made by."""
    return nodes.withColumn("block", F.expr(f"pos div {fanout**levels}"))


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _roots(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Going up: (group, pos, total, digest) of the blocks' roots, with ``last`` where the group's tree ends."""

    def run(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        total = table.column("total")[0].as_py()
        root = walk(table.column("digest").to_pylist(), _height(total, fanout, levels), fanout)
        size = fanout**levels
        return pa.table({"group": table.column("group")[:1], "pos": table.column("block")[:1], "total": pa.array([-(-total // size)]), "digest": [root], "last": [total <= size]})

    chosen = _blocks(nodes.select("group", "pos", "total", "digest"), fanout, levels)
    return chosen.groupBy("group", "block").applyInArrow(run, "group string, pos long, total long, digest string, last boolean")


def _paths(nodes: DataFrame, above: DataFrame, keep: list[str], fanout: int, levels: int) -> DataFrame:
    """Going down: (group, pos, digest, keep, subroot, root, path) of nodes, where ``above`` has the same, but for keep,
    of their blocks' roots (group, block, subroot, root, path)."""
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}

    def run(mine: pa.Table, block: pa.Table) -> pa.Table:
        mine = _sorted(mine)
        leaves = mine.column("digest").to_pylist()
        paths: list[list[dict]] = [[] for _ in leaves]
        walk(leaves, _height(mine.column("total")[0].as_py(), fanout, levels), fanout, paths)
        rest = block.column("path")[0].as_py()
        fixed = {c: pa.array([block.column(c)[0].as_py()] * len(leaves), pa.string()) for c in ("subroot", "root")}
        return pa.table({c: mine.column(c) for c in ("group", "pos", "digest", *keep)} | fixed | {"path": pa.array([p + rest for p in paths], _ARROW_PATH)})

    schema = ", ".join(["`group` string, pos long, digest string", *(f"`{c}` {kinds[c]}" for c in keep), f"subroot string, root string, path {_PATH}"])
    mine = _blocks(nodes.select("group", "pos", "total", "digest", *keep), fanout, levels)
    return mine.groupBy("group", "block").cogroup(above.groupBy("group", "block")).applyInArrow(run, schema)


def _climb(nodes: DataFrame, fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each round, and one row per group: (group, digest). Rounds end when all groups have one node: a
    table 4,096 times as large takes one more."""
    rounds, done, k = [nodes], None, 0
    while True:
        roots = materialize(_roots(rounds[-1], fanout, levels), f"merkle-roots{k}")
        ended = roots.where("last").select("group", "digest", F.lit(k).alias("round"))
        done = ended if done is None else done.union(ended)
        more = roots.where("not last").drop("last")
        if more.isEmpty():
            return rounds, done
        rounds.append(more)
        k += 1


def _descend(rounds: list[DataFrame], tops: DataFrame, keep: list[str], fanout: int, levels: int) -> DataFrame:
    """Paths of the first round's nodes; tops: (group, round, subroot, root, path), one row per group."""
    above = None
    for k in reversed(range(len(rounds))):
        here = tops.where(F.col("round") == k).select("group", F.lit(0).cast("bigint").alias("block"), "subroot", "root", "path")
        if above is not None:
            here = here.union(above.select("group", F.col("pos").alias("block"), "subroot", "root", "path"))
        above = _paths(rounds[k], here, keep if k == 0 else [], fanout, levels)
        if k:
            above = materialize(above, f"merkle-paths{k}")
    return above


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id", source: str = "source", keep: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, pos (in the source, from 0), leaf, subroot, root, path (levels from
    the leaf to the root, each with the node's place ``at`` in its run and the run's other digests), and the columns
    ``keep``, small ones, as computed from the row."""
    keep = keep or {}
    group = F.when(F.col(source).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source).cast("string")))
    leaves = docs.select(F.col(doc_id).alias("doc_id"), group.alias("group"), leaf_digest([F.col(c) for c in fields]).alias("digest"), *(c.alias(name) for name, c in keep.items()))
    leaves = materialize(leaves, "merkle-digests")  # a range sort reads its input twice: not the texts
    rounds, subroots = _climb(ranked(leaves, "group", ["doc_id", "digest"], "merkle-leaves"), fanout, levels)
    sources = subroots.select(F.lit("").alias("group"), F.col("group").alias("name"), "digest", "round")
    top_rounds, root = _climb(ranked(sources, "group", ["name"], "merkle-sources"), fanout, levels)
    ends = root.select("group", "round", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), F.array().cast(_PATH).alias("path"))
    tops = _descend(top_rounds, ends, ["name", "round"], fanout, levels)
    tops = materialize(tops.select(F.col("name").alias("group"), "round", F.col("digest").alias("subroot"), "root", "path"), "merkle-tops")
    rows = _descend(rounds, tops, ["doc_id", *keep], fanout, levels)
    name = F.when(F.col("group") != "", F.substring("group", 2, 2**31 - 1)).alias("source")
    return rows.select("doc_id", name, "pos", F.col("digest").alias("leaf"), "subroot", "root", "path", *keep)


def lowered(text: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, capitals, capitals.lower())


def manifest_check(docs: DataFrame, every: int = 5) -> DataFrame:
    """The manifest held against rows of which those with crc32(doc_id) divisible by ``every`` have their texts in
    lower case: doc_id, leaf, subroot, root, proof_sha256 (of the path's digests), folded_root, verified."""
    changed = leaf_digest([lowered(F.col(c)) if c == "text" else F.col(c) for c in FIELDS])
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % every == 0, F.lit(False))
    rows = manifest(docs, keep={"tampered": F.when(hit, changed)})
    proof = F.sha2(F.array_join(F.flatten(F.col("path.siblings")), ""), 256)
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The same rows in DuckDB's SQL; in ``tree``, ``top`` tells the tree over the sources.
ORACLE_SQL = """
WITH RECURSIVE framed AS (
  SELECT doc_id, source, text,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents
), crc AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) AS crc
  FROM framed
), leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND crc % 5 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS tampered
  FROM crc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), tree AS (
  SELECT grp, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY grp) AS n FROM placed
  UNION ALL
  SELECT grp, level, pos, digest, count(*) OVER (PARTITION BY grp) AS n FROM (
    SELECT grp, level + 1 AS level, pos // 16 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM tree WHERE n > 1 GROUP BY grp, level, pos // 16)
), subroots AS (
  SELECT grp, digest AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level, pos, digest, count(*) OVER () AS n FROM (
    SELECT level + 1 AS level, pos // 16 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM top WHERE n > 1 GROUP BY level, pos // 16)
), climb AS (
  SELECT grp, pos AS leaf_pos, 0 AS step, 0 AS level, pos, false AS top, coalesce(tampered, leaf) AS folded, '' AS proof FROM placed
  UNION ALL
  SELECT grp, leaf_pos, step + 1, CASE WHEN up.alone THEN 0 ELSE level + 1 END, CASE WHEN up.alone THEN up.at ELSE pos // 16 END, top OR up.alone,
         CASE WHEN up.alone THEN folded ELSE sha256(coalesce(up.before, '') || folded || coalesce(up.after, '')) END,
         CASE WHEN up.alone THEN proof ELSE proof || coalesce(up.before, '') || coalesce(up.after, '') END
  FROM (
    SELECT c.grp, c.leaf_pos, c.step, c.level, c.pos, c.top, c.folded, c.proof, NOT c.top AND any_value(x.n) = 1 AS alone, any_value(s.pos) AS at,
           string_agg(x.digest, '' ORDER BY x.pos) FILTER (WHERE x.pos < c.pos) AS before, string_agg(x.digest, '' ORDER BY x.pos) FILTER (WHERE x.pos > c.pos) AS after
    FROM climb c
    JOIN (SELECT grp, level, pos, digest, n, false AS top FROM tree UNION ALL SELECT '', level, pos, digest, n, true FROM top) x
      ON x.top = c.top AND x.level = c.level AND x.pos // 16 = c.pos // 16 AND (c.top OR x.grp = c.grp)
    JOIN subroots s ON s.grp = c.grp
    WHERE NOT (c.top AND x.n = 1)
    GROUP BY c.grp, c.leaf_pos, c.step, c.level, c.pos, c.top, c.folded, c.proof) up
), ends AS (
  SELECT grp, leaf_pos, arg_max(folded, step) AS folded_root, arg_max(proof, step) AS proof FROM climb GROUP BY grp, leaf_pos
)
SELECT p.doc_id, p.leaf, s.subroot, r.digest AS root, sha256(e.proof) AS proof_sha256, e.folded_root, e.folded_root = r.digest AS verified
FROM placed p JOIN subroots s USING (grp) JOIN ends e ON e.grp = p.grp AND e.leaf_pos = p.pos CROSS JOIN (SELECT digest FROM top WHERE n = 1) r
"""
