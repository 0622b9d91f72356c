"""Text and vector operators on documents, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import text as tx
from tessera.plans.panel import table
from tessera.plans.registry import query, rounded

_BAG = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


@query(f"""WITH b AS (SELECT doc_id, {_BAG} AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS x, unnest(list_prepend('', w[:-2])) AS y FROM b),
  c AS (SELECT doc_id, count(*) FILTER (WHERE (x IN ('the', 'with') AND y NOT IN ('of', 'in')) OR (x IN ('and', 'or') AND y IN ('of', 'in'))) AS u, count(*) FILTER (WHERE (x IN ('and', 'or') AND y NOT IN ('of', 'in')) OR (x IN ('the', 'with') AND y IN ('of', 'in'))) AS d FROM p GROUP BY doc_id)
  SELECT b.doc_id, coalesce(u, 0) AS ups, coalesce(d, 0) AS downs, round(least(greatest(CASE WHEN lower(text) LIKE '%this is%' THEN -1 ELSE 1 END * (coalesce(u, 0) - coalesce(d, 0)) / (coalesce(u, 0) + coalesce(d, 0) + 1.0::DOUBLE), -0.9), 0.9), 6)::DOUBLE AS mood
  FROM b JOIN documents USING (doc_id) LEFT JOIN c ON c.doc_id = b.doc_id""")
def tx_mood(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tx.mood(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["the", "with"], ["and", "or"], ["of", "in"], ["this is"])
    return rounded(rows.select("doc_id", F.col("ups").cast("bigint").alias("ups"), F.col("downs").cast("bigint").alias("downs"), "mood"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))::BIGINT AS mails, len(regexp_extract_all(text, '\\$([0-9]+(?:\\.[0-9]+)?)', 1))::BIGINT AS amounts FROM documents""")
def tx_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tx.entities(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.size("mails").cast("bigint").alias("mails"), F.size("amounts").cast("bigint").alias("amounts"))


@query("""WITH RECURSIVE p AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 0) AS a FROM conversations),
  s AS (SELECT conv_id, turn, a, 1 AS i, a[1] AS open, 0 AS no FROM p WHERE len(a) > 0
        UNION ALL SELECT conv_id, turn, a, i + 1, CASE WHEN length(open) + length(a[i + 1]) <= 120 THEN open || chr(10) || a[i + 1] ELSE a[i + 1] END, CASE WHEN length(open) + length(a[i + 1]) <= 120 THEN no ELSE no + 1 END FROM s WHERE i < len(a))
  SELECT conv_id, turn, no::INT AS chunk_no, arg_max(open, i) AS chunk FROM s GROUP BY 1, 2, 3""")
def tx_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.chunks(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", ["conv_id", "turn"], 120)


@query()
def tx_trigram_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.trigram_embedding("text", 64).alias("v"))
    return rows.select("conv_id", "turn", F.transform("v", lambda x: F.round(x, 6)).alias("embedding"))


_PATHS = """CASE o_orderkey % 6 WHEN 0 THEN 'in/' || y || '/' || m || '/' || d || '/a.pdf' WHEN 1 THEN 'b_' || y || lpad(m::VARCHAR, 2, '0') || lpad(d::VARCHAR, 2, '0') || '.pdf' WHEN 2 THEN 'c ' || y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0')
  WHEN 3 THEN 'd' || y % 100 || lpad(m::VARCHAR, 2, '0') || lpad(d::VARCHAR, 2, '0') WHEN 4 THEN y || '年' || m || '月' || d ELSE 'e600519x' || o_orderkey END"""


def _form(pattern: str, century: str = "") -> str:
    y, m, d = (f"try_cast({lead}regexp_extract(path, '{pattern}', {k}) AS INT)" for k, lead in ((1, f"'{century}' || "), (2, ""), (3, "")))
    return f"CASE WHEN {y} BETWEEN 2000 AND 2099 AND {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 THEN printf('%04d-%02d-%02d', {y}, {m}, {d}) END"


@query(f"""WITH p AS (SELECT o_orderkey, year(o_orderdate) + 25 AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders), q AS (SELECT o_orderkey, {_PATHS} AS path FROM p)
  SELECT o_orderkey, coalesce({_form('(?:^|[^0-9])([0-9]{4})[年/]([0-9]{1,2})[月/]([0-9]{1,2})(?:[^0-9]|$)')}, {_form('(?:^|[^0-9])(20[0-9]{2})[-_]?([0-9]{2})[-_]?([0-9]{2})(?:[^0-9]|$)')}, {_form('(?:^|[^0-9])(2[0-9])(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])(?:[^0-9]|$)', '20')}) AS report_date FROM q""")
def tx_report_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, m, d = F.year("o_orderdate") + 25, F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    form, which = lambda f, *x: F.format_string(f, *x), F.col("o_orderkey") % 6
    path = F.when(which == 0, form("in/%d/%d/%d/a.pdf", y, m, d)).when(which == 1, form("b_%d%02d%02d.pdf", y, m, d)).when(which == 2, form("c %d-%02d-%02d", y, m, d))
    path = path.when(which == 3, form("d%d%02d%02d", y % 100, m, d)).when(which == 4, form("%d年%d月%d", y, m, d)).otherwise(form("e600519x%d", F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.report_date(path).alias("report_date"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q)) + 1e-9) AS score FROM embeddings, q)
  SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10""")
def tx_cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return rounded(tx.cosine_top_k(vectors, vectors.where("vec_id = 7"), 10))


@query("""SELECT doc_id, (contains(lower(text), 'the')::INT + contains(lower(text), 'der')::INT + contains(lower(text), 'license')::INT) AS hits FROM documents""")
def tx_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.keyword_score(table(spark, sf_dir, "documents"), "text", "The der license a").select("doc_id", "hits")
