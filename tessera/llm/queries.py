"""The numbered operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import audit, lines, manifest, mixing, warc
from tessera.llm.bpe import round_trip_digests
from tessera.llm.html import extract_main_text
from tessera.llm.near_dups import near_duplicates
from tessera.llm.neighbours import nearest
from tessera.llm.pieces import piece_counts
from tessera.llm.quality import quality_verdicts
from tessera.llm.substrings import removal_digests
from tessera.llm.toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multi_index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op2_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.queue(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op5_word_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_verdicts(_table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archive_round_trip(_table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest_check(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # beside the package; the driver may delete both

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_multi_index_neighbours, op2_weighted_fair_mix, op3_bpe_round_trip, op4_html_main_text, op5_word_piece_counts, op6_substring_dedup, op7_quality_rules, op8_minhash_near_dedup, op9_toxicity, op10_warc_revisits, op11_filter_interactions, op12_line_dedup, op13_merkle_manifest, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_weighted_fair_mix": mixing.ORACLE_SQL, "op10_warc_revisits": warc.ORACLE_SQL, "op11_filter_interactions": audit.ORACLE_SQL, "op12_line_dedup": lines.ORACLE_SQL, "op13_merkle_manifest": manifest.ORACLE_SQL}
