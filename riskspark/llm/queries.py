"""One query per operator, with production parameters, over the whole table it is meant for; and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import (embedding_neighbours, importance_sampling, license_index, line_dedup, phrase_mining, positional_index, quality_trees,
                           repeated_passages, secret_scan, sentence_pieces, sequence_packing, simhash_groups, toxicity)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


def op2_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_neighbours.linked(table(spark, sf_dir, "embeddings"))


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages.spans(table(spark, sf_dir, "documents"))


def op5_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return sequence_packing.packed(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups.grouped(table(spark, sf_dir, "documents"))


def op7_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_trees.judge(docs, quality_trees.fit(docs, table(spark, sf_dir, "labels")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.summary(table(spark, sf_dir, "documents"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.mined(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sampling.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_secret_scan, op2_embedding_neighbours, op3_sentence_pieces, op4_repeated_passages, op5_sequence_packing,
    op6_simhash_groups, op7_quality_trees, op8_line_dedup, op9_toxicity, op10_license_index, op11_phrase_mining, op12_importance_resampling, op13_benchmark_decontamination)}

LINE_DEDUP_SQL = r"""
WITH l AS (SELECT doc_id, n, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)),
     k AS (SELECT key, max(doc_id) AS last_doc FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
     j AS (SELECT l.doc_id, l.n, l.line, k.key IS NOT NULL AND l.doc_id IS DISTINCT FROM k.last_doc AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""


def statements() -> dict[str, str]:
    """No SQL for the learned, tokenised and hashed ones; those are tested against brute force."""
    return {"op8_line_dedup": LINE_DEDUP_SQL, "op10_license_index": license_index.summary_sql(),
            "op11_phrase_mining": phrase_mining.mined_sql(), "op12_importance_resampling": importance_sampling.drawn_sql(),
            "op13_benchmark_decontamination": positional_index.contaminated_sql()}
