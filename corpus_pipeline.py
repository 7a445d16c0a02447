"""The training-data pipeline: toxic documents go, shared lines go, one document of each near-duplicate group stays,
secrets are masked, and what is left is packed into sequences.

Each stage takes the documents its predecessor kept, with all their columns, and is written as Parquet and read
again. Rows are handled whatever their columns hold: a null text counts as empty, a row without an id is a
document of its own. Columns beyond those of `documents` are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import line_dedup, secret_scan, sequence_packing, simhash_groups, toxicity
from riskspark.llm.queries import table
from riskspark.scratch import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, keep=docs.columns, name="__toxicity").where("__toxicity < 0.5").drop("__toxicity")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that it shares with at least two others; the last holder keeps them."""
    return line_dedup.deduplicated(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; rows that share an id are one document."""
    grouped = simhash_groups.grouped(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(grouped, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked; n_chars follows the text."""
    columns = docs.columns
    clean = secret_scan.redacted(docs, keep=columns, name="__clean")
    text = F.when(F.col("text").isNotNull(), F.col("__clean"))
    chars = {"n_chars": F.when(text != F.col("text"), F.length("__clean")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in columns else {}
    return clean.withColumns({"text": text} | chars).select(columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    path = public_tokenizers.path
    return sequence_packing.packed(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("line_dedup", drop_shared_lines), ("simhash_near_dedup", one_of_each_group),
    ("secret_scan", mask_secrets), ("best_fit_packing", pack_sequences)]

ORACLE_SQL = None  # learned models, tokenisation and fingerprints are beyond SQL; tests use a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of this folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
