"""Keyword signals of an account's notes."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.keywords import flagged, head_mask, hit, hits, inside_mask, tail_mask
from riskspark.functions.numeric import clip01
from riskspark.functions.values import (
    KEYWORD_TOTAL, MAX_FLAGS, MAX_POSITIVES, NEGATIVE_KEYWORDS, POSITIVE_KEYWORDS,
)

NOTES_PER_CHUNK = 4096


def keyword_masks(notes: DataFrame, word_boundary: bool = False) -> DataFrame:
    """One mask per account, as if its notes were one text joined by single blanks.

    Only masks are shuffled, never note text. A keyword with a blank may also stand across two
    neighbouring notes; neighbours are found inside chunks of note positions first and between
    chunk ends second, so an account with most of the notes is spread over many tasks.
    """
    marked = (
        notes.where(F.col("account_id").isNotNull())
        .select("account_id", "note_pos", F.floor(F.col("note_pos") / NOTES_PER_CHUNK).alias("chunk"),
                F.lower("raw_text").alias("text"))
        .select("account_id", "note_pos", "chunk", inside_mask("text", word_boundary).alias("inside"),
                tail_mask("text", word_boundary).alias("tail"), head_mask("text", word_boundary).alias("head")))
    in_chunk = Window.partitionBy("account_id", "chunk").orderBy("note_pos")
    across = lambda tail, nxt: F.col(tail).bitwiseAND(F.coalesce(nxt, F.lit(0).cast("long")))
    chunks = (
        marked.withColumn("next_head", F.lead("head").over(in_chunk))
        .groupBy("account_id", "chunk")
        .agg(F.bit_or(F.col("inside").bitwiseOR(across("tail", F.col("next_head")))).alias("inside"),
             F.min_by("head", "note_pos").alias("head"), F.max_by("tail", "note_pos").alias("tail"),
             F.count(F.lit(1)).alias("n")))
    by_account = Window.partitionBy("account_id").orderBy("chunk")
    return (
        chunks.withColumn("next_head", F.lead("head").over(by_account))
        .groupBy("account_id")
        .agg(F.bit_or(F.col("inside").bitwiseOR(across("tail", F.col("next_head")))).alias("mask"),
             F.sum("n").alias("notes")))


def keyword_hits(notes: DataFrame, word_boundary: bool = False) -> DataFrame:
    return keyword_masks(notes, word_boundary).select(
        "account_id", *[hits("mask", kind).alias(kind)
                        for kind in ("negative", "positive", "competitor", "executive")])


def note_signals(notes: DataFrame, word_boundary: bool = False) -> DataFrame:
    """Risk flags, positive signals, concern, action and risk score of every account with notes."""
    def labels(kind: str, table: dict[str, str]) -> list[tuple[str, str]]:
        return [(hit("mask", kind, k), "concat('Competitor mention (', if(rivals = '', 'unnamed', rivals), ')')"
                 if k == "competitor" else f"'{label}'") for k, label in table.items()]

    found = (
        keyword_masks(notes, word_boundary)
        .withColumn("rivals", F.array_join(hits("mask", "competitor"), ", "))
        .select("account_id", "notes", "rivals",
                flagged(labels("negative", NEGATIVE_KEYWORDS)).alias("flags"),
                flagged(labels("positive", POSITIVE_KEYWORDS)).alias("positives"),
                F.trim(F.get(hits("mask", "executive"), F.lit(0))).alias("executive_keyword")))
    balance = (F.size("positives") - F.size("flags")) / KEYWORD_TOTAL
    code = (F.when(F.col("rivals") != "", "competitor").when(F.size("flags") > 0, "risk")
            .when(F.size("positives") > 0, "positive"))
    return found.select(
        "account_id",
        F.round(1.0 - clip01(0.5 + balance), 4).alias("csm_sentiment_score"),
        F.slice("flags", 1, MAX_FLAGS).alias("risk_flags"),
        F.slice("positives", 1, MAX_POSITIVES).alias("positive_signals"),
        "executive_keyword",
        F.when(F.col("executive_keyword").isNotNull(),
               F.concat(F.lit("Notes mention a senior stakeholder: "), F.col("executive_keyword")))
        .alias("key_stakeholder_concern"),
        code.alias("action_code"),
        F.when(code == "competitor", F.concat(F.lit("Set up an executive call about the rival offer: "), "rivals"))
        .when(code == "risk", F.concat(F.lit("Raise with leadership: "), F.lower(F.get("flags", F.lit(0)))))
        .when(code == "positive", F.lit("Close the renewal paperwork and note the expansion interest"))
        .alias("csm_recommended_action"))
