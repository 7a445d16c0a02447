"""Find what a report still lacks, fill only that, and keep the progress."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions.text import is_real_narrative
from riskspark.operators.annotate import (
    Annotator, NARRATIVE_DEFAULTS, NOTE_DEFAULTS, NPS_DEFAULTS, RESPONSE, annotate_accounts, annotate_notes,
    annotate_nps, annotate_portfolio, with_briefing,
)
from riskspark.operators.merge import same_keys, upsert_by_id
from riskspark.operators.narrative import with_narrative
from riskspark.operators.scoring import by_risk, score_accounts
from riskspark.scratch import holds_files, stored

STEPS = ("notes", "comments", "narratives")
CALL_BATCHES = 8
CALL_ATTEMPTS = 5


def _lacks(items: str) -> Column:
    return F.coalesce(F.size(F.col(items)), F.lit(0)) <= 0


def with_gaps(report: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return report.withColumns({
        "needs_narrative": ~is_real_narrative(text("narrative_summary")),
        "needs_notes": _lacks("risk_flags") & F.coalesce("has_csm_notes", F.lit(False)),
        "needs_translation": F.coalesce("has_non_english", F.lit(False)) & (text("english_translation") == ""),
    })


def _any(rows: DataFrame) -> Column:
    """Whether there is any row, as a value that Spark computes with the query."""
    return rows.agg((F.count(F.lit(1)) > 0).alias("found")).scalar()


def gap_counts(report: DataFrame, insights: DataFrame) -> DataFrame:
    """Accounts and what they lack; `needs_insights` is 1 where the report has no insight row."""
    return with_gaps(report).agg(
        F.count(F.lit(1)).alias("accounts"),
        *[F.count_if(c).alias(c) for c in ("needs_narrative", "needs_notes", "needs_translation")]).withColumn(
        "needs_insights", (~_any(insights)).cast("long"))


def report_audit(report: DataFrame, insights: DataFrame, rows: int = 8) -> DataFrame:
    text = F.coalesce("narrative_summary", F.lit(""))
    real = (text != "") & ~F.contains(text, F.lit("narrative generation failed"))
    return by_risk(report).limit(rows).select(
        "account_id", "account_name", "risk_tier", real.alias("has_narrative"),
        (~_lacks("risk_flags")).alias("has_flags"), _any(insights).alias("has_insights"))


def _best_answer(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and input: an answer that came if there is one, else the last fallback. Mergeable, so skew-safe."""
    rest = [c for c in rows.columns if c not in keys]
    worth = F.struct((F.col("call_status") == "ok").alias("ok"), F.col("attempt").alias("attempt"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), worth).alias("_r")).select(*keys, "_r.*")


def _resumed(todo: DataFrame, path: str | None, step: str, keys: list[str], batches: int, attempts: int, work) -> DataFrame:
    """Run `work` for the keys and inputs that `path` has no answer for, append, and return all for `todo`.

    Rows are keyed by row key and input hash and carry their outcome and the number of the attempt, so one append
    stores both an answer and what became of its call. Only 'ok' is done; failed calls are made again at the next run
    until there were `attempts` of them. A repeated run adds nothing, and a row whose input changed is done again. Each of the
    `batches` is stored when it is done, so a run that is stopped later loses one batch of calls.
    """
    if path is None:
        return work(todo).drop("_input", "call_status", "call_error")
    spark, folder = todo.sparkSession, f"{path}/{step}"
    named = [*keys, "_input"]
    done_keys = [F.col(k).alias(f"_key_{k}") for k in named]
    wanted = todo.select(*named).distinct()
    missing = todo.withColumn("_tried", F.lit(0))
    if holds_files(spark, folder):
        past = spark.read.parquet(folder).groupBy(*named).agg(
            F.max("attempt").alias("_made"), F.bool_or(F.col("call_status") == "ok").alias("_ok")).select(*done_keys, "_made", "_ok")
        tried = todo.join(past, same_keys(named), "left")
        missing = (tried.where(~F.coalesce("_ok", F.lit(False)) & (F.coalesce("_made", F.lit(0)) < attempts))
                   .withColumn("_tried", F.coalesce("_made", F.lit(0))).select(*todo.columns, "_tried"))
    missing = stored(missing) if batches > 1 else missing
    for batch in range(batches):
        part = missing if batches == 1 else missing.where(F.pmod(F.xxhash64(*keys), F.lit(batches)) == batch)
        inputs = part.select(*done_keys, (F.col("_tried") + 1).alias("attempt")).distinct()
        fresh = work(part.drop("_tried")).drop("_input").join(inputs, same_keys(keys)).withColumnRenamed("_key__input", "_input")
        fresh = fresh.drop(*[f"_key_{k}" for k in keys])
        fresh.write.mode("append").parquet(folder)
    known = spark.read.schema(fresh.schema).parquet(folder).join(wanted.select(*done_keys), same_keys(named), "left_semi")
    return _best_answer(known, keys).drop("_input", "attempt", "call_status", "call_error")


def call_ledger(spark: SparkSession, progress: str, step: str) -> DataFrame:
    """Every call that a progress folder knows of one step: key, input hash, attempt, call_status, call_error."""
    rows = spark.read.parquet(f"{progress}/{step}")
    keys = ["account_id"] if step == STEPS[0] else RESPONSE
    return rows.select(*keys, F.col("_input").alias("input"), "attempt", "call_status", "call_error")


def enrich_missing(report: DataFrame, notes: DataFrame, progress: str | None = None,
                   note_fn: Annotator | None = None, nps_fn: Annotator | None = None,
                   account_fn: Annotator | None = None, attempts: int = CALL_ATTEMPTS) -> DataFrame:
    """Fill the gaps of a report; narratives see fresh flags and fresh scores.

    `progress` names a folder for finished annotations, so an interrupted run resumes. A failed call is made again at the next
    runs over that folder, `attempts` times in all; `call_ledger` shows what became of each.
    """
    def fill(rows: DataFrame, need: str, step: str, defaults: dict, keys: list[str], inputs: list[str], fn, work) -> DataFrame:
        todo = with_gaps(rows).where(need).withColumn("_input", F.xxhash64(*inputs)).dropDuplicates(keys)
        found = _resumed(todo, progress, step, keys, CALL_BATCHES if fn else 1, attempts, work)
        return upsert_by_id(rows, found, list(defaults), keys)

    # Independent of the order in which notes are read, and changed by any text or place.
    seen = notes.groupBy("account_id").agg(F.sum(F.xxhash64("note_pos", "raw_text").cast("decimal(38,0)")).alias("_notes"))
    report = report.join(seen, "account_id", "left")
    rows = fill(report, "needs_notes", STEPS[0], NOTE_DEFAULTS(), ["account_id"], ["account_id", "note_count", "_notes"],
                note_fn, lambda t: annotate_notes(t, notes, note_fn, outcomes=True))
    rows = fill(rows, "needs_translation", STEPS[1], NPS_DEFAULTS(), RESPONSE, ["verbatim_comment", "nps_score"],
                nps_fn, lambda t: annotate_nps(t, nps_fn, outcomes=True))
    rows = score_accounts(rows)

    def narratives(todo: DataFrame) -> DataFrame:
        # every gap is filled here, Low rows too
        if account_fn is None:
            return with_narrative(todo).select(*RESPONSE, *NARRATIVE_DEFAULTS(), F.lit("ok").alias("call_status"), F.lit(None).cast("string").alias("call_error"))
        return annotate_accounts(with_briefing(todo.withColumn("risk_tier", F.lit("High")), notes), account_fn, outcomes=True)

    return fill(rows, "needs_narrative", STEPS[2], NARRATIVE_DEFAULTS(), RESPONSE,
                ["risk_score", "risk_flags", "positive_signals", "days_to_renewal", "_notes"],
                account_fn, narratives).drop("_notes")


def fill_insights(insights: DataFrame, rows: DataFrame, fn: Annotator | None = None) -> DataFrame:
    """The insights of the report where it has any, else new ones from its filled rows."""
    return annotate_portfolio(rows, fn) if insights.isEmpty() else insights
