"""Text annotation in batches: built-in rules by default, or a caller's function per row."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.replies import reply_to_struct
from riskspark.functions.text import empty_list, money_full, sdk_exact_label
from riskspark.functions.values import BRIEFING_NOTE_CHARS, NEUTRAL_SENTIMENT, PORTFOLIO_PREVIEW_ROWS
from riskspark.operators.insights import (
    actionable, high_only, portfolio_insights, tier_totals,
)
from riskspark.operators.lists import chunked, owned
from riskspark.operators.merge import same_keys
from riskspark.operators.narrative import with_narrative
from riskspark.operators.scoring import by_risk, score_accounts
from riskspark.operators.signals import note_signals
from riskspark.scratch import stored, task_count

NOTE_FIELDS = ("account_id long, csm_sentiment_score double, risk_flags array<string>, "
               "positive_signals array<string>, key_stakeholder_concern string, "
               "csm_recommended_action string")
NOTE_CALL_FIELDS = NOTE_FIELDS + ", chunk_no long, notes long"
NOTES_PER_CALL = 100
RESPONSE = ["account_id", "nps_score", "verbatim_comment"]
NPS_FIELDS = ("account_id long, nps_score double, verbatim_comment string, english_translation string, detected_language string, "
              "nps_key_themes array<string>, sentiment_alignment string, alignment_note string")
NARRATIVE_FIELDS = ("account_id long, nps_score double, verbatim_comment string, narrative_summary string, narrative_risk_drivers array<string>, "
                    "narrative_actions array<string>, narrative_urgency string")
REPLY_FIELDS = ("sentiment_score string, risk_flags array<string>, positive_signals array<string>, "
                "key_stakeholder_concern string, recommended_action string")

# What became of a call: 'ok', or 'failed' with the error's type and text. Fallback answers are never 'ok'.
OUTCOME = "call_status string, call_error string"
ERROR_CHARS = 500

Annotator = Callable[[dict], dict]


def annotate(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], out_schema: str,
             partitions: int | None = None) -> DataFrame:
    """Apply `fn` to Arrow batches. Rows are spread round-robin first, so no key owns a task."""
    spread = df.repartition(partitions or task_count(df.sparkSession))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return spread.mapInPandas(run, out_schema)


def row_annotator(fn: Annotator, failed: Annotator, columns: list[str],
                  keys: list[str] = ["account_id"]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Batch function from a per-row one. `keys` stay as they are.

    A row whose call raises, or returns no dictionary, gets `failed` instead and says so in the outcome columns.
    """
    names = [*columns, *_columns(OUTCOME)]

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in batch.to_dict("records"):
            result, outcome = called(fn, row)
            if outcome["call_error"] is not None:
                result = failed(row)
            out.append({c: row[c] if c in keys else result.get(c) for c in columns} | outcome)
        return pd.DataFrame(out, columns=names)
    return run


def called(fn: Annotator, row: dict) -> tuple[dict, dict]:
    """The answer of one call and its outcome."""
    try:
        result = fn(row)
        if not isinstance(result, dict):
            raise TypeError(f"expected a dictionary, got {type(result).__name__}")
    except Exception as error:
        return {}, {"call_status": "failed", "call_error": f"{type(error).__name__}: {error}"[:ERROR_CHARS]}
    return result, {"call_status": "ok", "call_error": None}


def _settled(rows: DataFrame, outcomes: bool) -> DataFrame:
    """With outcome columns, 'ok' where the built-in rules answered; or without any."""
    if not outcomes:
        return rows.drop(*_columns(OUTCOME))
    return rows if "call_status" in rows.columns else rows.withColumns(
        {"call_status": F.lit("ok"), "call_error": F.lit(None).cast("string")})


def _columns(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


# --- notes -------------------------------------------------------------------

def annotate_notes(accounts: DataFrame, notes: DataFrame, fn: Annotator | None = None,
                   notes_per_call: int = NOTES_PER_CALL, outcomes: bool = False) -> DataFrame:
    """Signals per account with notes, by the rules or by `fn`; with `outcomes`, also what became of the calls.

    `fn` sees rows (account_id, chunk_no, csm_notes_raw): every account's notes in order, in lists
    of `notes_per_call`, the last one shorter. `merge_note_calls` makes one row of its answers.
    Only the key of `accounts` is read, so pass the plain account rows and not a computed table.
    """
    ours = owned(notes, accounts)
    if fn is None:
        return _settled(note_signals(ours).select(*_columns(NOTE_FIELDS)), outcomes)
    return merge_note_calls(note_calls(ours, fn, notes_per_call), outcomes)


def note_calls(notes: DataFrame, fn: Annotator, notes_per_call: int = NOTES_PER_CALL) -> DataFrame:
    """The answers of `fn`, one row per call, with their outcome; a failed call has a neutral answer."""
    neutral = lambda row: {"csm_sentiment_score": NEUTRAL_SENTIMENT, "risk_flags": [], "positive_signals": []}
    calls = chunked(notes, "account_id", "note_pos", "raw_text", "csm_notes_raw", notes_per_call).withColumn(
        "notes", F.size("csm_notes_raw").cast("long"))
    return annotate(calls, row_annotator(fn, neutral, _columns(NOTE_CALL_FIELDS), ["account_id", "chunk_no", "notes"]),
                    f"{NOTE_CALL_FIELDS}, {OUTCOME}")


def note_labels(calls: DataFrame) -> DataFrame:
    """Rows (account_id, kind, chunk_no, item, value): every distinct flag and positive of an account where it came first.

    A dataset beside the account rows, for accounts with more labels than a list in one row should hold;
    `merge_note_calls(calls, lists=False)` has their numbers. Ordered by chunk_no and item it gives the lists.
    """
    part = lambda kind, c: F.transform(F.coalesce(F.col(c), empty_list()), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.cast("long").alias("item"), x.alias("value")))
    rows = calls.select("account_id", "chunk_no", F.inline(F.concat(part("flag", "risk_flags"), part("positive", "positive_signals"))))
    first = rows.where(F.col("value").isNotNull()).groupBy("account_id", "kind", "value").agg(F.min(F.struct("chunk_no", "item")).alias("at"))
    return first.select("account_id", "kind", "at.chunk_no", "at.item", "value")


def merge_note_calls(calls: DataFrame, outcomes: bool = False, lists: bool = True) -> DataFrame:
    """One row per account: mean score weighted by notes, distinct labels in order, first concern and first action.

    Without `lists` the labels are only counted, as n_flags and n_positives; `note_labels` has them as rows.

    With `outcomes` the account's status is 'failed' if any of its calls failed, with the first of their errors.

    An answer without a score counts for nothing in the mean. Labels are made distinct by a mergeable
    aggregation before any list is built; the answers are read once.
    """
    place = lambda i: F.struct(F.col("chunk_no").alias("chunk_no"), i.cast("int").alias("i"))
    part = lambda kind, value, at, score, weight: F.struct(
        F.lit(kind).alias("kind"), value.alias("value"), at.alias("at"), score.alias("score"), weight.alias("weight"))
    none, number = F.lit(None).cast("double"), F.lit(None).cast("long")
    labels = lambda kind, c: F.transform(F.coalesce(F.col(c), empty_list()), lambda x, i: part(kind, x, place(i), none, number))
    first = F.lit(0)
    score = F.col("csm_sentiment_score")
    parts = F.concat(
        labels("flag", "risk_flags"), labels("positive", "positive_signals"),
        F.array(part("concern", F.col("key_stakeholder_concern"), place(first), none, number),
                part("action", F.col("csm_recommended_action"), place(first), none, number),
                part("score", score.cast("string"), place(first), score, F.when(score.isNotNull(), F.col("notes"))),
                part("error", F.col("call_error") if "call_error" in calls.columns else F.lit(None).cast("string"), place(first), none, number)))
    merged = calls.select("account_id", F.inline(parts)).groupBy("account_id", "kind", "value").agg(
        F.min("at").alias("at"), F.first("score").alias("score"), F.sum("weight").alias("weight"))
    known = F.col("value").isNotNull()
    only = lambda kind, c: F.when((F.col("kind") == kind) & known, c)
    listed = lambda kind: F.array_sort(F.collect_list(only(kind, F.struct("at", "value"))))["value"]
    counted = lambda kind: F.count(only(kind, F.lit(1)))
    shown = ([listed("flag").alias("risk_flags"), listed("positive").alias("positive_signals")] if lists
             else [counted("flag").alias("n_flags"), counted("positive").alias("n_positives")])
    early = lambda kind: F.min(only(kind, F.struct("at", "value")))["value"]
    mean = F.round(F.sum(F.col("score") * F.col("weight")) / F.sum(F.when(F.col("score").isNotNull(), F.col("weight"))), 4)
    rows = merged.groupBy("account_id").agg(
        F.when(F.min("score") == F.max("score"), F.min("score")).otherwise(mean).alias("csm_sentiment_score"),
        *shown, early("concern").alias("key_stakeholder_concern"), early("action").alias("csm_recommended_action"),
        F.when(early("error").isNull(), "ok").otherwise("failed").alias("call_status"), early("error").alias("call_error"))
    return _settled(rows, outcomes)


def notes_from_replies(replies: DataFrame) -> DataFrame:
    """Note annotations from a table (account_id, reply); unreadable replies become neutral."""
    parsed = replies.select("account_id", reply_to_struct(F.col("reply"), REPLY_FIELDS).alias("r"))
    score = F.coalesce(F.col("r.sentiment_score"), F.lit(str(NEUTRAL_SENTIMENT))).try_cast("double")
    ok = F.col("r").isNotNull() & score.isNotNull()
    listed = lambda c: F.coalesce(F.when(ok, F.col(c)), empty_list())
    return parsed.select(
        "account_id", ok.alias("parsed"),
        sentiment_to_risk(F.when(ok, score)).alias("csm_sentiment_score"),
        listed("r.risk_flags").alias("risk_flags"), listed("r.positive_signals").alias("positive_signals"),
        F.when(ok, F.col("r.key_stakeholder_concern")).alias("key_stakeholder_concern"),
        F.when(ok, F.col("r.recommended_action")).alias("csm_recommended_action"))


def sentiment_to_risk(sentiment: Column) -> Column:
    return F.round(1.0 - F.coalesce(sentiment, F.lit(NEUTRAL_SENTIMENT)), 4)


NOTE_DEFAULTS = lambda: {
    "csm_sentiment_score": F.lit(NEUTRAL_SENTIMENT), "risk_flags": empty_list(),
    "positive_signals": empty_list(), "key_stakeholder_concern": F.lit(None).cast("string"),
    "csm_recommended_action": F.lit(None).cast("string"),
}
NPS_DEFAULTS = lambda: {
    "english_translation": F.coalesce("verbatim_comment", F.lit("")), "detected_language": F.lit("en"),
    "nps_key_themes": empty_list(), "sentiment_alignment": F.lit("consistent"), "alignment_note": F.lit(""),
}
NARRATIVE_DEFAULTS = lambda: {
    "narrative_summary": F.lit(""), "narrative_risk_drivers": empty_list(),
    "narrative_actions": empty_list(), "narrative_urgency": F.lit(""),
}


def annotation_lookup(base: DataFrame, found: DataFrame, defaults: dict[str, Column],
                      keys: list[str] = ["account_id"]) -> DataFrame:
    """Left join of at most one annotation per key, with a default where there is none.

    Keys after the first match where both are NULL, too.
    """
    fresh = found.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[F.col(c).alias(f"_new_{c}") for c in defaults],
                         F.lit(True).alias("_found"))
    joined = base.drop(*[c for c in defaults if c in base.columns]).join(fresh, same_keys(keys), "left")
    missing = F.col("_found").isNull()
    return (joined.withColumns({c: F.when(missing, d).otherwise(F.col(f"_new_{c}")) for c, d in defaults.items()})
            .drop("_found", *[f"_key_{k}" for k in keys], *[f"_new_{c}" for c in defaults]))


# --- survey comments -----------------------------------------------------------

def non_english(accounts: DataFrame) -> DataFrame:
    return accounts.where(F.coalesce("has_non_english", F.lit(False)))


def annotate_nps(accounts: DataFrame, fn: Annotator | None = None, outcomes: bool = False) -> DataFrame:
    """One annotation per distinct response (account, score, comment) of the given rows.

    By default the comment itself, language unknown; `fn` sees the response. With `outcomes`, also what became of the call.
    """
    responses = accounts.select(*RESPONSE).distinct()
    comment = F.coalesce("verbatim_comment", F.lit(""))
    blank = F.regexp_replace(comment, r"(?U)\s", "") == ""
    defaults = responses.select(
        *RESPONSE, F.when(blank, "").otherwise(comment).alias("english_translation"),
        F.when(blank, "en").otherwise("unknown").alias("detected_language"),
        empty_list().alias("nps_key_themes"), F.lit("consistent").alias("sentiment_alignment"),
        F.lit("").alias("alignment_note"), blank.alias("_blank"))
    if fn is None:
        return _settled(defaults.drop("_blank"), outcomes)
    failed = lambda row: {"english_translation": row["verbatim_comment"], "detected_language": "unknown",
                          "nps_key_themes": [], "sentiment_alignment": "consistent", "alignment_note": ""}
    answers = annotate(responses.where(~blank), row_annotator(fn, failed, _columns(NPS_FIELDS), RESPONSE), f"{NPS_FIELDS}, {OUTCOME}")
    return _settled(answers.unionByName(_settled(defaults.where("_blank").drop("_blank"), True)), outcomes)


# --- account narratives ---------------------------------------------------------

def translate(accounts: DataFrame, fn: Annotator | None = None) -> DataFrame:
    """Comment columns on every row: annotated where the comment is not English, else defaults."""
    if fn is not None:
        return annotation_lookup(accounts, annotate_nps(non_english(accounts), fn), NPS_DEFAULTS(), RESPONSE)
    comment = F.coalesce("verbatim_comment", F.lit(""))
    foreign = F.coalesce("has_non_english", F.lit(False)) & (F.regexp_replace(comment, r"(?U)\s", "") != "")
    defaults = NPS_DEFAULTS()  # expressions on the row itself: no join needed
    return accounts.withColumns({**defaults, "detected_language": F.when(foreign, "unknown").otherwise(
        defaults["detected_language"])})


def annotate_accounts(accounts: DataFrame, fn: Annotator | None = None, outcomes: bool = False) -> DataFrame:
    """A narrative per High or Medium response row; `fn` sees the briefing and the flat columns.

    With `outcomes`, also what became of the call.
    """
    targets = actionable(accounts).dropDuplicates(RESPONSE)
    if fn is None:
        return _settled(with_narrative(targets).select(*_columns(NARRATIVE_FIELDS)), outcomes)
    failed = lambda row: {
        "narrative_summary": f"narrative generation failed, risk score {row['risk_score']:.2f}",
        "narrative_risk_drivers": list(row["risk_flags"]) if row.get("risk_flags") is not None else [],
        "narrative_actions": ["Review account signals manually"],
        "narrative_urgency": f"Contract ends {row['contract_end_date']}."}
    return _settled(annotate(targets.drop("signals", "signal_breakdown"), row_annotator(fn, failed, _columns(NARRATIVE_FIELDS), RESPONSE),
                             f"{NARRATIVE_FIELDS}, {OUTCOME}"), outcomes)


def narrate(accounts: DataFrame, fn: Annotator | None = None) -> DataFrame:
    """Narrative columns on every row, empty on Low rows."""
    if fn is not None:
        return annotation_lookup(accounts, annotate_accounts(accounts, fn), NARRATIVE_DEFAULTS(), RESPONSE)
    low = ~F.col("risk_tier").isin("High", "Medium")
    texts = with_narrative(accounts)  # expressions on the row itself: no join needed
    return texts.withColumns({c: F.when(low, d).otherwise(F.col(c)) for c, d in NARRATIVE_DEFAULTS().items()})


def first_note_text(notes: DataFrame, chars: int = BRIEFING_NOTE_CHARS) -> DataFrame:
    """The first `chars` characters of each account's notes joined by newlines, and `note_chars`, the length of all.

    A note adds at least its newline, so the first chars + 1 notes that have a text decide; the
    ranking limit runs before the shuffle and no account brings more than that.
    """
    w = Window.partitionBy("account_id").orderBy("note_pos")
    texts = notes.where(F.col("account_id").isNotNull() & F.col("raw_text").isNotNull())
    lengths = texts.groupBy("account_id").agg((F.sum(F.length("raw_text") + 1) - 1).alias("note_chars"))
    return (texts.select("account_id", "note_pos", F.substring("raw_text", 1, chars).alias("text"))
            .withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= chars + 1)
            .groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct("note_pos", "text"))).alias("t"))
            .select("account_id", F.substring(F.array_join("t.text", "\n"), 1, chars).alias("note_text"))
            .join(lengths, "account_id"))


def with_briefing(accounts: DataFrame, notes: DataFrame, note_chars: int = BRIEFING_NOTE_CHARS) -> DataFrame:
    """Every row with one text for a reader or an annotator, `briefing`.

    It shows the first `note_chars` characters of the notes; the column `note_chars` has the length of all.
    """
    shown = accounts.join(first_note_text(notes, note_chars), "account_id", "left")
    translation = F.when(F.coalesce("english_translation", F.lit("")) != "", F.col("english_translation"))
    line = lambda label, value: F.concat(F.lit(label + ": "), F.coalesce(value.cast("string"), F.lit("n/a")))
    listed = lambda c: F.array_join(F.coalesce(F.col(c), empty_list()), "; ")
    language = F.coalesce("detected_language", F.lit("en"))
    text = F.concat_ws(
        "\n",
        line("Account", F.concat(F.coalesce("account_name", F.lit("?")), F.lit(" / "), F.col("account_id").cast("string"))),
        line("ARR", money_full(F.col("arr"))),
        line("Plan", F.concat_ws(" / ", "plan_tier", "industry", "region")),
        line("Contract end", F.concat_ws(" in days ", F.col("contract_end_date").cast("string"),
                                         F.col("days_to_renewal").cast("string"))),
        line("CSM", F.col("csm_name")),
        line("Risk", F.concat_ws(" ", F.format_string("%.2f", F.col("risk_score")), F.col("risk_tier"))),
        line("Usage decline", F.format_string("%.2f", F.col("usage_decline_score"))),
        line("Silent churn", F.coalesce("silent_churn_flag", F.lit(False))),
        line("Tickets total, critical open, open", F.concat_ws(
            ", ", *[F.col(c).cast("int").cast("string")
                    for c in ("ticket_count_total", "p1_open_count", "open_ticket_count")])),
        line("SDK", sdk_exact_label(F.col("sdk_risk_score"))),
        line("Survey", F.col("nps_score")),
        line("Comment", F.coalesce(translation, F.col("verbatim_comment"))),
        F.when(~language.isin("en", "english", "English"), line("Original language", language)),
        F.when(F.col("sentiment_alignment") == "misaligned", line("Score and comment disagree", F.col("alignment_note"))),
        line("Notes", F.col("note_text")),
        line("Flags", listed("risk_flags")), line("Positives", listed("positive_signals")),
        line("Concern", F.col("key_stakeholder_concern")))
    return shown.select(*accounts.columns, text.alias("briefing"), F.coalesce("note_chars", F.lit(0)).alias("note_chars"))


def briefings(accounts: DataFrame, notes: DataFrame, note_chars: int = BRIEFING_NOTE_CHARS) -> DataFrame:
    return with_briefing(accounts, notes, note_chars).select("account_id", "briefing", "note_chars")


# --- portfolio -------------------------------------------------------------------

def top_high(accounts: DataFrame, rows: int = PORTFOLIO_PREVIEW_ROWS) -> DataFrame:
    return by_risk(high_only(accounts)).limit(rows)


def portfolio_line() -> Column:
    named = lambda label, c: F.concat(F.lit(label + " "), F.coalesce(F.col(c).cast("string"), F.lit("?")))
    return F.concat_ws(
        " | ", F.coalesce("account_name", F.lit("?")), F.concat(F.lit("ARR "), money_full(F.col("arr"))),
        named("tier", "risk_tier"), named("sdk", "latest_sdk_version"), named("csm", "csm_name"),
        named("industry", "industry"), named("region", "region"), named("silent", "silent_churn_flag"),
        named("critical", "p1_open_count"), named("nps", "nps_score"))


def portfolio_lines(accounts: DataFrame) -> DataFrame:
    """One text with a line for each of the 20 riskiest High accounts."""
    top = top_high(accounts).select((-F.col("risk_score")).alias("neg"), "account_id", portfolio_line().alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("neg", "account_id", "line")))  # at most 20 rows
    return top.agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("portfolio_text"))


def annotate_portfolio(accounts: DataFrame, fn: Annotator | None = None, outcomes: bool = False) -> DataFrame:
    """Insight rows. `fn` gets totals plus `portfolio_text` and returns {"insights": [...]}.

    A failed call gives no insight; with `outcomes` a call without an insight gives one row that only has its outcome.
    """
    if fn is None:
        return _settled(portfolio_insights(accounts), outcomes)
    parts = tier_totals(accounts).unionByName(portfolio_lines(accounts), allowMissingColumns=True)
    facts = parts.agg(*[F.max(c).alias(c) for c in parts.columns])  # one row from two one-row frames

    columns = ["title", "observation", "why_non_obvious", "action", "affected_accounts"]

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        found = []
        for row in batch.to_dict("records"):
            result, outcome = called(fn, row)
            items = result.get("insights") or []
            none = [dict.fromkeys(columns) | outcome] if outcomes else []
            found += [{c: i.get(c) for c in columns} | outcome for i in items] or none
        return pd.DataFrame(found, columns=[*columns, *_columns(OUTCOME)])

    rows = annotate(facts, run, f"title string, observation string, why_non_obvious string, action string, affected_accounts array<string>, {OUTCOME}", 1)
    return _settled(rows, outcomes)


# --- everything ------------------------------------------------------------------

def analyse(renewing: DataFrame, notes: DataFrame, note_fn: Annotator | None = None,
            nps_fn: Annotator | None = None, account_fn: Annotator | None = None,
            note_chars: int = BRIEFING_NOTE_CHARS) -> DataFrame:
    """Annotate notes and comments, refresh the scores with them, then add narratives.

    `notes` should hold no more accounts than `renewing`. With the built-in rules the account
    rows are computed once; a caller's function reads them again, so they are stored before it.
    """
    found = note_signals(notes) if note_fn is None else annotate_notes(
        notes.select("account_id").distinct(), notes, note_fn)
    rows = annotation_lookup(renewing, found, NOTE_DEFAULTS())
    rows = score_accounts(translate(rows if nps_fn is None else stored(rows), nps_fn))
    if account_fn is not None:
        rows = stored(rows)
        return narrate(with_briefing(rows, notes, note_chars), account_fn).drop("briefing", "note_chars")
    return narrate(rows, account_fn)
