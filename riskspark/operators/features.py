"""One feature row per account (and survey response)."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions.dates import days_to, renewal_urgency
from riskspark.functions.risk import sdk_risk
from riskspark.functions.values import (
    MISSING_NPS_RISK, MISSING_SUPPORT_RISK, MISSING_USAGE_RISK, NEUTRAL_SENTIMENT,
    SILENT_MIN_DECLINE, SILENT_MIN_NPS,
)
from riskspark.operators.lists import attach_count, left_join_many, owned
from riskspark.operators.surveys import nps_features
from riskspark.operators.tickets import ticket_features, ticket_subjects
from riskspark.operators.usage import month_positions, usage_features, usage_series
from riskspark.sources.tables import Tables

JOIN_DEFAULTS = {
    "usage_decline_score": MISSING_USAGE_RISK, "support_health_score": MISSING_SUPPORT_RISK,
    "nps_risk_score": MISSING_NPS_RISK, "p1_open_count": 0, "ticket_count_total": 0,
    "open_ticket_count": 0,
}


def join_surveys(accounts: DataFrame, surveys: DataFrame, unique: bool = False) -> DataFrame:
    """LEFT JOIN that repeats an account for each of its responses."""
    if unique:
        return accounts.join(surveys, "account_id", "left")
    return left_join_many(accounts, surveys, "account_id")


def fill_defaults(joined: DataFrame) -> DataFrame:
    return joined.fillna({c: v for c, v in JOIN_DEFAULTS.items() if c in joined.columns})


def note_counts(notes: DataFrame) -> DataFrame:
    return (notes.where(F.col("account_id").isNotNull()).groupBy("account_id")
            .agg(F.count(F.lit(1)).alias("note_count")))


def derive_flags(joined: DataFrame, ref: date) -> DataFrame:
    days = days_to(F.col("contract_end_date"), F.lit(ref))
    return joined.withColumns({
        "sdk_risk_score": sdk_risk(F.col("latest_sdk_version")),
        "days_to_renewal": days,
        "renewal_urgency_score": renewal_urgency(days),
        "note_count": F.coalesce("note_count", F.lit(0)),
        "has_csm_notes": F.coalesce(F.col("note_count") > 0, F.lit(False)),
        "silent_churn_flag": (F.coalesce("nps_score", F.lit(0.0)) >= SILENT_MIN_NPS)
        & (F.col("usage_decline_score") >= SILENT_MIN_DECLINE),
    })


def build_features(tables: Tables, accounts: DataFrame | None = None) -> DataFrame:
    """Every source reduced to one row per account, then joined on that one key.

    `accounts` may be a filtered account table: rows of other accounts are dropped below the
    aggregates, and the joins are left joins from it.
    Surveys join last: they may repeat accounts, and nothing is shuffled after them.
    """
    base = tables.accounts if accounts is None else accounts
    joined = (base
              .join(usage_features(owned(tables.usage, accounts), tables.unique_months), "account_id", "left")
              .join(ticket_features(owned(tables.tickets, accounts), tables.reference_date), "account_id", "left")
              .join(note_counts(owned(tables.notes, accounts)), "account_id", "left"))
    joined = join_surveys(joined, nps_features(owned(tables.nps, accounts)), tables.unique_surveys)
    return (derive_flags(fill_defaults(joined), tables.reference_date)
            .withColumn("csm_sentiment_score", F.lit(NEUTRAL_SENTIMENT)))


def account_notes(notes: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """The notes of the accounts, one row each; `note_pos` gives the order of the log."""
    return owned(notes, accounts).where(F.col("account_id").isNotNull()).select("account_id", "note_pos", "raw_text")


def account_subjects(tables: Tables, accounts: DataFrame | None = None) -> DataFrame:
    """Distinct ticket subjects of the accounts, in order of the ticket that first carried each."""
    return ticket_subjects(owned(tables.tickets, accounts), tables.reference_date)


def account_series(tables: Tables, accounts: DataFrame | None = None) -> DataFrame:
    """Monthly points of the accounts, in order of `pos`."""
    return usage_series(month_positions(owned(tables.usage, accounts), tables.unique_months))


def account_lists(tables: Tables, accounts: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a report lists per account, as datasets of rows: no account row grows with its items."""
    return {"account_notes": account_notes(tables.notes, accounts),
            "account_subjects": account_subjects(tables, accounts),
            "account_series": account_series(tables, accounts)}


def with_subject_count(features: DataFrame, subjects: DataFrame) -> DataFrame:
    return attach_count(features, subjects, "account_id", "ticket_subject_count")
