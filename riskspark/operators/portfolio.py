"""Views a dashboard or notebook reads."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.text import (
    bar_label, decline_pct_text, empty_list, money_short, nps_text,
)
from riskspark.operators.insights import actionable, silent_rows
from riskspark.operators.scoring import by_risk


def portfolio_filter(accounts: DataFrame, tiers=None, csms=None, regions=None, industries=None,
                     silent_only: bool = False) -> DataFrame:
    """AND of value lists; a filtered attribute drops rows where it is missing, listed or not."""
    for name, allowed in (("risk_tier", tiers), ("csm_name", csms), ("region", regions),
                          ("industry", industries)):
        wanted = F.col(name).isNotNull() if allowed is None else F.col(name).isin(list(allowed))
        accounts = accounts.where(wanted)
    return by_risk(silent_rows(accounts) if silent_only else accounts)


def filter_domains(accounts: DataFrame) -> DataFrame:
    """Sorted distinct values of the filter attributes, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).alias("value"))
                      for c in ("csm_name", "region", "industry")])
    return (accounts.select(F.inline(pairs)).where("value is not null").distinct()
            .orderBy("attribute", "value"))


def arr_by_csm(accounts: DataFrame) -> DataFrame:
    return (actionable(accounts).where(F.col("csm_name").isNotNull())
            .groupBy("csm_name").agg(F.sum("arr").alias("arr")).orderBy("arr", "csm_name"))


def tier_counts(accounts: DataFrame) -> DataFrame:
    return (accounts.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "risk_tier"))


def sdk_by_tier(accounts: DataFrame) -> DataFrame:
    return (accounts.where(F.col("latest_sdk_version").isNotNull())
            .groupBy("latest_sdk_version", "risk_tier").agg(F.count(F.lit(1)).alias("count")))


def score_histogram(accounts: DataFrame, bins: int = 20) -> DataFrame:
    """Rows per score bin and tier; a score of exactly 1 belongs to the last bin."""
    width = 10_000 // bins
    index = F.least(F.floor(F.round(F.col("risk_score") * 10_000) / width), F.lit(bins - 1)).cast("int")
    return (accounts.where(F.col("risk_score").isNotNull())
            .groupBy(index.alias("bin"), "risk_tier").agg(F.count(F.lit(1)).alias("count")))


def arr_scatter(accounts: DataFrame) -> DataFrame:
    return accounts.select("account_id", "account_name", "risk_score", (F.col("arr") / 1e6).alias("arr_m"),
                           "risk_tier", "plan_tier", "csm_name", "days_to_renewal")


def signal_bars(accounts: DataFrame) -> DataFrame:
    """One bar per account and signal: label, percentage of the contribution and colour band."""
    c = F.col("s.contribution")
    pct = F.least(F.greatest((c * 100).cast("int"), F.lit(0)), F.lit(100))
    band = F.when(c > 0.6, "red").when(c > 0.3, "amber").otherwise("green")
    return (accounts.select("account_id", F.posexplode("signals").alias("bar", "s"))
            .select("account_id", "bar", F.col("s.name").alias("signal"), bar_label(F.col("s.name")).alias("label"),
                    c.alias("contribution"), pct.alias("pct"), band.alias("band")))


def silent_spotlight(accounts: DataFrame) -> DataFrame:
    return (silent_rows(accounts).orderBy(F.desc_nulls_last("usage_decline_score"), "account_id")
            .select("account_id", "account_name", money_short(F.col("arr")).alias("arr_text"),
                    nps_text(F.col("nps_score")).alias("nps_text"),
                    decline_pct_text(F.col("usage_decline_score")).alias("decline_text"),
                    "risk_tier", "contract_end_date", "csm_name"))


def head_view(accounts: DataFrame, rows: int = 15) -> DataFrame:
    return by_risk(accounts).select("account_id", "account_name", "arr", "contract_end_date",
                                    "risk_score", "risk_tier").limit(rows)


def card_flags(accounts: DataFrame) -> DataFrame:
    return accounts.select(
        "account_id",
        F.coalesce(F.col("p1_open_count") > 0, F.lit(False)).alias("has_open_p1"),
        F.coalesce("silent_churn_flag", F.lit(False)).alias("is_silent"),
        F.coalesce(F.lower("latest_sdk_version").startswith("v3"), F.lit(False)).alias("on_sunset_sdk"),
        F.coalesce(F.col("days_to_renewal") <= 30, F.lit(False)).alias("ends_in_30_days"))


def _filled(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def display_fallbacks(accounts: DataFrame, no_narrative: str = "No narrative yet; see the signals.") -> DataFrame:
    """What a card shows where a narrative is missing or failed."""
    text = F.coalesce("narrative_summary", F.lit(""))
    failed = (text == "") | F.contains(F.lower(text), F.lit("narrative generation failed"))
    csm_action = F.col("csm_recommended_action")
    return accounts.select(
        "account_id",
        F.when(failed, no_narrative).otherwise(text).alias("shown_summary"),
        F.coalesce(_filled(F.col("narrative_risk_drivers")), _filled(F.col("risk_flags")),
                   empty_list()).alias("shown_drivers"),
        F.coalesce(_filled(F.col("narrative_actions")),
                   F.when(F.trim(csm_action) != "", F.array(csm_action)), empty_list()).alias("shown_actions"))


def translated_view(accounts: DataFrame) -> DataFrame:
    language, translation = F.lower(F.coalesce("detected_language", F.lit(""))), F.col("english_translation")
    show = ~language.isin("en", "english", "") & (F.coalesce(translation, F.lit("")) != "")
    return accounts.select("account_id", show.alias("is_translated"),
                           F.when(show, translation).otherwise(F.col("verbatim_comment")).alias("shown_comment"))


def load_audit(tables) -> DataFrame:
    """Row counts of the inputs, one (metric, value) row each."""
    def rows(metric: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(metric).alias("metric"), "value")
    return (rows("accounts", tables.accounts).unionByName(rows("usage_rows", tables.usage))
            .unionByName(rows("tickets", tables.tickets)).unionByName(rows("nps_responses", tables.nps))
            .unionByName(rows("notes", tables.notes))
            .unionByName(rows("notes_with_account", tables.notes.where(F.col("account_id").isNotNull()))))
