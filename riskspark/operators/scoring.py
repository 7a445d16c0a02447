"""Weighted risk score, boosters, tiers and ranking."""

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.numeric import clip01
from riskspark.functions.text import keep, top_signal_label
from riskspark.functions.values import (
    BOOST_OPEN_P1, BOOST_SILENT, BOOST_SUNSET, HIGH_AT, MEDIUM_AT, RENEWAL_DAYS, SIGNAL_WEIGHTS,
)

SCORE_COLUMNS = ["risk_score", "risk_tier", "base_score", "total_boost",
                 "signals", "signal_breakdown", "boosters_applied"]


@dataclass(frozen=True)
class Booster:
    condition: Column
    boost: float
    label: str


def default_boosters() -> list[Booster]:
    return [Booster(F.col("p1_open_count") > 0, *BOOST_OPEN_P1),
            Booster(F.col("silent_churn_flag"), *BOOST_SILENT),
            Booster(F.col("sdk_risk_score") >= 1.0, *BOOST_SUNSET)]


def risk_tier(score: Column) -> Column:
    return F.when(score >= HIGH_AT, "High").when(score >= MEDIUM_AT, "Medium").otherwise("Low")


def score_accounts(features: DataFrame, weights: dict[str, float] | None = None,
                   boosters: list[Booster] | None = None) -> DataFrame:
    """Add (or refresh) the score columns. A signal that is absent or NULL counts as 0."""
    weights = SIGNAL_WEIGHTS if weights is None else weights
    boosters = default_boosters() if boosters is None else boosters
    values = {s: F.coalesce(F.col(s).cast("double"), F.lit(0.0)) if s in features.columns else F.lit(0.0)
              for s in weights}
    base = F.lit(0.0)
    for name, weight in weights.items():
        base = base + values[name] * F.lit(float(weight))
    boost = F.lit(0.0)
    for b in boosters:
        boost = boost + F.when(b.condition, float(b.boost)).otherwise(0.0)
    signals = F.array(*[
        F.struct(F.lit(name).alias("name"), F.round(values[name], 3).alias("raw_value"),
                 F.lit(float(weight)).alias("weight"),
                 F.round(values[name] * F.lit(float(weight)), 4).alias("contribution"))
        for name, weight in weights.items()])
    scored = (features.drop(*SCORE_COLUMNS)
              .withColumns({"_base": base, "_boost": boost})
              .withColumn("_score", clip01(F.col("_base") + F.col("_boost"))))
    return scored.withColumns({
        "risk_score": F.round("_score", 4),
        "risk_tier": risk_tier(F.col("_score")),  # from the unrounded score
        "base_score": F.round("_base", 4),
        "total_boost": F.round("_boost", 4),
        "signals": signals,
        "signal_breakdown": F.map_from_entries(F.transform(signals, lambda s: F.struct(
            s["name"], F.struct(s["raw_value"], s["weight"], s["contribution"])))),
        "boosters_applied": keep(*[F.when(b.condition, b.label) for b in boosters]),
    }).drop("_base", "_boost", "_score")


def renewing_in(end: Column, ref: date, window_days: int = RENEWAL_DAYS) -> Column:
    return end.between(F.lit(ref), F.date_add(F.lit(ref), window_days))


def filter_renewing(accounts: DataFrame, ref: date, window_days: int = RENEWAL_DAYS) -> DataFrame:
    return accounts.where(renewing_in(F.col("contract_end_date"), ref, window_days))


def by_risk(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc_nulls_last("risk_score"), "account_id")


def rank_by_risk(scored: DataFrame) -> DataFrame:
    """Add `risk_rank`, 1 + the number of accounts with a higher score.

    Scores have four digits, so at most 10,001 counts are numbered and joined back; no window
    runs over the whole table.
    """
    higher = Window.orderBy(F.desc("risk_score")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = (scored.groupBy("risk_score").agg(F.count(F.lit(1)).alias("_n"))
             .select("risk_score", (F.coalesce(F.sum("_n").over(higher), F.lit(0)) + 1).alias("risk_rank")))
    return scored.join(F.broadcast(ranks), "risk_score")


def top_signals(signals: Column, n: int = 3) -> Column:
    """Labels of the n largest contributions; ties keep the order of the weights."""
    ordered = F.array_sort(F.transform(signals, lambda s, i: F.struct(
        (-s["contribution"]).alias("neg"), i.alias("i"), s["name"].alias("name"))))
    return F.transform(F.slice(ordered, 1, n), lambda s: top_signal_label(s["name"]))
