"""Support ticket burden per account."""

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.numeric import clip01, lookup
from riskspark.functions.values import (
    OPEN_STATUSES, PRIORITY_WEIGHTS, STATUS_WEIGHTS, TICKET_MONTHS, TICKET_SATURATION, UNLISTED_WEIGHT,
)


def recent_tickets(tickets: DataFrame, ref: date, months: int = TICKET_MONTHS) -> DataFrame:
    """Created at most `months` calendar months before `ref`; later ones stay in.

    A table partitioned by `created_month` is read from the first of these months on.
    """
    first = F.add_months(F.lit(ref), -months)
    if "created_month" in tickets.columns:
        tickets = tickets.where(F.col("created_month") >= F.trunc(first, "MM").cast("date"))
    return tickets.where(F.col("created_date") >= first)


def ticket_weight() -> Column:
    return (lookup(F.col("priority"), PRIORITY_WEIGHTS, UNLISTED_WEIGHT)
            * lookup(F.col("status"), STATUS_WEIGHTS, UNLISTED_WEIGHT))


def _is_open() -> Column:
    return F.col("status").isin(*OPEN_STATUSES)


def ticket_features(tickets: DataFrame, ref: date) -> DataFrame:
    return (
        recent_tickets(tickets, ref).where(F.col("account_id").isNotNull())
        .groupBy("account_id").agg(
            F.count(F.lit(1)).alias("ticket_count_total"),
            F.count_if(_is_open() & (F.col("priority") == "P1")).alias("p1_open_count"),
            F.count_if(_is_open()).alias("open_ticket_count"),
            F.round(F.avg(F.when(F.col("status") == "Resolved", F.col("resolution_time_hours"))), 1)
            .alias("avg_resolution_hours"),
            clip01(F.sum(ticket_weight()) / TICKET_SATURATION).alias("support_health_score")))


def ticket_subjects(tickets: DataFrame, ref: date) -> DataFrame:
    """Distinct subjects per account with the first ticket that carried each."""
    return (recent_tickets(tickets, ref).where(F.col("account_id").isNotNull())
            .groupBy("account_id", "subject")
            .agg(F.min(F.struct("created_date", "ticket_id")).alias("first_seen"))
            .select("account_id", "subject", "first_seen.created_date", "first_seen.ticket_id"))
