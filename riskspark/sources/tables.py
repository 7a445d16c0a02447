"""CSV sources and the bundle of input tables."""

from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import schemas
from riskspark.functions.numeric import nan_to_null
from riskspark.operators.resolve import resolve_notes
from riskspark.sources.notes import scan_note_blocks
from riskspark.sources.rejects import sift, write_rejects


def _csv(spark: SparkSession, path: str, schema, multi_line: bool = False) -> DataFrame:
    # a malformed key or amount must stop the job, not turn into NULL; quotes are doubled inside
    # quoted fields
    return (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
            .option("escape", '"').option("multiLine", multi_line).csv(path))


def _number(text: Column) -> Column:
    """Text to double; anything malformed, and NaN, becomes NULL."""
    return nan_to_null(text.try_cast("double"))


def scan_accounts(spark: SparkSession, path: str) -> DataFrame:
    return (_csv(spark, path, schemas.ACCOUNTS_FILE)
            .withColumn("contract_end_date", F.try_to_date("contract_end_date")))


def scan_usage(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.USAGE_FILE).withColumn("month", F.try_to_date("month", "yyyy-MM"))


def scan_tickets(spark: SparkSession, path: str) -> DataFrame:
    """Tickets by header name; a ticket_id column is kept where the file has one."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    ticket_id = F.col("ticket_id").cast("long") if "ticket_id" in raw.columns else F.lit(None).cast("long")
    return raw.select(
        ticket_id.alias("ticket_id"),
        F.col("account_id").cast("long").alias("account_id"),
        F.try_to_date("created_date").alias("created_date"),
        "priority", "status", "subject",
        _number(F.col("resolution_time_hours")).alias("resolution_time_hours"))


def no_tickets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.TICKETS)


def scan_nps(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Set `multi_line` where comments hold line breaks; such files cannot be split among tasks."""
    return _csv(spark, path, schemas.NPS_FILE, multi_line).select(
        "account_id", _number(F.col("score")).alias("score"),
        F.coalesce("verbatim_comment", F.lit("")).alias("verbatim_comment"))


@dataclass(frozen=True)
class Tables:
    """The reconciled inputs of one run.

    The `unique_*` promises let a plan skip the skew-safe detour: each says that the
    table has at most one row per account (and month), so no group can grow with the data.
    """

    accounts: DataFrame
    usage: DataFrame
    tickets: DataFrame
    nps: DataFrame
    notes: DataFrame
    reference_date: date
    unique_months: bool = False
    unique_surveys: bool = False

    def with_(self, **changes) -> "Tables":
        return replace(self, **changes)


def load_tables(spark: SparkSession, accounts: str, usage: str, nps: str, notes: str,
                tickets: str | None = None, reference_date: date | None = None,
                rejects: str | None = None, allowed_rejects: float = 0.0, **promises) -> Tables:
    """All sources of one folder layout, with notes already matched to accounts.

    A malformed record ends the run, unless `rejects` names a folder: then it is written there, and the run only ends
    where more than the share `allowed_rejects` of a source's records are rejected.
    """
    if rejects is None:
        account_rows, usage_rows, nps_rows = scan_accounts(spark, accounts), scan_usage(spark, usage), scan_nps(spark, nps)
        ticket_rows = scan_tickets(spark, tickets) if tickets else no_tickets(spark)
    else:
        paths = {"accounts": accounts, "usage": usage, "nps": nps} | ({"tickets": tickets} if tickets else {})
        parts = {source: sift(spark, source, path) for source, path in paths.items()}
        write_rejects(list(parts.values()), rejects)
        rows = {source: part.admitted(allowed_rejects) for source, part in parts.items()}
        account_rows, usage_rows, nps_rows = rows["accounts"], rows["usage"], rows["nps"]
        ticket_rows = rows.get("tickets", no_tickets(spark))
    return Tables(
        accounts=account_rows,
        usage=usage_rows,
        tickets=ticket_rows,
        nps=nps_rows,
        notes=resolve_notes(scan_note_blocks(spark, notes), account_rows),
        reference_date=reference_date or date.today(),
        **promises)
