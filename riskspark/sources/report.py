"""Report datasets: written in parallel, read back with declared schemas."""

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import schemas
from riskspark.functions.values import EXPORT_COLUMNS, RENEWAL_DAYS
from riskspark.operators.insights import insight_members, tier_totals
from riskspark.scratch import holds_files
from riskspark.sources.documents import document_objects

PARTS = ("meta", "portfolio_insights", "insight_members", "accounts")
LISTS = ("account_notes", "account_subjects", "account_series")


def report_meta(accounts: DataFrame, ref: date, window_days: int = RENEWAL_DAYS,
                generated: date | None = None) -> DataFrame:
    totals = tier_totals(accounts)
    return totals.select(
        F.lit(str(ref)).alias("reference_date"), F.lit(window_days).cast("long").alias("window_days"),
        F.lit(str(generated or date.today())).alias("generated_at"), "total_renewing", "total_arr_at_risk",
        "high_risk_count", "medium_risk_count", "low_risk_count")


def write_report(accounts: DataFrame, insights: DataFrame, path: str, ref: date,
                 window_days: int = RENEWAL_DAYS, fmt: str = "parquet", generated: date | None = None,
                 lists: dict[str, DataFrame] | None = None) -> None:
    """Datasets below `path`, each partitioned by reference date; other dates stay untouched.

    The insight's account names and the `lists` of the accounts (notes, subjects, monthly points)
    are datasets of their own, so no row grows with the portfolio or with one account.
    """
    frames = {
        "meta": report_meta(accounts, ref, window_days, generated).drop("reference_date"),
        "portfolio_insights": insights,
        "insight_members": insight_members(accounts),
        "accounts": accounts,
        **(lists or {}),
    }
    for name, frame in frames.items():
        (frame.withColumn("reference_date", F.lit(str(ref))).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("reference_date")
         .format(fmt).save(f"{path}/{name}"))


def read_report(spark: SparkSession, path: str, part: str = "accounts", ref: date | None = None,
                fmt: str = "parquet", schema=None) -> DataFrame:
    reader = spark.read.format(fmt)
    frame = (reader.schema(schema) if schema is not None else reader).load(f"{path}/{part}")
    return frame.where(F.col("reference_date") == str(ref)) if ref else frame


def read_insights(spark: SparkSession, path: str, ref: date, fmt: str = "parquet") -> DataFrame:
    """Insight rows of a report, none where they were never written. Read with every column they may have."""
    if not holds_files(spark, f"{path}/portfolio_insights"):
        return spark.createDataFrame([], schemas.STORED_INSIGHT).drop("reference_date")
    return read_report(spark, path, "portfolio_insights", ref, fmt, schemas.STORED_INSIGHT).drop("reference_date")


def account_json(accounts: DataFrame) -> DataFrame:
    """One JSON text per account: lists and structs nested, dates as text, missing values as null."""
    cols = [c for c in accounts.columns if c != "signals"]
    return accounts.select("account_id", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def read_report_document(spark: SparkSession, path: str) -> DataFrame:
    """Account rows of single-document JSON reports; one large document is read by many tasks."""
    return _members(spark, path, "accounts", schemas.REPORT_ACCOUNT)


def read_document_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Meta row and insight rows of such a document."""
    portfolio = _members(spark, path, "portfolio_insights", schemas.PORTFOLIO)
    return _members(spark, path, "meta", schemas.META), portfolio.select(F.inline("insights"))


def _members(spark: SparkSession, path: str, member: str, schema) -> DataFrame:
    return document_objects(spark, path, member).select(F.from_json("text", schema).alias("r")).select("r.*")


def export_columns(accounts: DataFrame) -> DataFrame:
    return accounts.select(*[c for c in EXPORT_COLUMNS if c in accounts.columns])


def export_csv(accounts: DataFrame, path: str) -> None:
    export_columns(accounts).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
