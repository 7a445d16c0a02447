"""The batch jobs: score renewals and publish the report; fill the gaps of a report."""

import argparse
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from riskspark.functions.values import RENEWAL_DAYS
from riskspark.operators.annotate import analyse, annotate_portfolio
from riskspark.operators.features import account_lists, account_subjects, build_features, with_subject_count
from riskspark.operators.gaps import enrich_missing, fill_insights
from riskspark.operators.scoring import by_risk, filter_renewing, score_accounts
from riskspark.scratch import holds_files, stored
from riskspark.sources.report import LISTS, export_csv, read_insights, read_report, write_report
from riskspark.sources.tables import Tables, load_tables


def scored_accounts(tables: Tables, weights: dict[str, float] | None = None) -> DataFrame:
    return score_accounts(build_features(tables), weights)


def renewing_accounts(tables: Tables, window_days: int = RENEWAL_DAYS,
                      weights: dict[str, float] | None = None) -> DataFrame:
    """Scored renewals. The date filter sits on the account table, below every join."""
    due = filter_renewing(tables.accounts, tables.reference_date, window_days)
    return score_accounts(build_features(tables, due), weights)


def renewing_notes(tables: Tables, window_days: int = RENEWAL_DAYS) -> DataFrame:
    """Notes of the renewing accounts only, so no other text is searched."""
    due = filter_renewing(tables.accounts, tables.reference_date, window_days)
    return tables.notes.join(due.select("account_id"), "account_id", "left_semi")


def analysed_renewals(tables: Tables, window_days: int = RENEWAL_DAYS, note_fn=None, nps_fn=None,
                      account_fn=None) -> DataFrame:
    return analyse(renewing_accounts(tables, window_days), renewing_notes(tables, window_days),
                   note_fn, nps_fn, account_fn)


def ranked_renewals(tables: Tables, window_days: int = RENEWAL_DAYS) -> DataFrame:
    return by_risk(renewing_accounts(tables, window_days))


def run_report(tables: Tables, path: str, window_days: int = RENEWAL_DAYS, fmt: str = "parquet",
               note_fn=None, nps_fn=None, account_fn=None, portfolio_fn=None) -> None:
    """Score, annotate and publish. The analysed accounts are stored once for all outputs."""
    rows = analysed_renewals(tables, window_days, note_fn, nps_fn, account_fn)
    due = filter_renewing(tables.accounts, tables.reference_date, window_days)
    rows = stored(with_subject_count(rows, account_subjects(tables, due)))
    write_report(rows, annotate_portfolio(rows, portfolio_fn), path, tables.reference_date, window_days, fmt,
                 lists=account_lists(tables, due))


def run_enrichment(spark: SparkSession, tables: Tables, path: str, out: str, progress: str | None = None,
                   portfolio_fn=None, **annotators) -> None:
    """Read a report, fill its gaps and write the result to a new place.

    Insights are made only where the report has none; its lists are passed on as they are.
    """
    ref = tables.reference_date
    report = read_report(spark, path, ref=ref).drop("reference_date")
    rows = stored(enrich_missing(report, tables.notes, progress, **annotators))
    lists = {name: read_report(spark, path, name, ref).drop("reference_date") for name in LISTS
             if holds_files(spark, f"{path}/{name}/reference_date={ref}")}
    write_report(rows, fill_insights(read_insights(spark, path, ref), rows, portfolio_fn), out, ref, lists=lists)


def main(argv: list[str] | None = None) -> None:
    """spark-submit entry: `renewals.py --accounts … --usage … --nps … --notes … --output …`"""
    parser = argparse.ArgumentParser()
    for name in ("accounts", "usage", "nps", "notes", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--tickets")
    parser.add_argument("--reference-date", type=date.fromisoformat, default=date.today())
    parser.add_argument("--window-days", type=int, default=RENEWAL_DAYS)
    parser.add_argument("--format", choices=["parquet", "json"], default="parquet")
    parser.add_argument("--csv", help="also export the accounts as CSV to this folder")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("renewal-risk").getOrCreate()
    tables = load_tables(spark, args.accounts, args.usage, args.nps, args.notes, args.tickets,
                         args.reference_date)
    tables = tables.with_(notes=stored(tables.notes))  # resolved once, read by several steps
    run_report(tables, args.output, args.window_days, args.format)
    if args.csv:
        export_csv(by_risk(read_report(spark, args.output, fmt=args.format, ref=args.reference_date)), args.csv)


if __name__ == "__main__":
    main()
