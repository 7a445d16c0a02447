"""Landing tables: the inputs stored once so that later runs read fewer files and join without a shuffle.

| table | layout |
|---|---|
| accounts | buckets of account_id |
| usage | months; in each, buckets of account_id where the table has one row per account and month |
| tickets | months of creation; no buckets, as one account may own much of the table |
| nps | buckets of account_id where the table has one row per account |
| notes | as they come |

A bucket is read by one task, so only tables whose accounts have few rows are bucketed; the others are
aggregated before they are shuffled, as without landing.
"""

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.sources.tables import Tables

BUCKETS = 1024
SPREAD = 16  # tasks that write one month of tickets
NAMES = ("accounts", "usage", "tickets", "nps", "notes")


def _layout(unique_months: bool, unique_surveys: bool) -> dict[str, tuple[str | None, bool]]:
    """Partition column, and whether the table is bucketed."""
    return {"accounts": (None, True), "usage": ("month", unique_months), "tickets": ("created_month", False),
            "nps": (None, unique_surveys), "notes": (None, False)}


def land(tables: Tables, path: str, prefix: str, buckets: int = BUCKETS) -> Tables:
    """Store the inputs below `path` as tables `prefix`_accounts and so on, and return them as `landed` does."""
    spark = tables.accounts.sparkSession
    for name, (month, bucketed) in _layout(tables.unique_months, tables.unique_surveys).items():
        rows = getattr(tables, name)
        if name == "tickets":
            rows = rows.withColumn(month, F.trunc("created_date", "MM").cast("date"))
            rows = rows.repartition(month, F.pmod(F.xxhash64(*tables.tickets.columns), F.lit(SPREAD)))
        if bucketed:
            rows = rows.repartition(buckets, "account_id")  # a task writes one bucket, one file a month
        writer = rows.write.mode("overwrite").format("parquet").option("path", f"{path}/{name}")
        writer = writer.partitionBy(month) if month else writer
        (writer.bucketBy(buckets, "account_id") if bucketed else writer).saveAsTable(f"{prefix}_{name}")
    return landed(spark, prefix, tables.reference_date, unique_months=tables.unique_months, unique_surveys=tables.unique_surveys)


def attach(spark: SparkSession, path: str, prefix: str, schemas: dict[str, str], buckets: int = BUCKETS,
           unique_months: bool = False, unique_surveys: bool = False) -> None:
    """Make stored tables known to a catalog that lacks them, with the layout and promises they were landed with."""
    for name, (month, bucketed) in _layout(unique_months, unique_surveys).items():
        if spark.catalog.tableExists(f"{prefix}_{name}"):
            continue
        spark.sql(f"CREATE TABLE {prefix}_{name} ({schemas[name]}) USING parquet "
                  + (f"PARTITIONED BY ({month}) " if month else "")
                  + (f"CLUSTERED BY (account_id) INTO {buckets} BUCKETS " if bucketed else "") + f"LOCATION '{path}/{name}'")
        if month:
            spark.catalog.recoverPartitions(f"{prefix}_{name}")


def landed(spark: SparkSession, prefix: str, reference_date: date, **promises) -> Tables:
    """The bundle from landing tables. Tickets keep `created_month`, by which `recent_tickets` leaves out whole months."""
    found: dict[str, DataFrame] = {name: spark.table(f"{prefix}_{name}") for name in NAMES}
    return Tables(**found, reference_date=reference_date, **promises)
