"""Usage trends per account."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.numeric import clip01

METRICS = {
    "api_calls": "api_calls_slope_risk",
    "active_users": "active_users_slope_risk",
    "workflows_triggered": "workflow_slope_risk",
}


def month_positions(usage: DataFrame, unique_months: bool = False, salts: int = 64) -> DataFrame:
    """Add 0-based `pos` of each row inside its account by month, and the account's row count `n`.

    With one row per account and month the calendar bounds every window. Without that promise
    an account may own most of the table: rows are then numbered inside (account, month, salt)
    cells and shifted by the counted size of the cells before, so no task sees a whole account.
    Rows of one month are ordered by a hash of the row.
    """
    rows = usage.where(F.col("account_id").isNotNull())
    account = Window.partitionBy("account_id")
    if unique_months:
        return (rows
                .withColumn("pos", F.row_number().over(account.orderBy(F.asc_nulls_last("month"))) - 1)
                .withColumn("n", F.count(F.lit(1)).over(account)))
    cell = ["account_id", "_month", "_salt"]
    keyed = (rows
             .withColumn("_month", F.coalesce(F.unix_date("month"), F.lit(2**31 - 1)))
             .withColumn("_hash", F.xxhash64(*usage.columns))
             .withColumn("_salt", F.pmod("_hash", F.lit(salts))))
    before = account.orderBy("_month", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = keyed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_size"))
    cells = cells.select(*cell,
                         F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"),
                         F.sum("_size").over(account).alias("n"))
    inner = Window.partitionBy(*cell).orderBy("_hash", *usage.columns)
    return (keyed.withColumn("_rn", F.row_number().over(inner) - 1).join(cells, cell)
            .select(*usage.columns, (F.col("_shift") + F.col("_rn")).alias("pos"), "n"))


def _slope_risk(metric: str, n: Column) -> Column:
    y = F.col(metric).cast("double")
    slope = F.regr_slope(y, F.col("pos").cast("double"))
    return (F.when(n < 2, 0.0)
            .when(F.count(y) < n, F.lit(None))  # a gap in the series leaves the trend unknown
            .when((F.max(y) == 0) | (F.avg(y) == 0), 0.0)
            .otherwise(clip01(slope / F.avg(y) * -4.0)))


def usage_slopes(positions: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return positions.groupBy("account_id").agg(
        *[_slope_risk(metric, n).alias(name) for metric, name in METRICS.items()])


def _step_drop() -> Column:
    mid = F.col("n").cast("long") - F.ceil(F.col("n") / 2)  # n div 2: an odd middle row is recent
    calls = F.col("api_calls").cast("double")
    early = F.avg(F.when(F.col("pos") < mid, calls))
    recent = F.avg(F.when(F.col("pos") >= mid, calls))
    return F.when(early > 0, clip01((early - recent) / early * 2.0)).otherwise(0.0)


def usage_step_drop(positions: DataFrame) -> DataFrame:
    return positions.groupBy("account_id").agg(_step_drop().alias("usage_step_drop"))


def usage_decline(api: Column, users: Column, workflows: Column, step: Column) -> Column:
    return clip01(0.4 * api + 0.3 * users + 0.15 * workflows + 0.5 * step)


def usage_levels(positions: DataFrame) -> DataFrame:
    return positions.groupBy("account_id").agg(*_levels())


def _levels() -> list[Column]:
    return [
        F.max_by("sdk_version", "pos").alias("latest_sdk_version"),
        F.avg("api_calls").alias("avg_api_calls_6m"),
        F.max_by("active_users", "pos").alias("latest_active_users"),
        F.avg("active_users").alias("avg_active_users"),
    ]


def latest_rows(usage: DataFrame) -> DataFrame:
    """Last row by month per account, by a mergeable aggregate instead of a window."""
    rest = [c for c in usage.columns if c != "account_id"]
    row_hash = F.xxhash64(*usage.columns)
    ordered = F.struct(F.col("month").isNull(), "month", F.pmod(row_hash, F.lit(64)), row_hash)
    return (usage.where(F.col("account_id").isNotNull()).groupBy("account_id")
            .agg(F.max_by(F.struct(*rest), ordered).alias("r")).select("account_id", "r.*"))


def usage_series(positions: DataFrame) -> DataFrame:
    """The monthly series, one row per point."""
    return positions.select("account_id", "pos", "month", "api_calls")


def usage_features(usage: DataFrame, unique_months: bool = False) -> DataFrame:
    """Slopes, step drop, decline score and levels in one aggregation."""
    positions = month_positions(usage, unique_months)
    n = F.count(F.lit(1))
    one_pass = positions.groupBy("account_id").agg(
        *[_slope_risk(metric, n).alias(name) for metric, name in METRICS.items()],
        _step_drop().alias("usage_step_drop"), *_levels())
    decline = usage_decline(*[F.col(c) for c in [*METRICS.values(), "usage_step_drop"]])
    return one_pass.withColumn("usage_decline_score", decline)
