"""Risk of one survey score or one SDK version."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskspark.functions.values import SDK_EMPTY_RISK, SDK_POLICY, SDK_UNLISTED_RISK


def nps_risk(score: Column) -> Column:
    return (F.when(score.isNull(), 0.5)
            .when(score <= 6, 1.0 - score / 12)
            .when(score <= 8, 0.3 - (score - 7) * 0.1)
            .otherwise(F.greatest(F.lit(0.0), 0.1 - (score - 9) * 0.05)))


def sdk_risk(version: Column) -> Column:
    """First policy row that matches the trimmed lower-case version."""
    v = F.lower(F.regexp_replace(version, r"(?U)^\s+|\s+$", ""))
    expr = F.when(F.coalesce(version, F.lit("")) == "", SDK_EMPTY_RISK)
    for kind, pattern, score, _, _ in SDK_POLICY:
        expr = expr.when(v.startswith(pattern) if kind == "prefix" else v == pattern, score)
    return expr.otherwise(SDK_UNLISTED_RISK)


def on_sunset_sdk(version: Column) -> Column:
    """Case-sensitive `v3` prefix, as the portfolio view tests it."""
    return F.coalesce(version.startswith("v3"), F.lit(False))
