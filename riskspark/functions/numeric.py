"""Numeric helpers that keep NULL as NULL (greatest/least skip NULLs on their own)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip01(value: Column) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of `key` in a small constant dict as one CASE expression."""
    if not table:
        return F.lit(default)
    expr = None
    for k, v in table.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))
