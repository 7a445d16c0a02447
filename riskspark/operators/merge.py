"""Keyed merge with the semantics of an id-keyed dictionary."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Last duplicate of each key, at the position of the first one. Mergeable, so skew-safe."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return (rows.groupBy(key)
            .agg(F.max_by(F.struct(*rest), order).alias("_r"), F.min(order).alias(order))
            .select(key, order, "_r.*"))


def same_keys(keys: list[str]) -> Column:
    """Join condition of `keys` with their `_key_` copies; all but the first also match NULL with NULL."""
    found = F.col(keys[0]) == F.col(f"_key_{keys[0]}")
    for k in keys[1:]:
        found = found & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return found


def upsert_by_id(base: DataFrame, updates: DataFrame, columns: list[str], keys: list[str] = ["account_id"]) -> DataFrame:
    """Replace only `columns` where `updates` (one row per key) has the key; unknown keys are ignored."""
    fresh = updates.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = base.join(fresh, same_keys(keys), "left")
    merged = {c: F.when(F.col("_hit").isNotNull(), F.col(f"_new_{c}"))
              .otherwise(F.col(c) if c in base.columns else F.lit(None)) for c in columns}
    return joined.withColumns(merged).drop("_hit", *[f"_key_{k}" for k in keys], *[f"_new_{c}" for c in columns])
