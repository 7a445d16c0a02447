"""Items that belong to an account, without ever gathering an unbounded group."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_POSITIONS = 4096


def owned(items: DataFrame, base: DataFrame | None, key: str = "account_id") -> DataFrame:
    """The rows of `items` whose key stands in `base`; without a base, all of them."""
    return items if base is None else items.join(base.select(key), key, "left_semi")


def attach_count(base: DataFrame, items: DataFrame, key: str, name: str) -> DataFrame:
    """Add the number of `items` per key, 0 where there are none. The items stay rows of their own table."""
    counts = items.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return base.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def chunked(items: DataFrame, key: str, position: str, value: str, name: str, size: int) -> DataFrame:
    """Rows (key, chunk_no, `name`): arrays of at most `size` values in order of `position`, for every key alike.

    `position` is a whole number that few rows of a key share. Values are numbered inside cells of
    positions and shifted by the counted sizes of the cells before, so a key with most of the rows
    is spread over many tasks.
    """
    rows = items.where(F.col(key).isNotNull()).select(
        key, F.coalesce(F.col(position), F.lit(-1)).alias("_pos"), F.col(value).alias("_v"))
    rows = rows.withColumn("_cell", F.floor(F.col("_pos") / CELL_POSITIONS))
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    shifts = rows.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_size")).select(
        key, "_cell", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(key, "_cell").orderBy("_pos", F.xxhash64("_v"))
    rank = F.col("_shift") + F.col("_rn")
    return (rows.withColumn("_rn", F.row_number().over(inside) - 1).join(shifts, [key, "_cell"])
            .select(key, F.floor(rank / size).alias("chunk_no"), F.struct(rank.alias("rank"), "_v").alias("_item"))
            .groupBy(key, "chunk_no").agg(F.array_sort(F.collect_list("_item"))["_v"].alias(name)))


def left_join_many(base: DataFrame, many: DataFrame, key: str) -> DataFrame:
    """`base LEFT JOIN many` where one key may own much of `many`.

    A left outer join cannot split its right side at run time, so the matched rows come from
    an inner join led by `many` and the unmatched ones from an anti join on the distinct keys.
    """
    matched = many.join(base, key, "inner")
    extra = [c for c in many.columns if c != key]
    unmatched = base.join(many.select(key).distinct(), key, "left_anti")
    for c in extra:
        unmatched = unmatched.withColumn(c, F.lit(None).cast(many.schema[c].dataType))
    cols = base.columns + extra
    return matched.select(*cols).unionByName(unmatched.select(*cols))
