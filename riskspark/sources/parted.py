"""A keyed table in hash parts with versions: an upsert writes only the parts that change, readers see whole versions.

Below `path` there are `rows/version=V/part=P` and, written last, `state/version=V`: one row per part with the version
that holds it now. A version without its finished state is not seen, so a job that is stopped leaves the table as it
was. One writer at a time. Old versions stay for readers that still use them, until the caller removes their folders.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.operators.merge import same_keys, upsert_by_id
from riskspark.scratch import holds_files, stored

PARTS = 256   # also bounds the rows of a state, which the driver reads
FILES = 8     # a part is written by as many tasks, so one key does not own a task


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions, oldest first."""
    if not holds_files(spark, f"{path}/state"):
        return []
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/state")
    listed = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    names = [(s.getPath().toString(), s.getPath().getName()) for s in listed]
    return sorted(int(name.split("=")[1]) for whole, name in names
                  if name.startswith("version=") and holds_files(spark, f"{whole}/_SUCCESS"))


def _state(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """Version that holds each part; at most as many rows as there are parts."""
    return {r["part"]: r["held"] for r in spark.read.schema("part int, held int").parquet(f"{path}/state/version={version}").collect()}


def _write(rows: DataFrame, path: str, version: int, parts: int, key: str) -> None:
    shares = F.pmod(F.xxhash64(F.struct(*[c for c, t in rows.dtypes if "map<" not in t])), F.lit(FILES))
    spread = rows.withColumn("part", part_of(key, parts))
    # an unfinished run may have left rows under this number
    (spread.repartition("part", shares).write.mode("overwrite").option("partitionOverwriteMode", "static")
     .partitionBy("part").parquet(f"{path}/rows/version={version}"))


def _finish(spark: SparkSession, path: str, version: int, held: dict[int, int]) -> None:
    state = spark.createDataFrame(sorted(held.items()), "part int, held int")
    state.coalesce(1).write.mode("overwrite").parquet(f"{path}/state/version={version}")


def write_parted(rows: DataFrame, path: str, key: str = "account_id", parts: int = PARTS) -> int:
    """Write all rows as the next version and return its number."""
    spark = rows.sparkSession
    version = max(_versions(spark, path), default=0) + 1
    _write(rows, path, version, parts, key)
    _finish(spark, path, version, dict.fromkeys(range(parts), version))
    return version


def read_parted(spark: SparkSession, path: str, schema, version: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The rows of a version, by default the latest; with `only`, of these parts."""
    known = _versions(spark, path)
    if not known or version not in (None, *known):
        raise ValueError(f"{path} has no version {version or ''}".strip())
    held = _state(spark, path, version or known[-1])
    folders = [f"{path}/rows/version={v}/part={p}" for p, v in sorted(held.items()) if only is None or p in only]
    folders = [f for f in folders if holds_files(spark, f)]  # a part may have no rows
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert_parted(spark: SparkSession, path: str, schema, updates: DataFrame, columns: list[str],
                  keys: list[str] = ["account_id"]) -> list[int]:
    """`upsert_by_id` on a stored table; returns the parts that were written anew.

    Only parts that hold a row which an update really changes are rewritten, so the same updates again write
    nothing and make no version. `keys[0]` is the key the table is parted by; every other column keeps its value.
    """
    known = _versions(spark, path)
    if not known:
        raise ValueError(f"{path} has no version")
    held = _state(spark, path, known[-1])
    parts = len(held)
    updates = stored(updates.select(*keys, *columns))
    near = [r["part"] for r in updates.where(F.col(keys[0]).isNotNull()).select(part_of(keys[0], parts).alias("part")).distinct().collect()]
    base = read_parted(spark, path, schema, known[-1], near)
    fresh = updates.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[F.col(c).alias(f"_new_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_new_{c}"))
    changed = base.join(fresh, same_keys(keys)).where(~same).select(part_of(keys[0], parts).alias("part")).distinct()
    touched = sorted(r["part"] for r in changed.collect())  # at most `parts` rows, as `near`
    if touched:
        version = known[-1] + 1
        rows = upsert_by_id(read_parted(spark, path, schema, known[-1], touched), updates, columns, keys)
        _write(rows.select(*base.columns), path, version, parts, keys[0])
        _finish(spark, path, version, held | dict.fromkeys(touched, version))
    return touched
