"""CSV sources with a quarantine: what cannot be read goes to a table of rejects instead of ending the run."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark import schemas
from riskspark.functions.numeric import nan_to_null

CORRUPT = "_corrupt_record"
# Text columns that hold a date, and the columns that may be empty or malformed and then become NULL.
DATES = {"contract_end_date": "yyyy-MM-dd", "month": "yyyy-MM", "created_date": "yyyy-MM-dd"}
COERCED = {"score", "resolution_time_hours"}
KEYS = ("account_id",)
TICKET_TYPES = {"ticket_id": T.LongType(), "account_id": T.LongType(), "resolution_time_hours": T.DoubleType()}
FILES = {"accounts": schemas.ACCOUNTS_FILE, "usage": schemas.USAGE_FILE, "nps": schemas.NPS_FILE}


@dataclass(frozen=True)
class Sifted:
    """One source in two parts: typed rows, and rejects (source, file, reason, record)."""

    source: str
    rows: DataFrame
    rejects: DataFrame

    def admitted(self, share: float) -> DataFrame:
        """The rows, if at most `share` of all records were rejected; else an error that names the commonest reasons."""
        bad = {r["reason"]: r["n"] for r in self.rejects.groupBy("reason").agg(F.count("*").alias("n")).collect()}
        n = sum(bad.values())
        total = n + (self.rows.count() if bad else 0)
        if n > share * total:
            commonest = ", ".join(f"{k}: {v}" for k, v in sorted(bad.items(), key=lambda x: (-x[1], x[0]))[:5])
            raise ValueError(f"{self.source}: {n} of {total} records rejected, {share:.4g} of them allowed ({commonest})")
        return self.rows


def _typed(name: str, dtype: T.DataType) -> Column:
    text = F.trim(F.col(name))
    if name in DATES:
        return F.try_to_date(text, DATES[name])
    if name == "score":  # as text in the file, a number in the table
        return nan_to_null(text.try_cast("double"))
    if isinstance(dtype, T.DoubleType):
        return nan_to_null(text.try_cast(dtype))
    return F.col(name) if isinstance(dtype, T.StringType) else text.try_cast(dtype)


def _reason(fields: list[T.StructField], values: dict[str, Column]) -> Column:
    """The first thing that is wrong with a record, NULL if nothing is."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    checks = [F.when(F.col(CORRUPT).isNotNull(), "number of fields")]
    checks += [F.when(blank(k), f"missing {k}") for k in KEYS]
    checks += [F.when(~blank(f.name) & values[f.name].isNull(), f"malformed {f.name}")
               for f in fields if f.name not in COERCED and (f.name in DATES or not isinstance(f.dataType, T.StringType))]
    return F.coalesce(*checks)


def sift(spark: SparkSession, source: str, path: str, header: bool = True, multi_line: bool = False) -> Sifted:
    """Read `accounts`, `usage`, `tickets` or `nps` in two parts.

    Rejected are records with too few or too many fields, without an account id, or with an id, amount or date that
    cannot be read; numbers that the plain scans turn into NULL stay NULL. Both parts come from the same scan of text columns: a record is in exactly one.
    """
    reader = (spark.read.option("header", header).option("escape", '"').option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).option("multiLine", multi_line))
    if source == "tickets":  # matched by header name
        fields = [T.StructField(c, TICKET_TYPES.get(c, T.StringType())) for c in spark.read.option("header", True).option("escape", '"').csv(path).columns]
    else:
        fields = FILES[source].fields
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields] + [T.StructField(CORRUPT, T.StringType())])
    values = {f.name: _typed(f.name, f.dataType) for f in fields}
    read = reader.schema(text).csv(path).select("*", F.col("_metadata.file_path").alias("_file"))
    marked = read.withColumn("_reason", _reason(fields, values))
    rows = marked.where("_reason IS NULL").select(*[values[f.name].alias(f.name) for f in fields])
    if source == "tickets":
        rows = rows.select((F.col("ticket_id") if "ticket_id" in rows.columns else F.lit(None).cast("long")).alias("ticket_id"), *schemas.TICKET_COLUMNS)
    if source == "nps":
        rows = rows.withColumn("verbatim_comment", F.coalesce("verbatim_comment", F.lit("")))
    record = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*[f.name for f in fields])))
    rejects = marked.where("_reason IS NOT NULL").select(F.lit(source).alias("source"), F.col("_file").alias("file"), F.col("_reason").alias("reason"), record.alias("record"))
    return Sifted(source, rows, rejects)


def write_rejects(parts: list[Sifted], path: str) -> None:
    """All rejects of a run as one dataset, a folder per source."""
    for part in parts:
        part.rejects.write.mode("overwrite").parquet(f"{path}/source={part.source}")
