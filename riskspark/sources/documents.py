"""Objects out of single JSON documents that may be larger than a task: the file is cut at braces and read by many tasks."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.scratch import stored
from riskspark.sources.splits import few, sum_before, sum_earlier, with_split_facts

TOP = 2  # brace depth inside an object that is a member, or in a member, of the document
SPLIT = ["file", "block_start"]


def _outside(state: Column) -> Column:
    """The fragment with every character of a string, and both of an escape, made an underscore; `state` 1: it begins in a string."""
    shown = F.regexp_replace("value", r"\\.", "__")
    return F.array_join(F.transform(F.split(shown, '"', -1), lambda p, i: F.when(
        F.pmod(i, F.lit(2)) == state, p).otherwise(F.repeat(F.lit("_"), F.length(p)))), '"')


def _quotes() -> Column:
    shown = F.regexp_replace("value", r"\\.", "__")
    return (F.length(shown) - F.length(F.replace(shown, F.lit('"'), F.lit("")))).cast("long")


def _opens(outside: Column) -> Column:
    return F.length(outside) - F.length(F.replace(outside, F.lit("{"), F.lit("")))


def _rise(state: Column, outside: Column) -> Column:
    """Change of depth by a fragment: braces it opens, and the one behind it if that is not in a string."""
    ends = F.pmod(state + F.col("quotes"), F.lit(2))
    return (_opens(outside) - F.when(ends == 0, 1).otherwise(0)).cast("long")


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """Texts between closing braces, in the scan's order, with the parity of the quotes before them in their input split."""
    rows = (spark.read.option("lineSep", "}").text(path)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"),
                    F.monotonically_increasing_id().alias("place"))
            .withColumn("split", F.xxhash64(*SPLIT)).withColumn("quotes", _quotes()))
    return rows.withColumn("parity", F.pmod(sum_before(F.col("split"), F.col("quotes")), F.lit(2)))


def _split_starts(fragments: DataFrame) -> DataFrame:
    """Per input split whether it begins in a string, and at which brace depth.

    A split is summed up for both cases, as only the splits before it decide which one holds.
    Raises ValueError for a document whose braces or quotes do not match.
    """
    other = F.lit(1) - F.col("parity")
    sums = stored(fragments.select(*SPLIT, "quotes", _rise(F.col("parity"), _outside(F.col("parity"))).alias("out"),
                                   _rise(other, _outside(other)).alias("in"))
                  .groupBy(*SPLIT).agg(*[F.sum(c).alias(c) for c in ("quotes", "out", "in")]))
    before = Window.partitionBy("file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    known = (sums.withColumn("in_string", F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)))
             .withColumn("rise", F.when(F.col("in_string") == 0, F.col("out")).otherwise(F.col("in"))))
    # what follows the last brace is a fragment without one behind it
    ends = known.groupBy("file").agg(F.sum("rise").alias("depth"), F.pmod(F.sum("quotes"), F.lit(2)).alias("open"))
    wrong = ends.where(~F.col("depth").isin(0, -1) | (F.col("open") != 0)).select("file").first()
    if wrong:
        raise ValueError(f"not a whole JSON document: {wrong['file']}")
    return known.select(*SPLIT, "in_string", F.coalesce(F.sum("rise").over(before), F.lit(0)).alias("split_depth"))


def document_objects(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(file, number, text) of the objects that are the top-level `member` of JSON documents, or elements of its list.

    Files are cut at every closing brace, so one document, also one of a single line, is read by many tasks.
    Three scans: quotes and braces of each input split tell in which state the next one begins; then the objects that begin at
    the top are counted and their member's name is noted, one narrow row each; then fragments of the wanted objects are
    brought together, each text moving once. `number` gives their order. A list that also holds plain values is not
    taken for `member`; a document that has no such member gives no rows; of repeated members the last one counts.
    """
    starts = _split_starts(_fragments(spark, path))

    def placed(facts: DataFrame) -> DataFrame:
        before = (lambda n: sum_before(F.col("split"), n)) if few(facts) else sum_earlier
        state = F.pmod(F.col("parity") + F.col("in_string"), F.lit(2))
        rows = with_split_facts(_fragments(spark, path), facts).withColumn("state", state).withColumn("outside", _outside(F.col("state")))
        rows = rows.withColumn("rise", _rise(F.col("state"), F.col("outside"))).withColumn(
            "depth", F.col("split_depth") + before(F.col("rise")))
        begins = (F.col("depth") < TOP) & (F.col("depth") + _opens(F.col("outside")) >= TOP)
        rows = rows.withColumn("begins", begins.cast("long")).withColumn("earlier", before(F.col("begins")))
        brace = F.when(F.col("depth") == TOP - 1, F.substring_index("outside", "{", 1)).otherwise(F.substring_index("outside", "{", 2))
        return rows.withColumn("at", F.when(F.col("begins") == 1, F.length(brace) + 1))

    ahead = F.substring("value", F.lit(1), F.col("at") - 1)
    label = F.when(F.col("state").eqNullSafe(0) & F.rlike(ahead, F.lit(r"^\s*,\s*$")), None).otherwise(
        F.regexp_extract(ahead, r'(?<!\\)"([^"]*)"\s*:[\s\[]*$', 1))
    tops = stored(placed(starts).where("begins = 1").select(*SPLIT, "earlier", label.alias("label")))
    across = Window.partitionBy("file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    counts = starts.join(tops.groupBy(*SPLIT).agg(F.count(F.lit(1)).alias("n")), SPLIT, "left").select(
        *SPLIT, "in_string", "split_depth", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("first"))
    named = tops.where("label is not null").join(counts.select(*SPLIT, "first"), SPLIT).select(
        "file", "label", (F.col("first") + F.col("earlier")).alias("since"))
    named = named.withColumn("until", F.lead("since").over(Window.partitionBy("file").orderBy("since")))  # a row per member
    wanted = named.where(F.col("label") == member).groupBy("file").agg(F.max_by(F.struct("since", "until"), "since").alias("w"))
    facts = stored(counts.join(wanted.select("file", "w.*"), "file"))

    number = F.col("first") + F.col("earlier") + F.col("begins") - 1
    pieces = (placed(facts)
              .where((F.col("begins") == 1) | (F.col("depth") >= TOP)).withColumn("number", number)
              .where((F.col("number") >= F.col("since")) & (F.col("number") < F.coalesce("until", F.lit(2**62))))
              .select("file", "number", "block_start", "place",
                      F.when(F.col("begins") == 1, F.substring("value", F.col("at"), F.length("value"))).otherwise(F.col("value")).alias("piece")))
    ordered = F.array_sort(F.collect_list(F.struct("block_start", "place", "piece")))  # the pieces of one object
    return pieces.groupBy("file", "number").agg(F.concat(F.array_join(ordered["piece"], "}"), F.lit("}")).alias("text"))
