"""Semi-structured note log: free text blocks separated by dashed lines."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.functions.text import strip
from riskspark.scratch import stored
from riskspark.sources.splits import sum_before, with_split_facts


def scan_note_blocks(spark: SparkSession, path: str, strip_title: bool = False) -> DataFrame:
    """(note_pos, raw_text) of every usable block, positions in file order.

    Records end at a three-dash line, so one large log is read by many tasks; longer dash
    lines are split afterwards. A block that opens with `===` is dropped, or with
    `strip_title` only loses its title paragraph.

    Positions take two passes and move no text: the first counts the blocks of each input split, which
    gives every split its first position; the second reads again and numbers the blocks inside a
    split while it scans it.
    """
    text = lambda t: strip(F.regexp_replace(strip(t), r"(?s)^===.*?\n\s*\n", "")) if strip_title else strip(t)
    records = (
        spark.read.option("lineSep", "\n---\n").text(path)
        .select("value", F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block_start"))
        .withColumn("blocks", F.filter(F.transform(F.split("value", "\n---+\n"), text),
                                       lambda t: (t != "") & ~F.startswith(t, F.lit("===")))))
    splits = stored(records.groupBy("file", "block_start").agg(F.sum(F.size("blocks")).alias("n")))
    across = Window.orderBy("file", "block_start").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    offsets = splits.select("file", "block_start", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("offset"))
    before = sum_before(F.xxhash64("file", "block_start"), F.size("blocks").cast("long"))
    numbered = records.select("file", "block_start", "blocks", before.alias("before"))
    return (with_split_facts(numbered, offsets)
            .select((F.col("offset") + F.col("before")).alias("first"), F.posexplode("blocks").alias("i", "raw_text"))
            .select((F.col("first") + F.col("i")).alias("note_pos"), "raw_text"))
