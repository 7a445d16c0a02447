"""Feeding whole texts to vectorised Python in bounded blocks, and small caches of word results."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

BLOCK_BYTES = 3_000_000  # text held as Python objects at a time; one longer text is a block of its own
BATCH_ROWS = 1_000  # rows of one Arrow batch between the JVM and Python
BATCH_BYTES = 16 << 20  # and its bytes: a batch ends with the row that reaches them


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session end at a number of rows or of bytes, whichever comes first."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def parts(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `limit` bytes; every row is in exactly one slice."""
    sizes = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)) if batch.num_rows else []
    start, done = 0, 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, done + limit, "right")))
        yield batch.slice(start, end - start)
        start, done = end, sizes[end - 1]


def map_texts(docs: DataFrame, setup: Callable[[], Callable[[list[str]], dict]], schema: str,
              text: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """One output row per input row: the kept columns and what the function returns for each block of texts.

    `setup` runs once in each task and returns the function; a null text counts as empty. Columns that are
    not asked for never reach Python, so their names can't clash. No shuffle; a lost task is simply rerun.
    """
    spark, kept = docs.sparkSession, list(keep)
    bounded_batches(spark)
    chosen = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    out = StructType(chosen.schema.fields[:-1] + _parse_datatype_string(schema).fields)
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = setup()
        for batch in batches:
            for part in parts(batch, "__text"):
                made = function(part.column("__text").to_pylist())
                columns = [part.column(k) for k in kept] + [made[f.name] for f in out.fields[len(kept):]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type)
                                                  for c, f in zip(columns, arrow)], schema=arrow)

    return chosen.mapInArrow(run, out)


def explode_texts(docs: DataFrame, setup: Callable[[], Callable[[list[str], pa.RecordBatch], dict]], schema: str,
                  text: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Any number of rows per text: the function gets the texts and the slice they came from and returns whole columns."""
    spark, kept = docs.sparkSession, list(keep)
    bounded_batches(spark)
    chosen = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    out = _parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = setup()
        for batch in batches:
            for part in parts(batch, "__text"):
                made = function(part.column("__text").to_pylist(), part)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return chosen.mapInArrow(run, out)


class Kept(dict):
    """Results of a function of words, kept up to a bound; beyond it they are forgotten and made again."""

    def __init__(self, make: Callable[[list], Iterable], limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def need(self, words: Iterable) -> None:
        """Afterwards every one of the words has its result."""
        wanted = set(words)
        missing = [w for w in wanted if w not in self]
        if len(self) + len(missing) > self.limit:
            self.clear()
            missing = list(wanted)
        if missing:
            self.update(zip(missing, self.make(missing)))


def sample_fraction(spark: SparkSession, rows: DataFrame, wanted: int) -> float:
    """Part of the rows that holds about twice the wanted number, for drawing a bounded fitting sample."""
    return min(1.0, 2.0 * wanted / max(1, rows.count()))


def hashed_sample(rows: DataFrame, key: str, wanted: int) -> DataFrame:
    """At most `wanted` rows, those with the smallest hash of the key: the same on every run. For fitting only."""
    share = sample_fraction(rows.sparkSession, rows, wanted)
    h = F.xxhash64(F.col(key).cast("string"), F.lit("sample"))
    return rows.where(F.pmod(h, F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy(h, key).limit(wanted)
