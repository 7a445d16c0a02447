"""Running sums along a scan: what stands before a record in its input split, and before that split in its file."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Facts of more input splits than this (about 100 bytes each) are not broadcast.
BROADCAST_SPLITS = 200_000


def sum_before(split: Column, n: Column) -> Column:
    """Sum of `n` over the records before each one in its input split. Python sees these two numbers only, in the scan's order."""
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, done = None, 0  # the split of the last record, and its sum so far
        for splits, counts in batches:
            key, n = splits.to_numpy(), counts.to_numpy()
            out = np.zeros(len(key), np.int64)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
            for start, end in zip(starts, [*starts[1:], len(key)]):
                sums = np.cumsum(n[start:end]) + (done if key[start] == last else 0)
                out[start:end] = sums - n[start:end]
                last, done = key[start], int(sums[-1])
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "long").asNondeterministic()(split, n)


def sum_earlier(n: Column, place: str = "place") -> Column:
    """The same for records that have left the scan's order and carry their `place` in it. A window is one input split."""
    earlier = Window.partitionBy("file", "block_start").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(earlier), F.lit(0))


def few(facts: DataFrame) -> bool:
    """Whether these rows, one per input split, may be broadcast."""
    return facts.count() <= BROADCAST_SPLITS


def with_split_facts(records: DataFrame, facts: DataFrame) -> DataFrame:
    """Add the facts of its input split (file, block_start) to every record; only where there are very many splits do records move."""
    return records.join(F.broadcast(facts) if few(facts) else facts.hint("shuffle_merge"), ["file", "block_start"])
