"""Token-set similarity of two strings, as expressions plus one Arrow-batched helper."""

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# executors need no installed copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def token_set(text: Column) -> Column:
    """Sorted distinct white-space tokens."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(words))


def joined_length(tokens: Column) -> Column:
    return F.length(F.array_join(tokens, " "))


def _lcs(left: str, right: str) -> int:
    """Longest common subsequence, one bit per character of the left text."""
    where: dict[str, int] = {}
    for i, ch in enumerate(left):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = row = (1 << len(left)) - 1
    for ch in right:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(left) - row.bit_count()


def _codes(texts: list[str], lengths: np.ndarray, width: int, blank: int) -> np.ndarray:
    """Code points, one row per text, `blank` behind its end."""
    codes = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width).copy()
    codes[np.arange(width) >= lengths[:, None]] = blank
    return codes


def _lcs_of_short(short: list[str], short_len: np.ndarray, other: list[str], other_len: np.ndarray) -> np.ndarray:
    """The same for many pairs at a time, texts of up to 64 characters in one unsigned word each."""
    words = _codes(short, short_len, 64, 0xFFFFFFFF)
    columns = _codes(other, other_len, int(other_len.max()), 0xFFFFFFFE)
    row = np.full(len(short), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for j in range(columns.shape[1]):
        same = words == columns[:, j, None]
        hit = row & np.packbits(same, axis=1, bitorder="little").view(np.uint64)[:, 0]
        row = (row + hit) | (row - hit)
    return 64 - np.bitwise_count(row).astype(np.int32)


def _lcs_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence, pair by pair."""
    len_a, len_b = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (a, b))
    out = np.zeros(len(a), dtype=np.int32)
    swap = len_a > len_b
    short, other = np.where(swap, b, a), np.where(swap, a, b)
    n_short, n_other = np.minimum(len_a, len_b), np.maximum(len_a, len_b)
    fits = np.flatnonzero((n_short > 0) & (n_short <= 64))
    fits = fits[np.argsort(n_other[fits], kind="stable")]  # texts of like length share a step, so little is padding
    for rows in np.array_split(fits, max(1, len(fits) // 2000)):
        if len(rows):
            out[rows] = _lcs_of_short(list(short[rows]), n_short[rows], list(other[rows]), n_other[rows])
    for i in np.flatnonzero(n_short > 64):
        out[i] = _lcs(short[i], other[i])
    return out


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence, pair by pair."""
    return pd.Series(_lcs_of(a.to_numpy(dtype=object), b.to_numpy(dtype=object)))


ROUND_GROWTH = 4  # each round takes so many times the pairs of a header that the one before took
SLACK = 1e-6  # far above rounding, far below a character


def best_first(header, a, b, bound, floor, known, total, reached: dict) -> np.ndarray:
    """Common subsequence lengths of pairs, -1 where the bound lies below what the header has reached before.

    Pairs are taken in rounds, those of the highest bound of each header first; a round's scores
    (`known` characters and the subsequence, over `total`) raise what the next one must reach. `reached` keeps that for later batches.
    """
    codes, names = pd.factorize(header)
    best = np.array([reached.get(n, 0.0) for n in names])
    np.maximum.at(best, codes, floor)
    out = np.zeros(len(codes), dtype=np.int32)
    todo = np.flatnonzero((a != "") | (b != ""))
    todo = todo[np.lexsort((-bound[todo], codes[todo]))]
    own = codes[todo]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    place = np.arange(len(own)) - np.repeat(first, np.diff([*first, len(own)]))
    low, high = 0, 1
    while len(place) and low <= place.max():
        rows = todo[(place >= low) & (place < high)]
        may = bound[rows] >= best[codes[rows]] - SLACK
        out[rows[~may]] = -1
        rows = rows[may]
        if len(rows):
            out[rows] = _lcs_of(a[rows], b[rows])
            np.maximum.at(best, codes[rows], 200.0 * (known[rows] + out[rows]) / total[rows])
        low, high = high, high * ROUND_GROWTH
    reached.update(zip(names, best))
    return out


@F.pandas_udf(T.IntegerType())
def lcs_best_first(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """`best_first` over the pairs of a task."""
    reached: dict = {}  # one number for each header that the task meets
    for header, a, b, *numbers in batches:
        yield pd.Series(best_first(header.to_numpy(dtype=object), a.to_numpy(dtype=object), b.to_numpy(dtype=object),
                                   *[n.to_numpy(dtype=np.float64) for n in numbers], reached))


# keeps the optimizer from evaluating them once more for every filter on the score
lcs_length = lcs_length.asNondeterministic()
lcs_best_first = lcs_best_first.asNondeterministic()


def subset_scores(shared: Column, len_a: Column, len_b: Column) -> Column:
    """The part of the similarity that only depends on the shared tokens' joined length."""
    both = F.greatest(200.0 * shared / (shared + len_a), 200.0 * shared / (shared + len_b))
    return (F.when((shared > 0) & ((shared == len_a) | (shared == len_b)), 100.0)
            .when(shared > 0, both).otherwise(0.0))
