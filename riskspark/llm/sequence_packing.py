"""Packing documents into training sequences by the sum-of-squares rule.

Documents become token ids plus an end id. Longer ones are cut into full pieces; the remainder comes first.
Pieces are dealt by hash into groups of about `group` pieces. Each group is packed by itself: longest first,
every piece goes to the open bin, or a new one, after which the sum of the squared numbers of open bins per
residual gap is smallest. The state of a group is one count and one stack of bins per gap, so memory is bounded
by the group; the loss against packing all at once is the few bins that a group leaves open.

Null and empty texts are one piece that holds the end id only. Repeated rows and null ids are packed as rows
of their own. Equal lengths are taken by id, piece and checksum, so a rerun of a lost task gives the same bins.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.blocks import explode_texts
from riskspark.scratch import stored

GROUP = 50_000
PLAIN = re.compile("[\x00-\u024f\u2010-\u2027]*")  # beyond this, libraries could differ in the classes of new characters


class TokenIds:
    """ids of whole texts as little-endian unsigned 32-bit numbers, equal to the tokenizer file's.

    With the same vocabulary as ranks, texts of ordinary characters go through the faster library.
    """

    def __init__(self, tokenizer: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(tokenizer)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]  # the library gives their strings their own ids
        self.fast = None
        if ranks:
            import base64
            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("same ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast and PLAIN.fullmatch(text) and not any(t in text for t in self.added):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()


_LOADED: dict[tuple, TokenIds] = {}


def loaded(*files) -> TokenIds:
    if files not in _LOADED:
        _LOADED[files] = TokenIds(*files)
    return _LOADED[files]


def token_pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None,
                 capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    last = np.array([end_id], "<u4").tobytes()

    def setup():
        model = loaded(tokenizer, ranks, pattern)

        def run(texts, part):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), map(model, texts)):
                data = ids + last
                n = len(data) // 4
                first = n if n <= capacity else n % capacity or capacity
                for k, (begin, end) in enumerate(zip([0, *range(first, n, capacity)], range(first, n + 1, capacity))):
                    for name, v in zip(out, (doc_id, k, begin, end - begin, zlib.crc32(data[4 * begin:4 * end]))):
                        out[name].append(v)
            return out
        return run

    id_type = dict(docs.dtypes)["doc_id"]
    return explode_texts(docs, setup, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of every piece, in the order given."""
    squares = np.zeros(capacity + 1)  # open bins of each gap; a full bin counts as none
    squares[0] = -0.5
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used = [], [], 0
    for n in lengths:
        if n >= capacity:
            bins.append(used)
            offsets.append(0)
            used += 1
            continue
        # Half the growth of the sum of squares, less one: gap g becomes g - n.
        have = squares[n:capacity]
        growth = np.where(have > 0, squares[:capacity - n] - have, np.inf)
        best = int(growth.argmin())
        gap = best + n
        if growth[best] + 0.5 <= squares[capacity - n]:  # not more than a new bin adds
            b = open_bins[gap].pop()
            squares[gap] -= 1
        else:
            gap, b, used = capacity, used, used + 1
        bins.append(b)
        offsets.append(capacity - gap)
        if gap > n:
            open_bins[gap - n].append(b)
            squares[gap - n] += 1
    return bins, offsets


def settle(lengths: list[int], bins: list[int], offsets: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Pack the pieces of all bins that kept a gap once more, best fit, if that needs fewer bins.

    The rule above spreads gaps on purpose, which leaves some open at the end of a finite group.
    """
    fill = np.bincount(bins, lengths)
    loose = [i for i, b in enumerate(bins) if fill[b] < capacity]
    names, gaps, placed = sorted({bins[i] for i in loose}), [], {}
    used = 0
    for i in sorted(loose, key=lambda i: -lengths[i]):
        n = lengths[i]
        at = bisect_left(gaps, (n, -1))
        if at < len(gaps):
            gap, b = gaps.pop(at)
        else:
            if used == len(names):
                return bins, offsets
            gap, b, used = capacity, names[used], used + 1
        placed[i] = (b, capacity - gap)
        if gap > n:
            insort(gaps, (gap - n, b))
    for i, (b, o) in placed.items():
        bins[i], offsets[i] = b, o
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset. Only these narrow rows are shuffled, never ids or texts."""
    groups = max(1, -(-pieces.count() // group))
    deal = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = (pieces.repartition(groups, deal)
             .sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32"))
    out = dealt.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        lengths = table.column("length").to_pylist()
        bins, offsets = settle(lengths, *sum_of_squares(lengths, capacity), capacity)
        base = TaskContext.get().partitionId() << 40
        table = table.append_column("sequence_id", pa.array(np.array(bins, np.int64) + base)).append_column("offset", pa.array(offsets, pa.int64()))
        yield from table.to_batches(max_chunksize=20_000)

    return dealt.mapInArrow(run, out)


def packed(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None,
           capacity: int = 2048, end_id: int = 0, group: int = GROUP) -> DataFrame:
    """Tokenise once, keep the narrow piece table in shared storage, pack it."""
    return pack(stored(token_pieces(docs, tokenizer, ranks, pattern, capacity, end_id)), capacity, group)
