"""Passages that documents share, by a sparse suffix array over minimiser positions.

Suffixes are retained where the hash of the next ANCHOR words is the smallest among SPREAD neighbours: the choice
depends on content alone, so any two copies of a passage of ANCHOR + SPREAD words or more retain a suffix at the
same place inside. Suffixes whose first ANCHOR words occur once are dropped by counting. The rest are sorted by
the words that follow, then by those before, over all partitions. Detection needs no neighbours: of every suffix,
each window of LEAST words with the anchor at one of SPREAD places inside is grouped by its words, and a window of
two documents is a match. A shared passage retains a suffix in the first SPREAD places of each of its windows, so
none is missed. Besides, each suffix is compared with the nearest one of another document on either side, which only
extends a match word by word to the right and to the left. Matches are joined to maximal spans per document.

Sorting is by range on the whole key down to document and place, so a passage of a third of all documents is
split over tasks. Windows are grouped inside a partition. Those of its first and its last key, which go on in other
partitions, leave it as distinct windows with their lowest and highest document; these are aggregated, and only the
shared ones go back to the partitions they came from, to the suffixes that have them. The last suffix of a partition
is compared with the first of the next by a join on the partition's number. Words are by ASCII blanks and compared exactly as written, by hash. Null, empty and short texts have no passages. Rows that
share a doc_id are one document and not compared with each other; rows without an id are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.blocks import bounded_batches, explode_texts, parts
from riskspark.scratch import stored

LEAST, ANCHOR, SPREAD, REACH = 50, 25, 25, 25
PARTITION_ROWS = 60_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str) -> np.ndarray:
    words = text.encode().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def retained(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the minimisers, and the hash of the ANCHOR words from each."""
    n = len(hashes) - ANCHOR + 1
    if n < SPREAD:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(ANCHOR):
        h = h * _BASE + hashes[k:k + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    low = np.lib.stride_tricks.sliding_window_view(h, SPREAD).argmin(1) + np.arange(n - SPREAD + 1)
    at = low[np.concatenate([[True], low[1:] != low[:-1]])]
    return at, h[at].view(np.int64)


def suffixes(docs: DataFrame) -> DataFrame:
    """key, doc_id, place of every retained suffix."""
    def setup():
        def run(texts, part):
            keys, ids, places = [], [], []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                at, key = retained(word_hashes(text))
                keys.append(key)
                places.append(at)
                ids += [doc_id] * len(at)
            return {"key": np.concatenate(keys), "doc_id": ids, "place": np.concatenate(places)}
        return run

    return explode_texts(docs.where("doc_id IS NOT NULL"), setup, "key long, doc_id long, place long")


def _with_context(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """Repeated suffixes with the words after their anchor and, nearest first, those before it, as 32-bit hashes."""
    own = repeated.groupBy("doc_id").agg(F.collect_set(F.struct("place", "key")).alias("__at"))  # bounded by the document
    bounded_batches(docs.sparkSession)
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(own, "doc_id")

    def run(batches):
        for batch in batches:
            for part in parts(batch, "text"):
                out = {"key": [], "after": [], "before": [], "doc_id": [], "place": []}
                for doc_id, text, at in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "__at"))):
                    hashes = word_hashes(text)
                    words = (hashes >> np.uint64(32)).astype(">u4")
                    own = set(zip(*(a.tolist() for a in retained(hashes))))
                    data, back = words.tobytes(), words[::-1].tobytes()
                    n = len(words)
                    for s in at:
                        p = s["place"]
                        if (p, s["key"]) not in own:  # of another row with the same id
                            continue
                        out["key"].append(s["key"])
                        out["after"].append(data[4 * (p + ANCHOR):4 * (p + ANCHOR + REACH)])
                        out["before"].append(back[4 * (n - p):4 * (n - p + REACH)])
                        out["doc_id"].append(doc_id)
                        out["place"].append(p)
                yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.int64()), pa.array(out["after"], pa.binary()), pa.array(out["before"], pa.binary()),
                                                  pa.array(out["doc_id"], pa.int64()), pa.array(out["place"], pa.int64())], list(out))

    return joined.mapInArrow(run, "key long, after binary, before binary, doc_id long, place long")


def _words(column) -> np.ndarray:
    """Context bytes as rows of REACH word hashes and which of them exist."""
    data = [v.as_py() if hasattr(v, "as_py") else v for v in column]
    wide = np.frombuffer(b"".join([d.ljust(4 * REACH, b"\0") for d in data]), np.uint32).reshape(len(data), REACH)
    sizes = np.fromiter((len(d) // 4 for d in data), np.int64, len(data))
    return np.where(np.arange(REACH)[None] < sizes[:, None], wide.astype(np.int64), -1)


def _extent(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of equal words from the anchor outwards for row pairs; a missing word equals nothing."""
    differs = (x[i] != y[j]) | (x[i] < 0)
    return np.where(differs.any(1), differs.argmax(1), REACH)


def compared(key, after, before, doc, place) -> tuple[np.ndarray, ...]:
    """Of sorted suffixes: doc, start, end, other doc of each match with the nearest one of another document."""
    n = len(key)
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    last = np.minimum.accumulate(np.where(np.concatenate([new[1:], [True]]), np.arange(n), n)[::-1])[::-1]
    me = np.concatenate([np.arange(n), np.arange(n)])
    it = np.concatenate([first - 1, last + 1])
    ok = (it >= 0) & (it < n)
    me, it = me[ok], it[ok]
    same = key[me] == key[it]
    me, it = me[same], it[same]
    right, left = _extent(after, after, me, it), _extent(before, before, me, it)
    long = left + ANCHOR + right >= LEAST
    me, it, left, right = me[long], it[long], left[long], right[long]
    return doc[me], place[me] - left, place[me] + ANCHOR + right, doc[it]


def _rolled(words: np.ndarray) -> np.ndarray:
    """Hash of the first k words of each row in column k, from none to all."""
    made = np.zeros((len(words), REACH + 1), np.uint64)
    for k in range(REACH):
        made[:, k + 1] = made[:, k] * _BASE + words[:, k].astype(np.uint64) + np.uint64(1)
    return made


def windows(key, after, before) -> np.ndarray:
    """Hash of the LEAST words that start k words before each suffix in column k; 0 where the text has no such words."""
    right, left = _rolled(after), _rolled(before)
    has_right, has_left = (after >= 0).sum(1), (before >= 0).sum(1)
    made = np.zeros((len(key), SPREAD), np.int64)
    for k in range(SPREAD):
        h = key.view(np.uint64) ^ np.uint64(k + 1)
        for part in (left[:, k], right[:, LEAST - ANCHOR - k]):
            h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) + part
        h = (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
        made[:, k] = np.where((has_left >= k) & (has_right >= LEAST - ANCHOR - k), h ^ h >> np.uint64(32), np.uint64(0)).view(np.int64)
    return made


def _grouped(hashes, doc) -> tuple[np.ndarray, ...]:
    """Of one window column: rows in hash order, their hash, lowest and highest document of the hash, and where each hash begins."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes = np.diff([*starts, len(h)])
    low, high = (np.repeat(f.reduceat(doc[order], starts), sizes) for f in (np.minimum, np.maximum))
    return order, h, low, high, starts


def _ends(doc, place, columns) -> tuple[np.ndarray, ...]:
    """Doc, start, end, other doc of what the first and the last shared window of each suffix cover; they always overlap.

    `columns` gives each k its rows and their other documents. A suffix has two rows only if those windows name two others.
    """
    n = len(doc)
    first, last = np.full(n, SPREAD), np.full(n, -1)
    other = np.zeros((2, n), np.int64)
    for k, at, beside in columns:
        new = last[at] < 0
        first[at[new]], other[0, at[new]] = k, beside[new]
        last[at], other[1, at] = k, beside
    got, more = np.flatnonzero(last >= 0), np.flatnonzero((last >= 0) & (other[0] != other[1]))
    at, beside = np.concatenate([got, more]), np.concatenate([other[1, got], other[0, more]])
    return doc[at], place[at] - last[at], place[at] - first[at] + LEAST, beside


def shared_windows(hashes, doc, place) -> tuple[np.ndarray, ...]:
    """Doc, start, end, other doc of the first and the last window of each suffix that another document has as well."""
    def columns():
        for k in range(SPREAD):
            order, h, low, high, _ = _grouped(hashes[:, k], doc)
            hit = (low != high) & (h != 0)
            at = order[hit]
            yield k, at, np.where(low[hit] != doc[at], low[hit], high[hit])
    return _ends(doc, place, columns())


def distinct_windows(hashes, doc) -> tuple[np.ndarray, ...]:
    """Each window of some suffixes once, with its lowest and highest document."""
    _, h, low, high, starts = _grouped(hashes.ravel(), np.repeat(doc, hashes.shape[1]))
    starts = starts[h[starts] != 0]
    return h[starts], low[starts], high[starts]


def known_windows(hashes, doc, place, window, low, high) -> tuple[np.ndarray, ...]:
    """The same as shared_windows where the shared windows and their documents are known."""
    order = np.argsort(window)
    window, low, high = window[order], low[order], high[order]

    def columns():
        for k in range(SPREAD):
            found = np.minimum(np.searchsorted(window, hashes[:, k]), len(window) - 1)
            at = np.flatnonzero((window[found] == hashes[:, k]) & (hashes[:, k] != 0))
            found = found[at]
            yield k, at, np.where(low[found] != doc[at], low[found], high[found])
    return _ends(doc, place, columns() if len(window) else ())


_ORDER = ["key", "after", "before", "doc_id", "place"]
_MADE = {"kind": pa.int64(), "part": pa.int64(), "doc_id": pa.int64(), "start": pa.int64(), "end": pa.int64(), "other": pa.int64(), "window": pa.int64(),
         "key": pa.int64(), "after": pa.binary(), "before": pa.binary(), "place": pa.int64()}
_MATCH, _WINDOW, _OPEN, _FIRST, _LAST = range(5)  # kinds of rows: a match; a distinct window; a suffix of the first or last key; the partition's ends


def _rows(kind: int, part: int, count: int, **columns) -> pa.RecordBatch:
    columns |= {"kind": np.full(count, kind), "part": np.full(count, part)}
    return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(count, t) for c, t in _MADE.items()], list(_MADE))


def _inside(batches):
    """Matches of one sorted partition, and what its neighbours and the other holders of its outer keys must see."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    part = TaskContext.get().partitionId()
    table = pa.Table.from_batches(held).combine_chunks()
    key, doc, place = (table.column(c).to_numpy() for c in ("key", "doc_id", "place"))
    after, before = _words(table.column("after").to_pylist()), _words(table.column("before").to_pylist())
    hit = compared(key, after, before, doc, place)
    yield _rows(_MATCH, part, len(hit[0]), **dict(zip(("doc_id", "start", "end", "other"), hit)))
    hashes, edge = windows(key, after, before), (key == key[0]) | (key == key[-1])
    if not edge.all():
        hit = shared_windows(hashes[~edge], doc[~edge], place[~edge])
        yield _rows(_MATCH, part, len(hit[0]), **dict(zip(("doc_id", "start", "end", "other"), hit)))
    window, low, high = distinct_windows(hashes[edge], doc[edge])
    yield _rows(_WINDOW, part, len(window), window=window, doc_id=low, other=high)
    for kind, at in ((_OPEN, np.flatnonzero(edge)), (_FIRST, [0]), (_LAST, [table.num_rows - 1])):
        for own in table.take(pa.array(at, pa.int64())).combine_chunks().to_batches():
            yield _rows(kind, part, own.num_rows, **{c: own.column(c) for c in _ORDER})


def _completed(batches):
    """All matches by windows and neighbours: those made inside a partition as they are, and those of its outer keys
    from the shared windows that came back."""
    names = ["doc_id", "start", "end", "other"]
    held = []
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        yield batch.filter(pa.array(kinds == _MATCH)).select(names)
        held += [batch.filter(pa.array(kinds != _MATCH))] if (kinds != _MATCH).any() else []
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    parts, is_window = table.column("part").to_numpy(), table.column("kind").to_numpy() == _WINDOW
    for part in np.unique(parts):
        back, own = (table.filter(pa.array((parts == part) & x)) for x in (is_window, ~is_window))
        if back.num_rows and own.num_rows:
            key, doc, place = (own.column(c).to_numpy() for c in ("key", "doc_id", "place"))
            hashes = windows(key, _words(own.column("after").to_pylist()), _words(own.column("before").to_pylist()))
            hit = known_windows(hashes, doc, place, *(back.column(c).to_numpy() for c in ("window", "doc_id", "other")))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in hit], names)


def _across(batches):
    """The last suffix of a partition against the first of the next."""
    for batch in batches:
        if batch.num_rows:
            column = lambda c: np.stack([batch.column(f"{c}_{s}").to_numpy() for s in "xy"], 1).ravel()
            texts = lambda c: _words([v for pair in zip(batch.column(f"{c}_x").to_pylist(), batch.column(f"{c}_y").to_pylist()) for v in pair])
            key, doc, place, after, before = column("key"), column("doc_id"), column("place"), texts("after"), texts("before")
            for k in range(0, len(key), 2):
                two = slice(k, k + 2)
                hit = compared(key[two], after[two], before[two], doc[two], place[two])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in hit], ["doc_id", "start", "end", "other"])


def matches(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, other of every retained suffix's matches; positions in words, end exclusive."""
    spark = docs.sparkSession
    every = stored(suffixes(docs))
    # Written before the join: both sides are then exchanged for it, and a key of a third of all suffixes can be split.
    often = stored(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    found = stored(_with_context(docs, every.join(often, "key").select("key", "doc_id", "place")))
    tasks = max(spark.sparkContext.defaultParallelism, -(-found.count() // PARTITION_ROWS))
    ordered = found.repartitionByRange(tasks, *_ORDER).sortWithinPartitions(*_ORDER)
    out = stored(ordered.mapInArrow(_inside, ", ".join(f"{c} {'binary' if t == pa.binary() else 'long'}" for c, t in _MADE.items())))
    of = lambda kind: out.where(F.col("kind") == kind)
    match = "doc_id long, start long, end long, other long"
    seen = of(_WINDOW).select("window", "part", F.col("doc_id").alias("low"), F.col("other").alias("high"))
    shared = stored(seen.groupBy("window").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high"))
    back = seen.select("window", "part").join(shared, "window").select(
        F.lit(_WINDOW).cast("long").alias("kind"), "part", F.col("low").alias("doc_id"), F.col("high").alias("other"), "window")
    outer = back.unionByName(of(_OPEN).select("kind", "part", *_ORDER), allowMissingColumns=True).repartition(tasks, "part")
    done = of(_MATCH).unionByName(outer, allowMissingColumns=True).mapInArrow(_completed, match)
    ends = lambda kind, side, part: of(kind).select(part.alias("part"), *[F.col(c).alias(f"{c}_{side}") for c in _ORDER])
    across = ends(_LAST, "x", F.col("part") + 1).join(ends(_FIRST, "y", F.col("part")), "part").drop("part").mapInArrow(_across, match)
    return done.unionByName(across)


def spans(docs: DataFrame) -> DataFrame:
    """One row per maximal repeated span: doc_id, start_word, end_word, n_words, others (documents next to it in suffix order or with one of its windows)."""
    own = matches(docs).groupBy("doc_id", "start", "end").agg(F.collect_set("other").alias("others"))  # at most one for each suffix and window
    by_doc = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before >= F.col("start"), 0).otherwise(1)).over(by_doc.rowsBetween(Window.unboundedPreceding, 0))
    return (own.withColumn("island", island).groupBy("doc_id", "island")
            .agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("others")))).alias("others"))
            .select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "others"))
