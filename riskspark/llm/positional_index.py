"""Benchmark passages in training documents, by a distributed positional inverted index.

`build` stores the postings of every word of every document: documents are taken in segments of about SEGMENT_BYTES
of text, and a segment is one row that holds its documents, its sorted distinct terms, their counts and, term after
term, the places of their occurrences (numbered through the segment, as differences). No posting is ever shuffled.
The index is written once to the shared folder and can answer any number of test sets.

`search` looks test items up in blocks of bounded size. Occurrences of the block's terms are counted over the whole
index; in each window of `window` consecutive item words the terms are ranked from the rarest on. In a segment,
windows with a missing term are dropped at once. The others start from the postings of their rarest term, adjusted
by its offset, and are intersected with the adjusted lists of the other terms, rarest first, for all windows in one
vectorised step each. What is left after the last term is an exact phrase match. Besides, an item is near a place
where its `near_terms` rarest words stand within `near_words` words of the rarest one.

A term is the 64-bit hash of a word, the same for index and tests. Words are runs of letters, digits and signs beyond
ASCII, A-Z lower-cased. Null and empty texts have no words and no hits. Rows are documents of their own even if they
share a doc_id or have none. A test item without an id is searched like the others, as item ''; items that share an id are
one item. An empty test set hits nothing, an empty table gives no rows. Other columns play no part. A document or an
item is held whole in one task, whatever its length; documents and items beyond one block's size are blocks of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.llm.blocks import bounded_batches
from riskspark.llm.word_bytes import WordHashes, block, bounds
from riskspark.scratch import scratch_dir

WINDOW, NEAR_TERMS, NEAR_WORDS = 10, 4, 20
SEGMENT_BYTES, TEST_BYTES, CANDIDATES = 2_000_000, 4_000_000, 1_000_000
INDEX = "segment long, doc_ids array<long>, n_words array<int>, terms binary, counts binary, places binary"
HITS = "segment long, ord int, item string, near boolean, start int, end int"
_HIGH = np.uint64(32)


def _words(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """A block, the bounds of its words, and each text's number of words."""
    data, places = block(texts)
    starts, ends = bounds(data)
    return data, starts, ends, np.bincount(np.searchsorted(places, starts, "right") - 1, minlength=len(texts))


def _inverted(hashes: WordHashes, segment: int, ids: list, texts: list[str]) -> dict:
    data, starts, ends, sizes = _words(texts)
    terms = hashes(data, starts, ends)
    order = np.argsort(terms, kind="stable")
    distinct, first, counts = np.unique(terms[order], return_index=True, return_counts=True)
    steps = np.diff(order, prepend=0)
    steps[first] = order[first]
    return {"segment": segment, "doc_ids": ids, "n_words": sizes.tolist(), "terms": distinct.tobytes(),
            "counts": counts.astype(np.uint32).tobytes(), "places": steps.astype(np.uint32).tobytes()}


def build(docs: DataFrame, path: str) -> None:
    """Write the index of the rows (doc_id, text). One scan, no shuffle; a lost task is rerun."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = pa.schema([("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())),
                        ("terms", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])

    def run(batches):
        hashes, ids, texts, held = WordHashes(), [], [], 0
        segment = TaskContext.get().partitionId() << 32

        def row():
            return pa.RecordBatch.from_pylist([_inverted(hashes, segment, ids, texts)], schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
                if held >= SEGMENT_BYTES:
                    yield row()
                    ids, texts, held, segment = [], [], 0, segment + 1
        if ids:
            yield row()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Few rows in a row group, so that a reader holds few segments at a time.
    (chosen.mapInArrow(run, INDEX).write.option("parquet.block.size", 16 << 20).option("parquet.page.size.row.check.min", 4)
     .option("parquet.block.size.row.check.min", 4).parquet(path))


def opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


class Tests:
    """One block of test items: their terms, their distinct windows and which items have them."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.items = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.items)}
        data, starts, ends, sizes = _words([t for _, t in items])
        found, at, words = np.unique(WordHashes()(data, starts, ends), return_index=True, return_inverse=True)
        spelled = sorted(range(len(found)), key=lambda k: data[starts[at[k]]:ends[at[k]]])
        self.terms, place = found[spelled], np.argsort(spelled)  # in order of their words, which settles ties of rarity
        words = place[words]
        rows, owners, self.own = [], [], []  # own: distinct terms of each item row
        for (item, _), behind, n in zip(items, np.cumsum(sizes), sizes):
            of = words[behind - n:behind]
            if n:
                wide = np.full((max(1, n - window + 1), window), -1, np.int64)
                wide[:, :min(n, window)] = np.lib.stride_tricks.sliding_window_view(of, min(n, window))
                rows.append(wide)
                owners.append(np.full(len(wide), number[item]))
                self.own.append((number[item], np.unique(of)))
        every = np.concatenate(rows) if rows else np.zeros((0, window), np.int64)
        self.windows, at = np.unique(every, axis=0, return_inverse=True)
        self.size = (self.windows >= 0).sum(1)
        pairs = np.unique(np.stack([at.ravel(), np.concatenate(owners) if rows else np.zeros(0, np.int64)], 1), axis=0)
        self.owner, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))

    def ranked(self, counts: np.ndarray, near_terms: int) -> None:
        """Order of the terms in each window from the rarest on; rarest terms of each item."""
        weight = np.where(self.windows >= 0, counts[self.windows], np.iinfo(np.int64).max)
        self.order = np.argsort(weight, axis=1, kind="stable")
        near = [(k, of[np.argsort(counts[of], kind="stable")][:near_terms]) for k, of in self.own if len(of) >= near_terms]
        self.near_item = np.array([k for k, _ in near], np.int64)
        self.near = np.array([of for _, of in near], np.int64).reshape(-1, near_terms)


class Segment:
    """A segment's postings against one block of tests."""

    def __init__(self, tests: Tests, row: dict):
        self.tests, self.sizes = tests, np.asarray(row["n_words"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        counts, steps = np.frombuffer(row["counts"], np.uint32).astype(np.int64), row["places"]
        at = np.minimum(np.searchsorted(self.terms, tests.terms), max(len(self.terms) - 1, 0))
        self.known = self.terms[at] == tests.terms if len(self.terms) else np.zeros(len(tests.terms), bool)
        self.at, self.counts, self.steps = at, counts, steps
        self.behind = np.cumsum(self.sizes)  # first word behind each document

    def alive(self, rows: np.ndarray) -> np.ndarray:
        """Which rows of terms (-1: none) have all of them here."""
        return np.flatnonzero((self.known[rows] | (rows < 0)).all(1)) if len(self.terms) else np.zeros(0, np.int64)

    def decode(self) -> None:
        """All postings in one ascending list of term << 32 | place."""
        first = np.cumsum(self.counts) - self.counts
        sums = np.cumsum(np.frombuffer(self.steps, np.uint32).astype(np.int64))
        base = np.where(first > 0, sums[first - 1], 0)
        self.first = first
        self.places = sums - np.repeat(base, self.counts)
        self.keys = np.repeat(np.arange(len(self.terms), dtype=np.uint64) << _HIGH, self.counts) | self.places.astype(np.uint64)

    def postings(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query term: which of them, and the place, of every posting."""
        n = self.counts[self.at[term]]
        own = np.repeat(np.arange(len(term)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return own, self.places[np.repeat(self.first[self.at[term]], n) + inner]

    def has(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term has a posting from low to high."""
        key = self.at[term].astype(np.uint64) << _HIGH
        found = np.searchsorted(self.keys, key | np.maximum(low, 0).astype(np.uint64))
        ends = key | np.maximum(high, 0).astype(np.uint64)
        return (found < len(self.keys)) & (self.keys[np.minimum(found, len(self.keys) - 1)] <= ends) & (high >= 0)

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.behind, place, "right")

    def phrases(self, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and first place of every exact occurrence."""
        t = self.tests
        order, size = t.order[alive], t.size[alive]
        own, place = self.postings(t.windows[alive, order[:, 0]])
        start = place - order[own, 0]
        fits = start >= 0
        own, start = own[fits], start[fits]
        for j in range(1, t.windows.shape[1]):
            more = j < size[own]
            off = order[own, j]
            want = start + off
            good = ~more | self.has(np.where(more, t.windows[alive[own], off], 0), want, want)
            own, start = own[good], start[good]
        same = self.doc(start) == self.doc(start + size[own] - 1)
        return alive[own[same]], start[same]

    def near(self, alive: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """Item row and place of every posting of its rarest term with the other ones beside it, in one document."""
        t = self.tests
        own, place = self.postings(t.near[alive, 0])
        for j in range(1, t.near.shape[1]):
            doc = self.doc(place)
            low, high = np.maximum(place - within, self.behind[doc] - self.sizes[doc]), np.minimum(place + within, self.behind[doc] - 1)
            good = self.has(t.near[alive[own], j], low, high)
            own, place = own[good], place[good]
        return alive[own], place


def _chunks(alive: np.ndarray, cost: np.ndarray) -> list[np.ndarray]:
    """Rows in groups of about CANDIDATES starting postings."""
    return np.split(alive, np.flatnonzero(np.diff(np.cumsum(cost) // CANDIDATES)) + 1) if len(alive) else []


def _runs(doc: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping and touching places of one document and item made one."""
    order = np.lexsort((start, item, doc))
    doc, item, start, end = doc[order], item[order], start[order], end[order]
    group = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))])
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(group * wide + end) - group * wide
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] > reach[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return doc[first], item[first], start[first], reach[last]


def _hits(tests: Tests, row: dict, within: int) -> tuple[list, ...]:
    """Columns ord, item number, near, start, end of one segment."""
    here = Segment(tests, row)
    alive, beside = here.alive(tests.windows), here.alive(tests.near)
    out = [np.zeros(0, np.int64)] * 5
    if not len(alive) and not len(beside):
        return out
    here.decode()
    local = lambda term: here.counts[here.at[term]]
    for rows in _chunks(alive, local(tests.windows[alive, tests.order[alive, 0]])):
        window, start = here.phrases(rows)
        n = tests.first[window + 1] - tests.first[window]
        if len(window):
            pick = np.repeat(np.arange(len(window)), n)
            item = tests.owner[np.repeat(tests.first[window], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            doc, item, start, end = _runs(here.doc(start)[pick], item, start[pick], (start + tests.size[window])[pick])
            first = here.behind[doc] - here.sizes[doc]
            out = [np.concatenate(x) for x in zip(out, (doc, item, np.zeros(len(doc)), start - first, end - first))]
    for rows in _chunks(beside, local(tests.near[beside, 0])):
        which, place = here.near(rows, within)
        doc = here.doc(place)
        pairs, at = np.unique(np.stack([doc, tests.near_item[which]], 1), axis=0, return_index=True)
        if len(at):
            start = place[at] - (here.behind[doc[at]] - here.sizes[doc[at]])
            out = [np.concatenate(x) for x in zip(out, (pairs[:, 0], pairs[:, 1], np.ones(len(at)), start, start + 1))]
    return out


def _counts(index: DataFrame, tests: Tests) -> np.ndarray:
    """Occurrences of the block's terms in the whole index, summed in each task first."""
    terms = tests.terms

    def run(batches):
        sums = np.zeros(len(terms), np.int64)
        for batch in batches:
            for found, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
                found = np.frombuffer(found, np.uint64)
                if len(found):
                    at = np.minimum(np.searchsorted(found, terms), len(found) - 1)
                    sums += np.where(found[at] == terms, np.frombuffer(counts, np.uint32)[at], 0)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(sums[held], pa.int64())], ["term", "n"])

    total = np.zeros(len(terms), np.int64)
    for r in index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        total[r["term"]] = r["n"]  # one row for each term of the block
    return total


def search(index: DataFrame, tests: DataFrame, window: int = WINDOW, near_terms: int = NEAR_TERMS, near_words: int = NEAR_WORDS) -> DataFrame:
    """Matches of the test rows (item_id, text): segment, ord (document), item, near, start, end (words, end exclusive).

    Exact phrases as maximal runs of each document and item; near places once for each document and item.
    """
    spark = index.sparkSession
    bounded_batches(spark)
    tests = tests.where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / TEST_BYTES))
    found = None
    for number in range(blocks):
        own = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number)  # one block of the test set
        of = Tests([(r["item"], r["text"]) for r in own.collect()], window)
        of.ranked(_counts(index, of), near_terms)
        shared = spark.sparkContext.broadcast(of)

        def run(batches, shared=shared):
            tests = shared.value
            names = np.array(tests.items, dtype=object)
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {c: batch.column(c)[k].as_py() for c in ("segment", "n_words", "terms", "counts", "places")}
                    doc, item, near, start, end = _hits(tests, row, near_words)
                    if len(doc):
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(doc), row["segment"]), pa.int64()), pa.array(doc, pa.int32()), pa.array(names[item.astype(np.int64)], pa.string()),
                            pa.array(near.astype(bool)), pa.array(start.astype(np.int64), pa.int32()), pa.array(end.astype(np.int64), pa.int32())],
                            ["segment", "ord", "item", "near", "start", "end"])

        hits = index.select("segment", "n_words", "terms", "counts", "places").mapInArrow(run, HITS)
        found = hits if found is None else found.unionByName(hits)
    return found


def contaminated(docs: DataFrame, tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, n_near (items near a place of it)."""
    path = scratch_dir(docs.sparkSession)
    build(docs, path)
    index = opened(docs.sparkSession, path)
    hits = search(index, tests, window)
    before = F.max("end").over(Window.partitionBy("segment", "ord", "near").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    exact, items = F.when(~F.col("near"), F.col("item")), F.array_sort(F.collect_set(F.when(~F.col("near"), F.col("item"))))
    summed = hits.withColumn("fresh", fresh).groupBy("segment", "ord").agg(
        F.sum(F.when(~F.col("near"), F.col("fresh"))).alias("n_hit"), F.count_distinct(exact).alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), F.count_distinct(F.when(F.col("near"), F.col("item"))).alias("n_near"))
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words"))).select("segment", F.col("pos").alias("ord"), "col.doc_ids", "col.n_words")
    none = F.lit(0).cast("long")
    n_hit = F.coalesce(F.col("n_hit").cast("long"), none)
    return rows.join(summed, ["segment", "ord"], "left").select(
        F.col("doc_ids").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce(F.col("n_items").cast("long"), none).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.coalesce(F.col("n_near").cast("long"), none).alias("n_near"))


def contaminated_sql() -> str:
    """The same in DuckDB's SQL; near places by their definition over positions."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
win AS (SELECT item, len(v) AS m, array_to_string(v, ' ') AS phrase FROM
        (SELECT item, unnest(list_transform(range(greatest(len(w) - {WINDOW}, 0) + 1), lambda i: w[i + 1:i + {WINDOW}])) AS v FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
runs AS (SELECT doc_id, m, s, array_to_string(w[s + 1:s + m], ' ') AS phrase FROM
         (SELECT doc_id, m, w, unnest(range(len(w) - m + 1)) AS s FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT DISTINCT doc_id, s, m, item FROM runs JOIN win USING (m, phrase)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT doc_id, s, m FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id),
pos AS MATERIALIZED (SELECT doc_id, unnest(w) AS v, unnest(range(len(w))) AS p FROM d),
freq AS (SELECT v, count(*) AS n FROM pos GROUP BY v),
br AS (SELECT row_number() OVER () AS r, item, w FROM b),
bt AS (SELECT r, item, v, coalesce(n, 0) AS n FROM (SELECT DISTINCT r, item, unnest(w) AS v FROM br) LEFT JOIN freq USING (v)),
rare AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n, v) AS k, count(*) OVER (PARTITION BY r) AS c FROM bt),
few AS MATERIALIZED (SELECT r, item, k, doc_id, p FROM rare JOIN pos USING (v) WHERE c >= {NEAR_TERMS} AND k <= {NEAR_TERMS}),
beside AS (SELECT x.r, x.item, x.doc_id, x.p FROM few AS x JOIN few AS y ON x.r = y.r AND x.doc_id = y.doc_id AND x.k = 1 AND y.k > 1 AND abs(x.p - y.p) <= {NEAR_WORDS}
           GROUP BY x.r, x.item, x.doc_id, x.p HAVING count(DISTINCT y.k) = {NEAR_TERMS - 1}),
near AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM beside GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)"""
