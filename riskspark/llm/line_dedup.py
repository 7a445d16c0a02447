"""Lines that many documents share, by sharded cuckoo filters over exact reference counts; reversible.

A line's key is its text without ASCII blanks at both ends and with A-Z lower-cased, kept as a 128-bit hash.
Postings (key, doc_id) are the exact table; reference counts (documents and largest id per key) derive from it,
and so can follow insertions and deletions of documents. Keys at or over the threshold sit in cuckoo filters,
one per shard, from which a key can be taken out again. A line is first put to the filters; what passes is
verified against the reference counts by an equi-join, so the result is exact whatever the filters let through.
Postings meet their shard's filter in one task; a shard with more than `SHARD_POSTINGS` of them (a line that
very many documents hold) is split by document, each split with its own copy of the filter.

Null and empty texts are one empty line. Rows that share a doc_id are one document. Rows without an id lose
shared lines but are not counted as documents. A text all of whose lines go is empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from riskspark.llm.blocks import explode_texts
from riskspark.scratch import stored

BLANKS = "\x20\t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}
MIN_CHARS, MIN_DOCS = 20, 3
SLOTS, SHARD_KEYS, SHARD_POSTINGS = 4, 40_000, 200_000


def line_key(line: str) -> bytes | None:
    """Hash of a line's key, None for keys under the least length."""
    key = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(key.translate(LOWER).encode()) if len(key) >= MIN_CHARS else None


def postings(docs: DataFrame) -> DataFrame:
    """Distinct (key, doc_id) of all lines that are long enough."""
    def setup():
        def run(texts, part):
            out = {"key": [], "doc_id": []}
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                keys = {line_key(x) for x in text.split("\n")} - {None}
                out["key"] += keys
                out["doc_id"] += [doc_id] * len(keys)
            return out
        return run

    return explode_texts(docs, setup, "key binary, doc_id long").distinct()


def reference_counts(posted: DataFrame) -> DataFrame:
    """key, n_docs, last_doc of every key."""
    return posted.groupBy("key").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))


class Cuckoo:
    """A cuckoo filter of 16-bit marks in buckets of four. Marks are never zero; zero is an empty slot."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.mask = buckets - 1
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def of(cls, keys: list[bytes], room: int | None = None) -> Cuckoo:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, room or len(keys)) / (SLOTS * 0.8)))))
        while True:
            made = cls(buckets)
            if all(made.insert(k) for k in keys):
                return made
            buckets *= 2

    @classmethod
    def read(cls, data: bytes) -> Cuckoo:
        table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)

    def places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
        marks = (words[:, 0] & 0xFFFF).astype(np.int64)
        marks[marks == 0] = 1
        first = ((words[:, 0] >> np.uint64(20)).astype(np.int64)) & self.mask
        return marks, first, self.other(first, marks)

    def other(self, place, mark):
        return (place ^ (mark * 0x5BD1E995)) & self.mask

    def insert(self, key: bytes) -> bool:
        marks, first, second = self.places([key])
        mark, place = int(marks[0]), int(first[0])
        for at in (place, int(second[0])):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        for kick in range(500):
            slot = (mark + kick) % SLOTS
            mark, self.table[place, slot] = int(self.table[place, slot]), mark
            place = int(self.other(place, mark))
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return True
        return False

    def delete(self, key: bytes) -> bool:
        """Takes out one mark of a key that was inserted before."""
        marks, first, second = self.places([key])
        for at in (int(first[0]), int(second[0])):
            held = np.flatnonzero(self.table[at] == marks[0])
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    def contains(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        marks, first, second = self.places(keys)
        return (self.table[first] == marks[:, None]).any(1) | (self.table[second] == marks[:, None]).any(1)


def shard_of(shards: int):
    """The shard of a key."""
    return F.pmod(F.xxhash64("key"), F.lit(shards))


def filters(shared: DataFrame, shards: int) -> DataFrame:
    """shard and the bytes of its filter, from the keys at or over the threshold. A shard holds about SHARD_KEYS keys."""
    def build(table: pa.Table) -> pa.Table:
        made = Cuckoo.of(sorted(table.column("key").to_pylist()))
        return pa.table({"shard": table.column("shard")[:1], "data": pa.array([made.table.tobytes()], pa.binary())})

    return shared.select(shard_of(shards).alias("shard"), "key").groupBy("shard").applyInArrow(build, "shard long, data binary")


def updated_filters(stored_filters: DataFrame, entering: DataFrame, leaving: DataFrame, shared: DataFrame, shards: int) -> DataFrame:
    """Filters after keys came to the threshold or fell below it; a shard without a filter yet gets one.

    `shared` holds the keys at or over the threshold now: a shard whose filter is full is built anew from them, larger.
    """
    changes = entering.select("key", F.lit(1).alias("sign")).union(leaving.select("key", F.lit(-1).alias("sign")))

    def apply(old: pa.Table, new: pa.Table) -> pa.Table:
        held = Cuckoo.read(old.column("data")[0].as_py()) if old.num_rows else Cuckoo.of([], max(64, new.num_rows))
        # Keys leave first. A key that finds no room ends the work on this filter: it has displaced another one.
        fits = all(held.delete(key) if sign < 0 else held.insert(key)
                   for key, sign in sorted(zip(new.column("key").to_pylist(), new.column("sign").to_pylist()), key=lambda x: (x[1], x[0])))
        shard = (old if old.num_rows else new).column("shard")[:1]
        return pa.table({"shard": shard, "data": pa.array([held.table.tobytes() if fits else None], pa.binary())})

    labelled = changes.select(shard_of(shards).alias("shard"), "key", "sign")
    tried = stored(stored_filters.groupBy("shard").cogroup(labelled.groupBy("shard")).applyInArrow(apply, "shard long, data binary"))
    full = tried.where(F.col("data").isNull()).select(F.col("shard").alias("__full"))
    anew = filters(shared.join(full, shard_of(shards) == F.col("__full"), "left_semi"), shards)
    return tried.where(F.col("data").isNotNull()).union(anew)


def passing(posted: DataFrame, kept: DataFrame, shards: int) -> DataFrame:
    """Postings whose key the filter of its shard holds, or seems to hold. Both tables are stored."""
    labelled = posted.select(shard_of(shards).alias("shard"), "key", "doc_id")
    heavy = stored(labelled.groupBy("shard").count().where(F.col("count") > SHARD_POSTINGS)
                   .select(F.col("shard").alias("__heavy"), F.ceil(F.col("count") / SHARD_POSTINGS).alias("splits")))  # Spark sees its size when it plans the joins
    splits = F.coalesce("splits", F.lit(1).cast("long"))
    cells = labelled.join(heavy, F.col("shard") == F.col("__heavy"), "left").select(
        "shard", F.pmod(F.xxhash64("doc_id", "key"), splits).alias("split"), "key", "doc_id")
    copies = kept.join(heavy, F.col("shard") == F.col("__heavy"), "left").select(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), splits - 1)).alias("split"), "data")
    schema = "key binary, doc_id long"

    def put(rows: pa.Table, own: pa.Table) -> pa.Table:
        rows = rows.select(["key", "doc_id"])
        if not own.num_rows:
            return rows.slice(0, 0)
        return rows.filter(pa.array(Cuckoo.read(own.column("data")[0].as_py()).contains(rows.column("key").to_pylist())))

    return cells.groupBy("shard", "split").cogroup(copies.groupBy("shard", "split")).applyInArrow(put, schema)


def inserted(posted: DataFrame, docs: DataFrame) -> DataFrame:
    """Postings after documents came in."""
    return posted.union(postings(docs)).distinct()


def deleted(posted: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Postings after the documents of these ids went out."""
    return posted.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").select("key", "doc_id")


def crossings(before: DataFrame, after: DataFrame, least: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Keys that came to the threshold, and keys that fell below it, between two reference-count tables."""
    was, now = (c.where(F.col("n_docs") >= least).select("key") for c in (before, after))
    return now.join(was, "key", "left_anti"), was.join(now, "key", "left_anti")


def dropped_keys(posted: DataFrame, shared: DataFrame) -> DataFrame:
    """(doc_id, keys) that documents lose: shared keys of which they are not the last holder. Both tables are stored."""
    shards = max(1, -(-shared.count() // SHARD_KEYS))
    tried = passing(posted, filters(shared, shards), shards)
    lost = tried.join(shared.select("key", "last_doc"), "key").where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    return lost.groupBy("doc_id").agg(F.collect_list("key").alias("__lost"))  # no more keys than the document has lines


def _with_lost(docs: DataFrame, columns) -> DataFrame:
    posted = stored(postings(docs))
    shared = stored(reference_counts(posted).where(F.col("n_docs") >= MIN_DOCS))
    lost = dropped_keys(posted, shared).withColumnRenamed("doc_id", "__doc")
    return docs.select(*columns).join(lost, F.col("doc_id").eqNullSafe(F.col("__doc")), "left").drop("__doc")


def _kept(text: str, lost: list[bytes] | None) -> tuple[str, int, int]:
    lines = text.split("\n")
    if not lost:
        return text, len(lines), 0
    gone = set(lost)
    left = [x for x in lines if line_key(x) not in gone]
    return "\n".join(left), len(lines), len(lines) - len(left)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with their columns, text without lost lines; n_chars follows where there is such a column."""
    columns = docs.columns
    joined = _with_lost(docs, columns)
    arrow = to_arrow_schema(docs.schema)
    at, n_at = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def run(batches):
        for b in batches:
            texts = [(t if not lost else _kept(t or "", lost)[0]) for t, lost in zip(b.column("text").to_pylist(), b.column("__lost").to_pylist())]
            changed = [bool(x) for x in b.column("__lost").to_pylist()]
            own = [b.column(c) for c in columns]
            own[at] = pa.array(texts, arrow.field(at).type)
            if n_at is not None:
                own[n_at] = pa.array([len(t) if c else n for t, c, n in zip(texts, changed, own[n_at].to_pylist())], arrow.field(n_at).type)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(own, arrow)], schema=arrow)

    return joined.mapInArrow(run, docs.schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of what is left."""
    joined = _with_lost(docs, ["doc_id", "text"]).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "__lost")
    out = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"

    def run(batches):
        for b in batches:
            made = [_kept(t, lost) for t, lost in zip(b.column("text").to_pylist(), b.column("__lost").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64()),
                                              pa.array([hashlib.sha256(m[0].encode()).hexdigest() for m in made])], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return joined.mapInArrow(run, out)
