"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a small Hamming distance.

Equal fingerprints are one class, so copies cost one row each. Distinct fingerprints are split into six blocks;
two that differ in at most three bits agree in at least three whole blocks, so they meet under one of the twenty
keys made of three blocks. Keys that one fingerprint holds alone are dropped; a key with many is cut into tiles,
and every pair of tiles is compared by itself in vectorised form. A comparison gives back a spanning forest of
its links, never all pairs: components lose nothing by it.

Null and empty texts have the fingerprint zero and are linked like any other. Repeated rows give repeated rows.
Rows without an id take the component of their fingerprint and are nobody's component; if all rows of a
component lack one, it is null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.blocks import map_texts
from riskspark.llm.components import components
from riskspark.scratch import stored, task_count

SHINGLE, SEED, DISTANCE = 3, 42, 3
WIDTHS = (11, 11, 11, 11, 10, 10)
TILE = 1024


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it; as a signed 64-bit number."""
    words = text.encode().lower().split()  # bytes: A-Z and the six ASCII blanks only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= size:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1).tolist()
        starts = [0, *[e + 1 for e in ends[:-1]]]
        hash_ = xxhash.xxh64_intdigest
        hashes = [hash_(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1:])]
    counts = np.zeros(64, np.int64)
    all_ = np.array(hashes, ">u8")
    for at in range(0, len(all_), 65_536):
        part = all_[at:at + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(all_)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    def setup():
        return lambda texts: {"fp": [fingerprint(t, size) for t in texts]}
    return map_texts(docs, setup, "fp long")


def _keys():
    """The keys as columns: number of the triple above the bits of its three blocks."""
    places = np.cumsum((0, *WIDTHS[:-1])).tolist()
    block = [F.shiftrightunsigned(F.col("fp"), p).bitwiseAND(F.lit((1 << w) - 1)) for p, w in zip(places, WIDTHS)]
    keys = []
    for number, chosen in enumerate(combinations(range(len(WIDTHS)), len(WIDTHS) - DISTANCE)):
        key = F.lit(number).cast("long")
        for k in chosen:
            key = F.shiftleft(key, WIDTHS[k]).bitwiseOR(block[k])
        keys.append(key)
    return F.array(*keys)


def forest(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Index pairs that span the components among these fingerprints."""
    n = len(fps)
    if n == 2:
        return [(0, 1)] if int(np.bitwise_count(fps[0] ^ fps[1])) <= distance else []
    waiting, edges = np.ones(n, bool), []
    for first in range(n):
        if not waiting[first]:
            continue
        waiting[first] = False
        stack = [first]
        while stack:
            at = stack.pop()
            near = np.flatnonzero(waiting & (np.bitwise_count(fps ^ fps[at]) <= distance))
            waiting[near] = False
            edges += [(at, int(k)) for k in near]
            stack += near.tolist()
    return edges


def links(classes: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the ids of distinct fingerprints (fp, id): a spanning forest of each comparison."""
    keyed = classes.select("fp", "id", F.explode(_keys()).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    own = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / tile))
    dealt = (keyed.join(shared, "key").withColumn("own", own)
             .select("key", "fp", "id", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / tile) - 1)).alias("other"))
             .select("key", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("s"), "fp", "id"))
    spread = dealt.repartition(4 * task_count(classes.sparkSession), "key", "t", "s").sortWithinPartitions("key", "t", "s", "fp")

    def run(batches):
        held = None
        for batch in batches:
            table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            names = np.stack([table.column(c).to_numpy() for c in ("key", "t", "s")], 1)
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            held = table.slice(last)  # its group may go on in the next batch
            yield from found(table.slice(0, last), cuts[:-1])
        if held is not None:
            yield from found(held, [])

    def found(table, cuts):
        if not table.num_rows:
            return
        fps, ids = table.column("fp").to_numpy().view(np.uint64), table.column("id").to_numpy()
        edges = []
        for s, e in zip([0, *cuts], [*cuts, table.num_rows]):
            edges += [(ids[s + i], ids[s + j]) for i, j in forest(fps[s:e])]
        a, b = (np.array([x[k] for x in edges], np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return spread.mapInArrow(run, "a long, b long").distinct()


def grouped(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    prints = stored(fingerprints(docs, size))
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    roots = components(links(classes.where("id IS NOT NULL")))
    named = classes.join(roots, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
