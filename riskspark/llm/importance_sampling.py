"""Drawing documents that look like a target: hashed n-gram importance weights and Gumbel-perturbed ranks.

Features are all runs of 1 to `longest` consecutive words; a feature's bucket is the CRC-32 of its words joined by
one blank. A dictionary of delimiter-bounded distinct words (" word ") is kept as an Aho-Corasick automaton whose
payload leads to the word's CRC and length. One scan of a block of texts emits the payloads in order; words that
the dictionary lacks show as gaps between matches and get their payload from their bytes. The CRC of a run is
composed from the payloads of adjacent words: crc(x y) is crc(x) moved on by the length of y, and crc(y). No feature
text is ever built, and a bucket is the same whether the dictionary knew the words or not.

The dictionary is made of the DICTIONARY_WORDS most frequent words of up to DICTIONARY_BYTES bytes in a bounded
sample of about SAMPLE_DOCS documents: it decides speed only. Counts, gains, weights and ranks cover all rows.

Bucket counts are combined inside each task, so at most `buckets` rows leave it; the summed tables (a fixed number
of numbers) reach the driver and travel back as gains. Ranks need no global window: rows are range-partitioned by
(drawable, score, id), counted per partition and numbered inside.

Null and empty texts have no words, weight 0 and no rank; a null id is hashed as empty text and comes last among
ties. Repeated rows are documents of their own. Empty tables give no rows; an empty target gives gains from S alone.
Other columns play no part.
"""

from __future__ import annotations

import math
import zlib

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.blocks import explode_texts, map_texts, sample_fraction
from riskspark.llm.word_bytes import block, bounds
from riskspark.scratch import stored, task_count

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
SAMPLE_DOCS, DICTIONARY_WORDS, DICTIONARY_BYTES = 2_000, 30_000, 40
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


# --- CRC-32 arithmetic -------------------------------------------------------

def _byte_tables() -> np.ndarray:
    """tables[b]: what moving a CRC on by 2^b zero bytes does to each of its four bytes."""
    one = np.uint64(1) << np.arange(32, dtype=np.uint64)  # images of the 32 single bits under one zero byte
    for _ in range(8):
        one = one >> np.uint64(1) ^ (one & np.uint64(1)) * np.uint64(0xEDB88320)
    set_bits = np.arange(256)[:, None] >> np.arange(8) & 1 == 1
    made = []
    for _ in range(32):
        table = np.array([np.bitwise_xor.reduce(np.where(set_bits, one[8 * byte:8 * byte + 8], np.uint64(0)), axis=1) for byte in range(4)])
        made.append(table)
        one = _moved_once(one, table)
    return np.array(made)


def _moved_once(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = table[0, crc & 255]
    for byte in range(1, 4):
        out = out ^ table[byte, crc >> 8 * byte & 255]
    return out


class Composer:
    """CRC-32 of two texts behind each other from their CRC-32 and the second one's length, for whole arrays."""

    def __init__(self):
        self.tables = _byte_tables()
        self.blank = np.uint64(zlib.crc32(b" "))

    def moved(self, crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        crc = crc.copy()
        for bit in range(int(sizes.max(initial=0)).bit_length()):
            at = np.flatnonzero(sizes >> bit & 1)
            crc[at] = _moved_once(crc[at], self.tables[bit])
        return crc

    def joined(self, left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of left, a blank and right."""
        spaced = _moved_once(left, self.tables[0]) ^ self.blank
        return self.moved(spaced, sizes) ^ right


# --- dictionary and scan -----------------------------------------------------

def dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent words of a bounded sample."""
    share = sample_fraction(docs.sparkSession, docs, SAMPLE_DOCS // 2)
    sample = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) <= int(share * 1_000_000))
    found = sample.select(F.explode(F.regexp_extract_all(F.expr("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"), F.lit(_WORDS), F.lit(0))).alias("w"))
    most = found.where(F.octet_length("w") <= DICTIONARY_BYTES).groupBy("w").count().orderBy(F.desc("count"), "w").limit(words)
    return [r["w"] for r in most.collect()]


class Scanner:
    """CRC and length of every word of a block, by one scan of the automaton."""

    def __init__(self, words: list[str]):
        raw = sorted({w.encode() for w in words if w})
        self.crc = np.array([zlib.crc32(w) for w in raw], np.uint64)
        self.size = np.array([len(w) for w in raw], np.int64)
        self.automaton = ahocorasick.Automaton()
        for k, w in enumerate(raw):  # bytes as Latin-1 signs: places are byte offsets
            self.automaton.add_word(f" {w.decode('latin-1')} ", k)
        if raw:
            self.automaton.make_automaton()
        self.compose = Composer()

    def payloads(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, CRC and length of every word, in order."""
        starts, ends = bounds(data)
        sizes = ends - starts
        crc, known = np.zeros(len(starts), np.uint64), np.zeros(len(starts), bool)
        if len(self.crc):
            hits = np.fromiter(self.automaton.iter(data.decode("latin-1")), np.dtype([("end", np.int64), ("word", np.int64)]))
            at = np.searchsorted(ends, hits["end"])  # a match ends on the blank behind its word
            crc[at], sizes[at], known[at] = self.crc[hits["word"]], self.size[hits["word"]], True
        gaps = np.flatnonzero(~known)
        crc[gaps] = [zlib.crc32(data[s:e]) for s, e in zip(starts[gaps].tolist(), ends[gaps].tolist())]
        return starts, crc, sizes

    def features(self, texts: list[str], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of words of each text, and of each feature its text and its bucket."""
        data, places = block(texts)
        starts, crc, sizes = self.payloads(data)
        doc = np.searchsorted(places, starts, "right") - 1
        docs, found, run = [doc], [crc], crc
        for n in range(1, longest):
            run = self.compose.joined(run[:-1], crc[n:], sizes[n:])  # a run is one word longer than the one before
            inside = doc[:-n] == doc[n:]
            docs.append(doc[:-n][inside])
            found.append(run[inside])
        return np.bincount(doc, minlength=len(texts)), np.concatenate(docs), (np.concatenate(found) % np.uint64(buckets)).astype(np.int64)


# --- counts, gains, weights, draw --------------------------------------------

def bucket_counts(rows: DataFrame, words: list[str], longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows per bucket."""
    def setup():
        scanner = Scanner(words)

        def run(texts, part):
            counts = np.bincount(scanner.features(texts, longest, buckets)[2], minlength=buckets)
            held = np.flatnonzero(counts)
            return {"bucket": held, "n": counts[held]}
        return run

    counted = explode_texts(rows, setup, "bucket int, n long", keep=()).groupBy("bucket").agg(F.sum("n").alias("n"))
    table = np.zeros(buckets, np.int64)
    for r in counted.collect():  # at most one row for each bucket
        table[r["bucket"]] = r["n"]
    return table


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of how much more likely the target is to hold a bucket than the corpus, floored."""
    k, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + k) / ((s + 1) * (all_t + k)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, words: list[str], gain: np.ndarray, longest: int = LONGEST, keep=("doc_id",)) -> DataFrame:
    """The kept columns, n_words, n_features and weight."""
    def setup():
        scanner = Scanner(words)

        def run(texts):
            n_words, doc, bucket = scanner.features(texts, longest, len(gain))
            order = np.argsort(doc, kind="stable")
            sums = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
            n = np.bincount(doc, minlength=len(texts))
            behind = np.cumsum(n)
            return {"__words": n_words, "n_features": n, "weight": sums[behind] - sums[behind - n]}
        return run

    return map_texts(docs, setup, "__words long, n_features long, weight long", keep=keep)


def _ranked(rows: DataFrame, percent: int) -> DataFrame:
    """Ranks of the drawn share by (score descending, id): partition sizes give each partition's first number."""
    spark = rows.sparkSession
    order = [F.col("__can").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = stored(stored(rows).repartitionByRange(task_count(spark), *order).withColumn("__part", F.spark_partition_id()))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("n"), F.count_if("__can").alias("can"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    first = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"),
                         F.expr(f"{percent} * sum(can) over () div 100").alias("__draw"))
    number = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__first")
    return placed.join(F.broadcast(first), "__part").withColumn("rank", number).withColumn(
        "rank", F.when(F.col("__can") & (F.col("rank") <= F.col("__draw")), F.col("rank").cast("long")))


def drawn(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
          percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Every document with n_features, weight, perturbed score, and its rank if it is among the drawn share."""
    words = dictionary(docs)
    gain = gains(bucket_counts(docs, words, longest, buckets), bucket_counts(target, words, longest, buckets))
    u = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000.0 * F.log(-F.log(u)))
    rows = weighed(docs, words, gain, longest).withColumns({"score": F.col("weight") + noise, "__can": F.col("__words") >= least_words})
    return _ranked(rows, percent).select("doc_id", "n_features", "weight", "score", "rank")


def drawn_sql() -> str:
    """The same in DuckDB's SQL, for the parameters above and single words; CRC-32 from a table made by its rule."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{_WORDS}')"
    step = "xor(c >> 1, (c & 1) * 3988292384)"
    return f"""
WITH bits AS (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {step}) AS v FROM range(256) AS r(i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits),
d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT {words} AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS v FROM d),
bw AS (SELECT unnest(w) AS v FROM b),
vocabulary AS (SELECT DISTINCT v FROM (SELECT v FROM dw UNION ALL SELECT v FROM bw)),
bytes AS (SELECT v, list_transform(range(octet_length(encode(v))), lambda i: ('0x' || substr(hex(encode(v)), 2 * i + 1, 2))::BIGINT) AS y FROM vocabulary),
crc AS (SELECT v, xor(list_reduce(y, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket FROM bytes, tab),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (v) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN crc USING (v) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM dw) AS s_all, (SELECT count(*) FROM bw) AS t_all),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + {BUCKETS}) / ((s + 1)::DOUBLE * (t_all + {BUCKETS})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
w AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN crc USING (v) JOIN g USING (bucket) GROUP BY doc_id),
x AS (SELECT doc_id, CAST(len(d.w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_features >= {LEAST_WORDS}),
k AS (SELECT {PERCENT} * count(*) // 100 AS draw FROM r)
SELECT x.doc_id, n_features, weight, score, CASE WHEN rank <= draw THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id), k"""
