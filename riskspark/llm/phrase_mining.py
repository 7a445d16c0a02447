"""Collocations of two to four words, from count streams kept in two orders and merged in lockstep.

Counting is level by level. A phrase found FEWEST times or more consists of shorter phrases found as often, so the
pass for n words only emits runs whose two parts of n - 1 words may be that frequent. What may be frequent is known
from a bit table of fixed size (FILTER_BITS) filled with the hashes of the frequent phrases of the passes before: it
lets some others through, stops none, and the exact counts of the pass decide. With more frequent phrases than the table
can tell apart, more rows are shuffled and nothing else changes. In a task, runs are numbered and counted for about
BUFFER_BYTES of text at a time, by the words themselves, before they are summed over tasks.

The counts are one stream per order: `forward` sorted by the phrase's words from the first on, `backward` by the words
from the last on. Sort-merge joins walk two sorted streams in lockstep, no hash table is built: candidates against
`forward` give l, the count of the first k words of every cut; against `backward` they give r, of the rest; and the
extensions of a phrase stand next to it, those to the right in forward, those to the left in backward order. A longer
candidate that holds a phrase holds it in an extension by one word, whose count is at least as high, so those
extensions decide which phrases go.

A language's candidates are cut to its best `limit` inside salted parts first, so that no task sorts a language. Scores
are exact integers from 38-digit decimals. A null text is empty, a null lang is `und`. Repeated rows count as often as
they stand there. An empty table has no rows. Other columns play no part. One text is held whole in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.blocks import bounded_batches
from riskspark.llm.word_bytes import mixed
from riskspark.scratch import stored, task_count

FEWEST, LONGEST, LIMIT, COVER, SCALE = 30, 4, 2_000, 80, 2_000_000
FILTER_BITS, BUFFER_BYTES = 1 << 25, 8_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
# A-Z lower-cased; blanks and tabs between words, signs that end a piece as line feeds, text ends too.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c for c in range(256))


# --- words and runs of one buffer --------------------------------------------

def tidy(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words each with one sign behind them (a blank, or a line feed at the end of a piece), their ends, and whether a piece goes on."""
    data = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode().translate(_TABLE), np.uint8)
    gap = (data == 32) | (data == 10)
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    breaks = np.cumsum(data == 10)
    on = np.zeros(len(starts), bool)
    on[:-1] = breaks[starts[1:]] == breaks[ends[:-1] - 1]
    kept = ~gap
    kept[ends] = True  # one sign behind each word
    data = data.copy()
    data[ends] = np.where(on, 32, 10)
    return data[kept].tobytes(), np.cumsum(ends - starts + 1), on


def word_hash(word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(word, seed)


def _chained(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a run with one more word."""
    return mixed(run * _STEP + word)


def seed_of(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode()) & 0x7FFFFFFF


def _may(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bits) - 1)
    return bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def counted(texts: list[str], lang: str, size: int, filters: list[np.ndarray]) -> tuple[pa.Array, np.ndarray, int]:
    """Distinct runs of `size` words whose parts may be frequent, how often each occurs, and the number of words."""
    data, behind, on = tidy(texts)
    n = len(behind)
    if n == 0:
        return pa.array([], pa.string()), np.zeros(0, np.int64), 0
    offsets = np.concatenate([[0], behind])
    spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    # A word stands with the sign behind it, blank or line feed, so one word can have two numbers; made one below.
    coded = spelled.dictionary_encode()
    seed = seed_of(lang)
    distinct = [w[:-1] for w in coded.dictionary.to_pylist()]
    number = {}
    merge = np.fromiter((number.setdefault(w, len(number)) for w in distinct), np.int64, len(distinct))
    word = merge[np.asarray(coded.indices)]
    hashes = np.fromiter((word_hash(w, seed) for w in number), np.uint64, len(number))
    # Runs by their first word: `at` are the places where a run of the length reached so far stands, `ids` their numbers.
    at, ids, hashed = np.arange(n), word, hashes[word]
    for k in range(1, size):
        ok = _may(filters[k - 1], hashed)
        alive = np.zeros(n + 1, bool)
        alive[at[ok]] = True
        pick = ok & on[np.minimum(at + k - 1, n - 1)] & (at + k < n)
        pick &= alive[np.minimum(at + 1, n)]  # the run without its first word may be frequent too
        at, ids, hashed = at[pick], ids[pick], hashed[pick]
        last = word[at + k]
        _, ids = np.unique(ids * len(number) + last, return_inverse=True)
        hashed = _chained(hashed, hashes[last])
    if not len(at):
        return pa.array([], pa.string()), np.zeros(0, np.int64), n
    counts = np.bincount(ids)
    first = np.full(len(counts), -1, np.int64)
    first[ids[::-1]] = at[::-1]
    held = counts > 0
    first, counts = first[held], counts[held]
    start, end = offsets[first], offsets[first + size] - 1
    return pa.array([data[s:e].decode() for s, e in zip(start.tolist(), end.tolist())], pa.string()), counts, n


def _runs(docs: DataFrame, size: int, filters: list[np.ndarray]) -> DataFrame:
    """lang, phrase and n of every buffer's runs; with size 1 also the number of words as phrase ''."""
    spark = docs.sparkSession
    bounded_batches(spark)
    tables = spark.sparkContext.broadcast(filters)  # of fixed size
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def run(batches):
        held, sizes = {}, {}

        def made(lang):
            texts = held.pop(lang)
            sizes.pop(lang)
            phrases, n, words = counted(texts, lang, size, tables.value)
            if size == 1:
                phrases, n = pa.concat_arrays([phrases, pa.array([""])]), np.append(n, words)
            for k in range(0, len(n), 100_000):
                part = phrases[k:k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, pa.array(n[k:k + 100_000])], schema=schema)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                held.setdefault(lang, []).append(text.as_py())
                sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1])
                if sum(sizes.values()) >= BUFFER_BYTES:
                    yield from made(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from made(lang)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "lang string, phrase string, n long")


def _filter(frequent: DataFrame) -> np.ndarray:
    """Bits of the frequent phrases, from at most FILTER_BITS / 32 rows."""
    def run(batches):
        for batch in batches:
            bits = np.zeros(batch.num_rows, np.int64)
            seeds = {}
            for k, (lang, phrase) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())):
                seed = seeds.setdefault(lang, seed_of(lang))
                words = np.array([word_hash(w, seed) for w in phrase.encode().split(b" ")], np.uint64)
                h = words[:1]
                for w in range(1, len(words)):
                    h = _chained(h, words[w:w + 1])
                bits[k] = int(h[0]) & FILTER_BITS - 1
            yield pa.RecordBatch.from_arrays([pa.array(bits >> 5), pa.array(1 << (bits & 31))], ["place", "bits"])

    rows = frequent.select("lang", "phrase").mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits"))
    found = rows.toArrow()
    table = np.zeros(FILTER_BITS >> 5, "<u4")
    table[found.column("place").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return table.view(np.uint8)


def counts(docs: DataFrame, fewest: int = FEWEST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to `longest` words found `fewest` times or more (lang, size, phrase, n), and words per lang."""
    filters, levels, total = [], [], None
    for size in range(1, longest + 1):
        summed = _runs(docs, size, filters).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        level = stored(summed.where((F.col("n") >= fewest) | (F.col("phrase") == "")))
        if size == 1:
            total = level.where("phrase = ''").select("lang", F.col("n").alias("words"))
            level = level.where("phrase <> ''")
        levels.append(level.select("lang", F.lit(size).alias("size"), "phrase", "n"))
        if size < longest:
            filters.append(_filter(level))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every, total


# --- the two orders ----------------------------------------------------------

def mined(docs: DataFrame, fewest: int = FEWEST, longest: int = LONGEST, cover: int = COVER, limit: int = LIMIT) -> DataFrame:
    """Best phrases per lang: lang, rank, phrase, a, l, r, n, score."""
    return best(*counts(docs, fewest, longest), cover, limit)


def best(every: DataFrame, total: DataFrame, cover: int = COVER, limit: int = LIMIT) -> DataFrame:
    """The same from the counts of all frequent phrases (lang, size, phrase, n) and of all words (lang, words)."""
    # The layout: each phrase with its words in both orders; sorted by the joins below, on the order that each needs.
    every = every.select("lang", "size", "n", F.col("phrase").alias("forward"),
                         F.array_join(F.reverse(F.split("phrase", " ")), " ").alias("backward"))
    candidates = every.where("size >= 2")
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = candidates.select("lang", "forward", "backward", F.col("n").alias("a"), "size", cut)
    heads = cuts.withColumns({"left": F.expr("substring_index(forward, ' ', k)"), "right": F.expr("substring_index(backward, ' ', size - k)")})
    # `right` is in backward order: the last words of the phrase, read from the end.
    left = every.select(F.col("lang"), F.col("forward").alias("left"), F.col("n").alias("l")).hint("merge")
    right = every.select(F.col("lang"), F.col("backward").alias("right"), F.col("n").alias("r")).hint("merge")
    parts = heads.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    score = F.expr(f"CAST(CAST({SCALE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS BIGINT)")
    worst = parts.withColumn("score", score).groupBy("lang", "forward").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("m"), F.first("backward").alias("backward"), F.first("a").alias("a"))
    longer = every.where("size >= 3").select("lang", "forward", "backward", "n", F.expr("size - 1").alias("less"))
    more = lambda order: longer.groupBy("lang", F.expr(f"substring_index({order}, ' ', less)").alias(order)).agg(F.max("n").alias(f"{order}_n")).hint("merge")
    grown = worst.join(more("forward"), ["lang", "forward"], "left").join(more("backward"), ["lang", "backward"], "left")
    held = F.greatest(F.coalesce("forward_n", F.lit(0)), F.coalesce("backward_n", F.lit(0)))
    kept = grown.where(F.lit(100).cast("decimal(10,0)") * held.cast("decimal(20,0)") < F.lit(cover).cast("decimal(10,0)") * F.col("a").cast("decimal(20,0)")).select(
        "lang", F.col("forward").alias("phrase"), "a", "m.l", "m.r", "m.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(task_count(every.sparkSession)))
    first = kept.withColumn("part", part).withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("at") <= limit)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= limit)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


def mined_sql() -> str:
    """The same in DuckDB's SQL."""
    words = r"regexp_extract_all(piece, '[^\x20\x09]+')"
    sizes = range(1, LONGEST + 1)
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS size, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM p WHERE len(w) >= {k})" for k in sizes)
    cuts = " UNION ALL ".join(f"SELECT lang, phrase, a, {k} AS k, array_to_string(w[1:{k}], ' ') AS lp, array_to_string(w[{k + 1}:], ' ') AS rp FROM c WHERE size > {k}" for k in range(1, LONGEST))
    inside = " UNION ALL ".join(f"SELECT lang, a AS f, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, a, w, unnest(range(1, size - {k - 2})) AS i FROM c WHERE size > {k})" for k in range(2, LONGEST))
    return f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, {words} AS w FROM t),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS a FROM ({grams}) GROUP BY lang, size, phrase HAVING count(*) >= {FEWEST}),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size >= 2),
s AS (SELECT x.lang, x.phrase, x.a, k, l.a AS l, r.a AS r, CAST({SCALE}::HUGEINT * x.a // (l.a + r.a) AS BIGINT) AS score
      FROM ({cuts}) AS x JOIN f AS l ON l.lang = x.lang AND l.phrase = lp JOIN f AS r ON r.lang = x.lang AND r.phrase = rp),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
g AS (SELECT lang, phrase, max(f) AS most FROM ({inside}) GROUP BY lang, phrase),
o AS (SELECT m.lang, m.phrase, a, l, r, score, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.phrase) AS rank
      FROM m LEFT JOIN g ON g.lang = m.lang AND g.phrase = m.phrase WHERE 100 * coalesce(most, 0) < {COVER} * a)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= {LIMIT}"""
