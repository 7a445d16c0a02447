"""Phrase mining, importance resampling and decontamination against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskspark.llm import importance_sampling, phrase_mining, positional_index

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def mixed_docs(spark, n=300):
    """Few distinct words, copies, repeated and null ids, several languages, one text of several MB."""
    rng = random.Random(5)
    vocabulary = ["red", "Blue", "gRün", "日本", "x1", "of", "the", "and", "sea", "é"]
    out = []
    for k in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ", ", ". ", "\n", "! ", "-", " "]) for _ in range(rng.randint(0, 60)))
        out.append((k, text, rng.choice(["aa", "aa", "bb", None]), "s", 1, "k", 2, 3.5))
    out += [out[7], out[7], (None, out[8][1], "aa", "s", 1, "k", 2, 3.5), (n, None, "aa", "s", 1, "k", 2, 3.5), (n + 1, "", None, "s", 1, "k", 2, 3.5),
            (n + 2, "the sea and " * 300_000, "cc", "s", 1, "k", 2, 3.5)]
    return out, spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n long, phrase string, a long, score double")


# --- phrase mining -----------------------------------------------------------

def expected_phrases(rows, fewest, cover, limit, longest=4):
    found, total = defaultdict(Counter), Counter()
    for row in rows:
        lang = row[2] or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (row[1] or "").translate(LOWER)):
            own = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(own)
            for size in range(1, longest + 1):
                found[lang].update(tuple(own[i:i + size]) for i in range(len(own) - size + 1))
    out = []
    for lang, f in found.items():
        ranked = []
        for p, a in f.items():
            if len(p) < 2 or a < fewest:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if any(len(q) > len(p) and b >= fewest and 100 * b >= cover * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in f.items()):
                continue
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:limit])]
    return sorted(out, key=str)


@pytest.mark.parametrize("fewest, cover, limit", [(5, 80, 2000), (3, 30, 7)])
def test_phrases_equal_brute_force(spark, fewest, cover, limit):
    rows, docs = mixed_docs(spark)
    assert rows_of(phrase_mining.mined(docs, fewest, 4, cover, limit)) == expected_phrases(rows, fewest, cover, limit)


def test_a_full_table_of_bits_changes_nothing(spark, monkeypatch):
    rows, docs = mixed_docs(spark, 60)
    monkeypatch.setattr(phrase_mining, "FILTER_BITS", 32)
    monkeypatch.setattr(phrase_mining, "BUFFER_BYTES", 100)
    assert rows_of(phrase_mining.mined(docs, 4)) == expected_phrases(rows, 4, 80, 2000)


def test_phrase_scores_beyond_64_bits(spark):
    big = 8_000_000_000_000
    counts = spark.createDataFrame([("aa", 1, "x", big), ("aa", 1, "y", big + 1), ("aa", 2, "x y", big)], "lang string, size int, phrase string, n long")
    total = spark.createDataFrame([("aa", 3 * big)], "lang string, words long")
    assert rows_of(phrase_mining.best(counts, total)) == [("aa", 1, "x y", big, big, big + 1, 3 * big, 2_000_000 * big // (2 * big + 1))]


def test_phrases_of_awkward_and_no_rows(spark, awkward, nothing):
    want = expected_phrases([(r["doc_id"], r["text"], r["lang"]) for r in awkward.collect()], 3, 80, 2000)
    assert rows_of(phrase_mining.mined(awkward, 3)) == want
    assert phrase_mining.mined(nothing).count() == 0


# --- importance resampling ---------------------------------------------------

def expected_draw(rows, target, longest, buckets, least, percent, seed):
    bucket = lambda own, n, i: zlib.crc32(" ".join(own[i:i + n]).encode()) % buckets
    features = lambda text: [bucket(own, n, i) for own in [words(text)] for n in range(1, longest + 1) for i in range(len(own) - n + 1)]
    made = [(i, len(words(t)), features(t)) for i, t in rows]
    s, t = Counter(), Counter()
    for _, _, f in made:
        s.update(f)
    for text in target:
        t.update(features(text))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    gains = {b: gain(b) for b in s}
    out = []
    for i, n, f in made:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gains[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (3, 97, 35), (2, 5, 100)])
def test_draw_equals_brute_force(spark, longest, buckets, percent):
    rows, docs = mixed_docs(spark, 200)
    target = ["The sea, the SEA", None, "gRün日本 x1 of and é unseen", ""]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = rows_of(importance_sampling.drawn(docs, items, longest, buckets, 20, percent, 7))
    assert got == expected_draw([r[:2] for r in rows], target, longest, buckets, 20, percent, 7)


def test_buckets_do_not_depend_on_the_dictionary():
    texts = ["The sea-é 日本 the\tend" * 3, "", "x" * 70_000 + " sea sea"]
    want = [Counter(zlib.crc32(" ".join(own[i:i + n]).encode()) % 1009 for n in (1, 2, 3, 4) for i in range(len(own) - n + 1)) for own in map(words, texts)]
    for known in ([], ["the", "sea"], ["sea", "é", "日本", "endthe", "x" * 70_000]):
        n_words, doc, bucket = importance_sampling.Scanner(known).features(texts, 4, 1009)
        assert n_words.tolist() == [len(words(t)) for t in texts]
        assert [Counter(bucket[doc == k].tolist()) for k in range(3)] == want


def test_draw_on_awkward_and_no_rows(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert rows_of(importance_sampling.drawn(awkward, nothing)) == expected_draw(rows, [], 1, 10_000, 20, 10, 2024)
    assert importance_sampling.drawn(nothing, awkward).count() == 0


# --- decontamination ---------------------------------------------------------

def expected_contamination(rows, items, window, near_terms, near_words):
    own = [(i, words(t)) for i, t in rows]
    counts = Counter(w for _, ws in own for w in ws)
    tests = [("" if i is None else str(i), words(t)) for i, t in items]
    windows = {(item, tuple(ws[k:k + window])) for item, ws in tests if ws for k in range(max(1, len(ws) - window + 1))}
    near = [(item, sorted(set(ws), key=lambda w: (counts[w], w.encode()))[:near_terms]) for item, ws in tests if len(set(ws)) >= near_terms]
    out = []
    for i, ws in own:
        hit, found = set(), set()
        for item, run in windows:
            for k in range(len(ws) - len(run) + 1):
                if tuple(ws[k:k + len(run)]) == run:
                    hit |= set(range(k, k + len(run)))
                    found.add(item)
        at = defaultdict(list)
        for k, w in enumerate(ws):
            at[w].append(k)
        beside = {item for item, ts in near if any(all(any(abs(p - q) <= near_words for q in at[t]) for t in ts[1:]) for p in at[ts[0]])}
        out.append((i, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), len(beside)))
    return sorted(out, key=str)


def contaminated_docs(n=120):
    rng = random.Random(11)
    common = ["the", "of", "and", "in", "é"]
    word = lambda: rng.choice(common) if rng.random() < 0.6 else "w" + str(rng.randint(0, 400))
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 11, 40])))) for k in range(40)]
    items += [(3, "w1 The, of"), (None, "the of and in the of and in the of and"), (90, None), (91, " .- "), (92, items[5][1]), (5, items[6][1].upper())]
    rows = []
    for k in range(n):
        own = [word() for _ in range(rng.randint(0, 80))]
        if k % 3 == 0:
            own[rng.randint(0, len(own)):0] = rng.choice(items[:40])[1].split()
        rows.append((k, rng.choice([" ", " - "]).join(own)))
    rows += [rows[3], rows[3], (None, rows[6][1]), (n, None), (n + 1, ""), (n + 2, " ".join(["the of and in"] * 20_000))]
    return rows, items


def test_starting_postings_are_taken_in_chunks():
    got = positional_index._chunks(np.arange(5), np.array([10, positional_index.CANDIDATES, 3, positional_index.CANDIDATES, 1]))
    assert np.concatenate(got).tolist() == list(range(5)) and len(got) > 2


@pytest.mark.parametrize("segment, tests", [(2_000_000, 4_000_000), (500, 400)])
def test_contamination_equals_brute_force(spark, monkeypatch, segment, tests):
    monkeypatch.setattr(positional_index, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(positional_index, "TEST_BYTES", tests)
    rows, items = contaminated_docs()
    docs = spark.createDataFrame([(*r, 1, 2, "s") for r in rows], "doc_id long, text string, segment long, ord int, item string")
    got = rows_of(positional_index.contaminated(docs, spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, segment int")))
    want = expected_contamination(rows, items, 10, 4, 20)
    assert got == want and sum(r[5] for r in want) > 30


def test_hits_are_places_in_the_documents(spark, tmp_path):
    rows = [(1, "a b c d e f"), (2, "x a B, c! d y a b c d"), (3, "d c b a")]
    positional_index.build(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(tmp_path / "index"))
    hits = positional_index.search(positional_index.opened(spark, str(tmp_path / "index")), spark.createDataFrame([("t", "b c d")], "item_id string, text string"), 10, 3, 3)
    assert sorted((r["ord"], r["near"], r["start"], r["end"]) for r in hits.collect()) == [(0, False, 1, 4), (0, True, 1, 2), (1, False, 2, 5), (1, False, 7, 10), (1, True, 2, 3), (2, True, 2, 3)]


def test_contamination_on_awkward_and_no_rows(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect() if len(r["text"] or "") < 100_000]
    items = [(1, rows[6][1]), (2, rows[13][1])]
    tests = spark.createDataFrame(items, "item_id int, text string")
    small = awkward.where("coalesce(length(text), 0) < 100000")
    assert rows_of(positional_index.contaminated(small, tests)) == expected_contamination(rows, items, 10, 4, 20)
    assert positional_index.contaminated(nothing, tests).count() == 0
    clean = positional_index.contaminated(awkward, nothing.select("text", "doc_id").withColumnRenamed("doc_id", "item_id")).collect()
    assert len(clean) == awkward.count() and not any(r["contaminated"] or r["n_items"] or r["n_near"] for r in clean)


def test_word_hashes_follow_the_words():
    data, starts, ends, sizes = positional_index._words(["The the THE é", "", None or "", "the-é"])
    h = positional_index.WordHashes()(data, starts, ends)
    assert sizes.tolist() == [4, 0, 0, 2] and len(np.unique(h)) == 2 and h[0] == h[2] == h[4] and h[3] == h[5]
