"""Packing, SimHash, line dedup, neighbours, passages, components and the pipeline against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from riskspark.llm import embedding_neighbours, line_dedup, repeated_passages, sequence_packing, simhash_groups, toxicity
from riskspark.llm.components import components

PATH = public_tokenizers.path
FILES = (PATH("byte_bpe_50k.json"), PATH("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
SF = "/root/testdata/sf0.001"


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == smallest_reachable({x for p in real for x in p}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def expected_pieces(text, model, capacity=2048):
    data = np.array([*model.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()
    n, made = len(data) // 4, []
    first = n if n <= capacity else (n % capacity or capacity)
    at = 0
    while at < n:
        size = first if at == 0 else capacity
        made.append((len(made), at, size, zlib.crc32(data[4 * at:4 * (at + size)])))
        at += size
    return made


def check_packing(rows, want, capacity=2048):
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, awkward, nothing):
    docs = documents(spark).select("doc_id", "text").union(awkward.select("doc_id", "text")).union(spark.createDataFrame([(900, "<|endoftext|> 日本 x  \n y"), (901, "x <|endoftext|> y")], "doc_id long, text string"))
    model = Tokenizer.from_file(FILES[0])
    assert 50256 in model.encode("x <|endoftext|> y", add_special_tokens=False).ids
    want = Counter((i, *p) for i, t in pairs(docs) for p in expected_pieces(t, model))
    rows = sequence_packing.packed(docs, *FILES).collect()
    used = check_packing(rows, want)
    assert used <= 1.03 * sum(r["length"] for r in rows) / 2048 + 1
    assert check_packing(sequence_packing.packed(docs, *FILES, group=40).collect(), want) >= used
    assert sequence_packing.packed(nothing, *FILES).count() == 0


def test_sum_of_squares_follows_its_rule():
    rng = random.Random(2)
    capacity, open_gaps = 12, []
    lengths = [rng.randint(1, 12) for _ in range(200)]
    bins, offsets = sequence_packing.sum_of_squares(lengths, capacity)
    gap_of = {}
    squares = lambda gaps: sum(v * v for g, v in Counter(gaps).items() if g)
    for n, b in zip(lengths, bins):
        open_gaps = [g for g in gap_of.values()]
        options = [squares([*open_gaps, capacity - n])]
        for g in set(open_gaps):
            if g >= n:
                rest = list(open_gaps)
                rest.remove(g)
                options.append(squares([*rest, g - n]))
        gap_of[b] = gap_of.get(b, capacity) - n
        assert squares(gap_of.values()) == min(options)


def expected_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, awkward, nothing):
    docs = documents(spark).select("doc_id", "text").union(awkward.where("doc_id IS NOT NULL").select(F.col("doc_id") + 1000, "text"))
    prints = {i: expected_fingerprint(t) for i, t in pairs(docs) if len(t) < 30_000}
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash_groups.grouped(docs).collect()}
    assert {i: got[i][0] for i in prints} == prints
    every = {i: f for i, (f, _) in got.items()}
    near = [(a, b) for a in every for b in every if a < b and (every[a] ^ every[b]).bit_count() <= 3]
    assert {i: c for i, (_, c) in got.items()} == smallest_reachable(every, near)
    rows = simhash_groups.grouped(awkward).collect()
    assert len(rows) == awkward.count() and all(len(r["fingerprint"]) == 16 for r in rows)
    assert next(r["component_id"] for r in rows if r["doc_id"] == 5) == 4
    assert simhash_groups.grouped(nothing).count() == 0


def test_simhash_tiles_lose_no_link(spark):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 2))) & (2**64 - 1) for c in centres for _ in range(60)})
    rows = [(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(prints)]
    classes = spark.createDataFrame(rows, "id long, fp long")
    near = [(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints) if i < j and (a ^ b).bit_count() <= 3]
    want = smallest_reachable(range(len(prints)), near)
    for tile in (7, 1024):
        links = [(r["a"], r["b"]) for r in simhash_groups.links(classes, tile).collect()]
        assert set(links) <= set(near)
        assert smallest_reachable(range(len(prints)), links) == want


def expected_lines(docs):
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip("\x20\t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in docs:
        for x in t.split("\n"):
            if len(key(x)) >= 20 and i is not None:
                holders[key(x)].add(i)
    made = Counter()
    for i, t in docs:
        lines = t.split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= 3 and i != max(holders[key(x)]))]
        made[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return made


def test_line_dedup(spark, awkward, nothing):
    docs = documents(spark).select("doc_id", "text").union(awkward.select("doc_id", "text"))
    assert Counter(map(tuple, line_dedup.digests(docs).collect())) == expected_lines(pairs(docs))
    assert line_dedup.digests(nothing).count() == 0


def test_line_dedup_with_split_shards_is_the_same(spark, awkward, monkeypatch):
    docs = documents(spark).select("doc_id", "text").union(awkward.select("doc_id", "text"))
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 7)
    monkeypatch.setattr(line_dedup, "SHARD_POSTINGS", 11)
    assert Counter(map(tuple, line_dedup.digests(docs).collect())) == expected_lines(pairs(docs))


def test_filters_let_every_shared_key_pass_and_stop_most_others(spark):
    posted = line_dedup.postings(documents(spark))
    counts = line_dedup.reference_counts(posted)
    shared = counts.where("n_docs >= 3")
    passed = line_dedup.passing(posted, line_dedup.filters(shared, 3), 3)
    want = {(bytes(r["key"]), r["doc_id"]) for r in posted.join(shared, "key", "left_semi").collect()}
    got = {(bytes(r["key"]), r["doc_id"]) for r in passed.collect()}
    assert want and want <= got and len(got - want) <= 0.01 * posted.count()


def test_a_full_filter_is_built_anew(spark):
    keys = [xxhash.xxh3_128_digest(str(i)) for i in range(3000)]
    table = lambda some: spark.createDataFrame([(bytearray(k),) for k in some], "key binary")
    none = table([])
    first = line_dedup.filters(table(keys[:20]), 2)
    grown = line_dedup.updated_filters(first, table(keys[20:]), none, table(keys), 2)
    assert grown.count() == 2
    rows = table(keys).withColumn("doc_id", F.lit(1).cast("long"))
    assert line_dedup.passing(rows, grown, 2).count() == 3000
    back = line_dedup.updated_filters(grown, none, table(keys[20:]), table(keys[:20]), 2)
    assert 20 <= line_dedup.passing(rows, back, 2).count() <= 40


def test_deduplicated_keeps_columns(awkward):
    out = line_dedup.deduplicated(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    row = next(r for r in out.collect() if r["doc_id"] == 9)
    assert "STAND IN MANY" not in row["text"] and row["n_chars"] == len(row["text"])


def test_reversible_index(spark):
    line = lambda k: f"a line that is long enough, number {k}"
    first = spark.createDataFrame([(1, line(1)), (2, line(1)), (3, line(1) + "\n" + line(2)), (4, line(2))], "doc_id long, text string")
    more = spark.createDataFrame([(5, line(2))], "doc_id long, text string")
    posted = line_dedup.postings(first)
    before = line_dedup.reference_counts(posted)
    grown = line_dedup.inserted(posted, more)
    after = line_dedup.reference_counts(grown)
    shared = before.where("n_docs >= 3")
    filters = line_dedup.filters(shared, 2)
    coming, going = line_dedup.crossings(before, after)
    assert (coming.count(), going.count()) == (1, 0)
    wider = line_dedup.updated_filters(filters, coming, going, after.where("n_docs >= 3"), 2)

    def holds(table, text):
        row = spark.createDataFrame([(bytearray(line_dedup.line_key(text)), 1)], "key binary, doc_id long")
        return line_dedup.passing(row, table, 2).count() == 1
    assert holds(wider, line(1)) and holds(wider, line(2)) and not holds(filters, line(2))
    back = line_dedup.reference_counts(line_dedup.deleted(grown, more))
    coming, going = line_dedup.crossings(after, back)
    narrow = line_dedup.updated_filters(wider, coming, going, back.where("n_docs >= 3"), 2)
    assert holds(narrow, line(1)) and not holds(narrow, line(2))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, before.collect()))


def test_cuckoo_filter():
    keys = [xxhash.xxh3_128_digest(str(i)) for i in range(5000)]
    f = line_dedup.Cuckoo.of(keys)
    assert f.contains(keys).all()
    assert f.contains([xxhash.xxh3_128_digest("no" + str(i)) for i in range(5000)]).mean() < 0.01
    assert all(f.delete(k) for k in keys[:2500]) and f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01


def vectors(seed=1, n=1500, dims=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims))
    for k in range(0, n, 3):  # near copies
        base[k] = base[k // 30] + rng.normal(size=dims) * 0.15
    rows = [(i, [float(v) for v in x], int(i % 3)) for i, x in enumerate(base)]
    rows += [(n, rows[0][1], 0), (n + 1, [2 * v for v in rows[0][1]], 0), (n + 2, rows[0][1], None), (n + 3, None, 1), (n + 4, [0.0] * dims, 1), (n + 5, [float("nan")] * dims, 1),
             (n + 6, [None] * dims, 1), (n + 7, [float("inf")] * dims, 1), (n + 8, [], 1), (n + 9, rows[0][1], 1)]
    return rows


def check_links(rows, got, recall):
    good = [(i, np.array(v, float), c) for i, v, c in rows if v and c is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    unit = np.array([v / np.linalg.norm(v) for _, v, _ in good])
    label = np.array([c for *_, c in good])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    want = dict(zip([i for i, *_ in good], near.sum(1)))
    assert sorted(got) == sorted(i for i, *_ in rows)
    for i, (links, component, kept) in got.items():
        assert links <= want.get(i, 0) and kept == (component == i)
    assert sum(v[0] for v in got.values()) >= recall * sum(want.values())
    ids = [i for i, *_ in good]
    full = smallest_reachable([i for i, *_ in rows], [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b])
    assert np.mean([got[i][1] == full[i] for i in got]) >= recall
    assert all(full[c] == full[i] for i, (_, c, _) in got.items())


def test_neighbours(spark, monkeypatch):
    rows = vectors()
    for tile in (1024, 40):
        monkeypatch.setattr(embedding_neighbours, "RESIDENTS", tile)
        monkeypatch.setattr(embedding_neighbours, "VISITORS", 2 * tile)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("x"))
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_neighbours.linked(df).collect()}
        check_links(rows, got, 0.95)


@pytest.mark.parametrize("centres", [1_024, 24])
def test_recall_with_hundreds_of_lists_and_correlated_components(spark, monkeypatch, centres):
    monkeypatch.setattr(embedding_neighbours, "LIST_ROWS", 15)  # 400 lists, of one level or of two
    monkeypatch.setattr(embedding_neighbours, "LEVEL_CENTRES", centres)
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(32, 32)) * np.linspace(2, 0.2, 32)[:, None]
    base = rng.normal(size=(6_000, 32)) @ mix
    scale = np.linalg.norm(base, axis=1).mean() / np.sqrt(32)
    for k in range(0, 6_000, 3):
        base[k] = base[k // 30 * 30 + 1] + rng.normal(size=32) * scale * rng.uniform(0.05, 0.4)
    rows = [(i, [float(v) for v in x], 0) for i, x in enumerate(base)]
    model = embedding_neighbours.fit(base / np.linalg.norm(base, axis=1, keepdims=True), 6_000)
    assert np.prod([len(level) for level in model["levels"]]) >= 400 and len(model["levels"]) == (1 if centres > 400 else 2)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"])
           for r in embedding_neighbours.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    check_links(rows, got, 0.95)


def test_vectors_of_every_length_are_compared(spark):
    rows = vectors(n=300)
    extra = vectors(seed=2, n=90, dims=6)[:90] + vectors(seed=3, n=90, dims=40)[:90] + [(0, [3.0], 0), (0, [4.0], 0), (0, [-1.0], 0)]
    rows += [(1000 + i, v, c) for i, (_, v, c) in enumerate(extra)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"])
           for r in embedding_neighbours.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    for size in (1, 6, 16, 40):
        some = [r for r in rows if r[1] and len(r[1]) == size]
        check_links(some, {i: got[i] for i, *_ in some}, 0.95)
    assert got[1180][0] == got[1181][0] == 1 and got[1182][0] == 0
    assert got[1000][0] + got[1090][0] > 0


def test_neighbours_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    check_links(rows, {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_neighbours.linked(df).collect()}, 0.9)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_neighbours.linked(none).count() == 0


def shared_positions(docs):
    """Words inside 50-word windows that another document holds as well."""
    held = defaultdict(set)
    words = {i: t.encode().split() for i, t in docs}
    for i, w in words.items():
        for k in range(len(w) - 49):
            held[tuple(w[k:k + 50])].add(i)
    return {i: {k + j for k in range(len(w) - 49) if len(held[tuple(w[k:k + 50])]) > 1 for j in range(50)} for i, w in words.items()}


def test_passages(spark, awkward, nothing, monkeypatch):
    docs = documents(spark).select("doc_id", "text").union(awkward.where("doc_id IN (6, 7, 13)").dropDuplicates(["doc_id"]).select(F.col("doc_id") + 5000, "text"))
    small = docs.where("length(text) < 40000")
    want = shared_positions(pairs(small))
    for rows in (60_000, 50):
        monkeypatch.setattr(repeated_passages, "PARTITION_ROWS", rows)
        got = defaultdict(set)
        found = repeated_passages.spans(small).collect()
        for r in found:
            assert r["n_words"] == r["end_word"] - r["start_word"] >= 50 and r["doc_id"] not in r["others"] and r["others"]
            got[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
        total, hit = sum(map(len, want.values())), sum(len(got[i] & w) for i, w in want.items())
        assert hit >= 0.99 * total
        assert all(got[i] <= want[i] for i in got)
    planted = {r["doc_id"]: (r["start_word"], r["end_word"]) for r in found if r["doc_id"] >= 5000}
    assert planted == {5006: (20, 90), 5007: (11, 81)}
    assert repeated_passages.spans(nothing).count() == 0
    assert repeated_passages.spans(awkward).where("doc_id IS NULL").count() == 0


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    docs = documents(spark)
    columns = docs.columns
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.scored(docs, model).where("score >= 0.5").collect()}
    stage = {}
    at = docs
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, at, SF)
        if name != "best_fit_packing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        stage[name] = at = spark.read.parquet(str(tmp_path / name))
    assert {r["doc_id"] for r in stage["toxicity"].collect()} == {r["doc_id"] for r in docs.collect()} - toxic
    left = Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in pairs(stage["line_dedup"]))
    assert left == Counter({(i, h): n for (i, _, _, h), n in expected_lines(pairs(stage["toxicity"])).items()})
    prints = {i: expected_fingerprint(t) for i, t in pairs(stage["line_dedup"])}
    roots = smallest_reachable(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    assert {i for i, _ in pairs(stage["simhash_near_dedup"])} == {i for i in roots if roots[i] == i}
    assert stage["secret_scan"].count() == stage["simhash_near_dedup"].count()
    assert not any(re.search(r"token = \"[0-9a-f]{24,}", t) for _, t in pairs(stage["secret_scan"]))
    pattern = Tokenizer.from_file(FILES[0])
    check_packing(stage["best_fit_packing"].collect(), Counter((i, *p) for i, t in pairs(stage["secret_scan"]) for p in expected_pieces(t, pattern)))
    assert sorted(map(tuple, stage["best_fit_packing"].drop("sequence_id", "offset").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect()))


def test_pipeline_on_awkward_rows(spark, awkward, nothing, tmp_path):
    for name, at in (("a", awkward), ("b", nothing)):
        for k, (_, function) in enumerate(corpus_pipeline.STAGES):
            function(spark, at, SF).write.parquet(str(tmp_path / f"{name}{k}"))
            at = spark.read.parquet(str(tmp_path / f"{name}{k}"))
