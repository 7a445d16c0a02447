"""Secrets, pieces, quality, licences, toxicity: each against a brute-force version or held-out rows, and awkward inputs."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from pyspark.sql import functions as F
from riskspark.llm import license_index, quality_trees, secret_scan, sentence_pieces, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def by_id(df):
    return sorted(df.collect(), key=repr)


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def expected_spans(text):
    found = []
    for k, (name, pattern, group, least) in enumerate((
            ("assign", re.compile(r"((?a:(?i:password|passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
            ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24))):
        found += [(m.start(), k, name, m.end()) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return [f"{n}:{s}:{e}" for s, _, n, e in sorted(found)]


@pytest.fixture(scope="module")
def net():
    return secret_scan.train([], [])


def test_secret_patterns_equal_brute_force(spark, awkward, net):
    docs = awkward.select("doc_id", "text").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    want = sorted((i, hashlib.sha256(",".join(expected_spans(t)).encode()).hexdigest()) for i, t in texts(docs) if i is not None)
    got = secret_scan.digests(docs, net).collect()
    assert sorted((r["doc_id"], r["base_sha256"]) for r in got if r["doc_id"] is not None) == want
    for r in got:  # base spans stay among all spans
        assert len([s for s in r["spans"].split(",") if s and not s.startswith("learned")]) == r["n_assign"] + r["n_access"] + r["n_hex"]


def test_failing_match_still_consumes():
    assert secret_scan.pattern_spans("secret=token: abcdefg") == []
    assert secret_scan.pattern_spans("TOKEN='abcdef'") == [(0, 0, 13)]


def test_network_adds_generated_keys_and_leaves_prose(net):
    run = secret_scan._scanner(net, None)()
    keys = run(["use 7F3A99C0B1D2E4F50617A8B9 now", "id Zk3vQ9xL2mB7nR5tW8yC1dF4gH6j end"])
    assert keys["n_learned"] == [1, 1]
    assert sum(run([" ".join(["thanedblethainging", "Anedouerhationti", "4041894974608795", "some_long_snake_name"])])["n_learned"]) <= 1


def test_secrets_are_masked(awkward, net):
    for r in secret_scan.redacted(awkward, net, keep=awkward.columns).collect():
        assert expected_spans(r["clean"]) == []
        assert r["key"] in ("k", None)


def test_secret_fit_on_awkward_rows(awkward, nothing):
    assert secret_scan.digests(awkward).count() == awkward.count()
    assert secret_scan.digests(nothing).count() == 0


def test_every_run_is_a_candidate_and_a_longer_one_stands_beside_its_pattern_span(net):
    text = "thanedblethaining ABCDEFGHIJKLMNOPQRST " + "Zk3vQ9xL" + "0123456789abcdef01234567" + "mB7nR5tW8yC1"
    spans = secret_scan.pattern_spans(text)
    runs = secret_scan.candidates(text, spans)
    assert [text[s:e] for s, e in runs] == [m for m in text.split()] and len(spans) == 1
    assert [text[s:e] for s, e in secret_scan.apart(runs, spans)] == text.split()[:2]
    hexed = "key 0123456789abcdef01234567 end"
    assert secret_scan.candidates(hexed, secret_scan.pattern_spans(hexed)) == []  # the pattern's span holds all of it
    got = secret_scan._scanner(net, None)()([text])["spans"][0].split(",")
    start = text.index("Zk3v")
    assert f"learned:{start}:{len(text)}" in got and f"hex:{start + 8}:{start + 32}" in got


def test_recall_of_kept_out_findings(spark):
    found = secret_scan.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))["reached"]
    assert (found[0] >= secret_scan.RECALL or np.isnan(found[0])) and found[1] >= secret_scan.RECALL and found[2] <= 0.02


def test_every_document_is_learned_from(spark, monkeypatch):
    """More documents than any sample would hold, dealt over several shards: the findings of all are seen, and a second fit is the same."""
    monkeypatch.setattr(secret_scan, "SHARD_WINDOWS", 1_000)
    monkeypatch.setattr(secret_scan, "MADE_UP", 200)
    text = F.concat(F.lit("use token = "), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 20), F.lit(" or thanedblethaining"), F.col("id"))
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    seen = []
    monkeypatch.setattr(secret_scan, "stored", lambda df: seen.append(df.cache()) or seen[-1])
    net = secret_scan.fit(docs)
    assert seen[0].where("found = 1").count() == 2_000 and seen[0].where("found = 0").count() == 2_000
    assert net["reached"][0] >= secret_scan.RECALL and net["reached"][1] >= secret_scan.RECALL
    again = secret_scan.fit(docs)
    assert all(np.array_equal(net[k], again[k]) for k in net)


def test_long_candidate_is_covered_by_windows():
    text = "a" * 500
    shown = secret_scan.windows(text, 0, 500)
    assert len(shown) >= 500 // secret_scan.STEP and all(len(w) == secret_scan.WIDTH for w in shown)


def test_pieces_equal_library(spark, awkward):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    odd = ["  a", "a  ", " a  b\n c\t", "▁x ▁", "<s> <0x0A>", "日本語 😀 a", "a\u0000b", "　x y"]
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    want = Counter()
    for i, t in texts(docs):
        ids = library.encode(t)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    got = sentence_pieces.digests(docs, MODEL).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want


def expected_span_digest(library, text):
    """Byte by byte: a space stands for its three mark bytes, every other byte for itself, the first mark for nothing."""
    source = [0] * 3 if text else []
    data = text.encode()
    for at, b in enumerate(data):
        source += [at] * 3 if b == 32 else [at]
    source.append(len(data))
    starts, ends, at = [], [], 0
    for i in library.encode(text):
        piece = library.id_to_piece(i)
        size = 1 if library.is_byte(i) else len(piece.encode())
        starts.append(source[at])
        ends.append(source[at + size])
        at += size
    assert at + 1 == len(source)
    return hashlib.sha256(np.array(starts + ends, "<i8").tobytes()).hexdigest()


def test_span_digests_equal_byte_by_byte_alignment(spark, awkward, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    odd = ["  a", "a  ", " a  b\n c\t", "▁x ▁", "日本語 😀 a", "a\u0000b", "　x y"]
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    want = Counter((i, expected_span_digest(library, t), len(t.encode())) for i, t in texts(docs))
    assert Counter((r["doc_id"], r["spans_sha256"], r["span_bytes"]) for r in sentence_pieces.digests(docs, MODEL).collect()) == want
    assert sentence_pieces.digests(nothing, MODEL).count() == sentence_pieces.encode(nothing, MODEL).count() == 0


def test_spans_tile_the_text(awkward):
    docs = awkward.where("length(text) < 20000")
    shown = {(r["doc_id"], r["text"]) for r in docs.collect()}
    for r in sentence_pieces.encode(docs, MODEL).collect():
        size = max(len((t or "").encode()) for i, t in shown if i == r["doc_id"]) if r["doc_id"] is not None else None
        edges = [0, *r["ends"]]
        assert edges[:-1] == r["starts"]
        assert size is None or edges[-1] == size


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc"])
def test_longest_prefix_normalisation_equals_library(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = {k: v for field, value in sentence_pieces.message_fields(library.serialized_model_proto()) if field == 3 for k, v in sentence_pieces.message_fields(value)}
    own = sentence_pieces.Pieces.__new__(sentence_pieces.Pieces)
    own.map, own.prefix, own.squeeze, own.escape = sentence_pieces.CharacterMap(spec[2]), 1, 1, 1
    for text in ["Ａｂｃ ﬁ  ①　x ", "  é é ｶﾞ \t\n a", "½ ™ 한글 ㎏", "plain", "", "ﷺ a"]:
        out, align = own.normalise(text)
        assert out.decode() == library.normalize(text)
        assert len(align) == len(out) + 1 and align.tolist() == sorted(align) and align[-1] <= len(text.encode())


def expected_quality(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics_equal_brute_force(spark, awkward, labels, nothing):
    docs = awkward.select("doc_id", "text").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    model = quality_trees.fit(docs, labels)
    got = quality_trees.judge(docs, model).collect()
    assert Counter((r["doc_id"], *r[1:6]) for r in got) == Counter((i, *expected_quality(t)) for i, t in texts(docs))
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_trees.judge(nothing, quality_trees.fit(nothing, labels)).count() == 0


def test_trees_learn_and_stay_monotonic():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality_trees.FEATURES)))
    y = ((x[:, 2] + 0.1 * rng.normal(size=3000) < 0.5) & (x[:, 1] > 0.2)).astype(float)
    trees = quality_trees.grow(x[:2000], y[:2000])
    assert ((quality_trees.score(trees, x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9
    for j, sign in enumerate(quality_trees.FEATURES.values()):
        if sign:
            line = np.repeat(x[:50], 20, 0)
            line[:, j] = np.tile(np.linspace(0, 1, 20), 50)
            steps = np.diff(quality_trees.score(trees, line).reshape(50, 20), axis=1) * sign
            assert steps.min() >= -1e-12


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    trees = quality_trees.fit(docs, labels.where("doc_id % 5 <> 0"))
    rows = quality_trees.judge(docs, trees).join(labels.where("doc_id % 5 = 0"), "doc_id").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in rows]) > 0.85


def test_licences(awkward, nothing):
    rows = {r["doc_id"]: r for r in license_index.summary(awkward).collect() if r["doc_id"] is not None}
    assert (rows[12]["n_words"], rows[12]["n_base"], rows[12]["first_word"], rows[12]["last_word"]) == (8, 3, 0, 5)
    assert rows[12]["base_labels"] == "cc-by,gpl,reserved" and rows[12]["score"] == 1.0
    assert (rows[0]["n_words"], rows[0]["n_base"], rows[0]["first_word"], rows[0]["labels"], rows[0]["score"]) == (0, 0, None, "", 0.0)
    assert license_index.summary(awkward).count() == awkward.count()
    assert license_index.summary(nothing).count() == 0


def test_licence_plan_is_native(awkward):
    plan = license_index.summary(awkward)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_licence_repeats_and_methods(spark):
    docs = spark.createDataFrame([(1, "cc by cc by cc by"), (2, "Released under the MIT License."), (3, "the mit; released license under"), (4, "Licensed under CC BY-NC 4.0. all rights reserved")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in license_index.summary(docs).collect()}
    assert (rows[1]["n_base"], rows[1]["first_word"], rows[1]["last_word"]) == (3, 0, 4)
    assert rows[2]["labels"] == "mit" and rows[2]["base_labels"] == "" and rows[2]["score"] == 1.0
    assert rows[3]["labels"] == ""
    assert rows[4]["labels"] == "cc-by,cc-by-nc,reserved"


def test_licence_postings_must_agree(spark):
    """A key phrase alone is no notice where the template's rarest words do not stand around it."""
    shown = ["licensed under the apache license version 2 0", "apache license version 2 alone", "gnu affero general public license",
             "some affero general public license", "x general public license y", "released into the public domain", "never into the public domain"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(shown * 3)] + [(99, " ".join(shown) + " 0 0 under the")], "doc_id long, text string")
    idf = license_index.inverse_frequencies(docs)
    for r in license_index.places(docs, idf, keep=("doc_id", "text")).collect():
        w = re.findall(r"[0-9a-z]+", r["text"])
        stands = lambda at, j, word: 0 <= at + j < len(w) and w[at + j] == word
        want = set()
        for label, phrase, key, size, _ in license_index.TEMPLATES:
            parts = phrase.split()
            rare = sorted(range(len(parts)), key=lambda j: (-idf[parts[j]], j))[:license_index.POSTINGS]
            for at in range(-len(parts), len(w)):
                if all(stands(at, j, parts[j]) for j in range(key, key + size)) and sum(stands(at, j, parts[j]) for j in rare) >= min(license_index.AGREE, len(rare)):
                    want.add((at + key, label))
        got = [(p["start"], p["label"]) for p in r["places"]]
        assert set(got) == want and len(got) == len(want)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.scored(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    y, p = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    assert ((p >= 0) & (p <= 1)).all()
    assert np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]) > 0.6
    assert np.mean((p >= 0.5) == y) > 0.88


def test_held_out_is_the_stated_fifth(spark):
    rows = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_toxicity_awkward(awkward, nothing, labels):
    model = toxicity.fit(awkward, labels)
    assert toxicity.scored(awkward, model).count() == awkward.count()
    assert toxicity.scored(nothing, toxicity.fit(nothing, labels)).count() == 0


def test_windows_cover_every_word():
    counts = np.array([0, 1, 64, 65, 300])
    place, there, owner = toxicity.windows_of(counts)
    begin = np.cumsum(counts) - counts
    for k, n in enumerate(counts):
        assert set(place[owner == k][there[owner == k]]) == set(range(begin[k], begin[k] + n))


def test_network_gradient():
    rng = np.random.default_rng(0)
    h = toxicity.HIDDEN
    net = {"left": rng.normal(size=(h, 3 * h)), "right": rng.normal(size=(h, 3 * h)), "look": rng.normal(size=(2 * h, h)), "ask": rng.normal(size=h), "out": rng.normal(size=2 * h), "out_bias": np.zeros(1)}
    gates, there = rng.normal(size=(3, 5, 6 * h)), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    d = rng.normal(size=3)
    z, kept = toxicity.forward(net, gates, there, True)
    grads, dg = toxicity.backward(net, kept, d)
    for name in ("left", "right", "look", "ask", "out"):
        at = tuple(0 for _ in net[name].shape)
        old = net[name][at]
        net[name][at] = old + 1e-5
        up = (toxicity.forward(net, gates, there)[0] * d).sum()
        net[name][at] = old - 1e-5
        down = (toxicity.forward(net, gates, there)[0] * d).sum()
        net[name][at] = old
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-4
    gates[1, 1, 3] += 1e-5
    assert abs((toxicity.forward(net, gates, there)[0] * d).sum() - (z * d).sum() - 1e-5 * dg[1, 1, 3]) < 1e-8
