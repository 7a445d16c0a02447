"""Secrets in whole texts: fixed patterns, and a character convolutional network over every candidate.

A candidate is a run of key characters, or a span that a pattern found, with the characters around it. The
network (character embedding, one convolution, pooling, one output) is trained in numpy on labelled findings:
the different candidates of all documents, labelled by the patterns, in their own and in swapped contexts,
with written-out decoys and generated keys. They are dealt over shards that Spark's tasks train on, and after each round
the shards' weights are averaged. It is calibrated on all candidates kept out of training, and accepts at the highest
threshold (to a step of 1 / GRID of the logit) that still finds `RECALL` of the kept-out findings and of the kept-out
generated keys. A key is kept out with all its contexts. Pattern spans always stay; a run that reaches beyond a pattern's span is scored whole
and, where accepted, is a span of its own beside it.

Positions are code points, end exclusive. Null and empty texts have no spans. Repeated rows give repeated rows.
Without a single pattern finding in the documents the generated keys alone are the positives.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.blocks import explode_texts, map_texts
from riskspark.llm.learn import Adam, calibrate, sigmoid
from riskspark.scratch import stored

# Fixed patterns: kind, expression, group that is measured, least length. Longer or equal matches count.
KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),  # a run of fewer can't pass, so it need not be matched
)
LEARNED = "learned"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SHARD_WINDOWS = 4_096  # windows that one task trains on, about
ROUNDS, EPOCHS = 4, 3  # weights are averaged after each round; a round takes so many passes
RECALL = 0.97
MADE_UP = 2_000  # generated keys of a shard, and as many decoys
GRID, FARTHEST = 64, 60  # kept-out logits are counted in steps of 1 / GRID, up to the farthest
BEFORE, INSIDE, AFTER, STEP = 16, 40, 8, 32
WIDTH = BEFORE + INSIDE + AFTER
SIGNS, CHANNELS, FILTERS, SPAN = 97, 6, 16, 5


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches that are long enough."""
    found = []
    for k, (_, pattern, group, least) in enumerate(KINDS):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Every run of key characters that no single pattern span holds."""
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    return [(s, e) for s, e in runs if not any(b <= s and e <= f for b, _, f in spans)] if spans else runs


def apart(runs: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The runs that no pattern span touches: only these are examples of no finding."""
    return [(s, e) for s, e in runs if not any(b < e and s < f for b, _, f in spans)]


def windows(text: str, start: int, end: int) -> list[str]:
    """Overlapping windows over the whole candidate, with what stands around it; \\x01 fills up, \\x02 and \\x03 enclose it."""
    made = []
    for at in range(start, max(start + 1, end - (INSIDE - STEP)), STEP):
        stop = min(end, at + INSIDE - 2)
        before = text[max(0, at - BEFORE):at].rjust(BEFORE, "\x01")
        after = text[stop:stop + AFTER].ljust(AFTER, "\x01")
        made.append(before + ("\x02" + text[at:stop] + "\x03").ljust(INSIDE, "\x01") + after)
    return made


def encode(shown: list[str]) -> np.ndarray:
    """Windows as sign numbers: printable ASCII each its own, marks 0 to 2, all else one sign."""
    codes = np.frombuffer("".join(shown).encode("utf-32-le"), "<u4").reshape(len(shown), WIDTH).astype(np.int64)
    return np.where(codes < 4, codes, np.where((codes >= 32) & (codes < 124), codes - 28, SIGNS - 1))


def scores(net: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits of encoded windows and what the gradient needs."""
    e = net["signs"][x]
    cols = np.lib.stride_tricks.sliding_window_view(e, SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - SPAN + 1, SPAN * CHANNELS)
    h = cols @ net["filters"] + net["shift"]
    a = np.maximum(h, 0)
    top = a.argmax(1)
    pooled = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(1)], 1)
    return pooled @ net["out"] + net["bias"][0], (cols, h, top, pooled)


def gradient(net, x, kept, d) -> dict[str, np.ndarray]:
    cols, h, top, pooled = kept
    n, places, _ = h.shape
    dp = d[:, None] * net["out"][None]
    da = np.repeat(dp[:, None, FILTERS:] / places, places, 1)
    np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + dp[:, None, :FILTERS], 1)
    dh = da * (h > 0)
    dcols = (dh @ net["filters"].T).reshape(n, places, SPAN, CHANNELS)
    de = np.zeros((n, WIDTH, CHANNELS))
    for k in range(SPAN):
        de[:, k:k + places] += dcols[:, :, k]
    dsigns = np.zeros_like(net["signs"])
    np.add.at(dsigns, x.ravel(), de.reshape(-1, CHANNELS))
    return {"out": pooled.T @ d, "bias": np.array([d.sum()]), "filters": np.tensordot(cols, dh, ((0, 1), (0, 1))), "shift": dh.sum((0, 1)), "signs": dsigns}


def _made_up(count: int, rng: random.Random, contexts: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """Windows of generated keys and of decoys (joined syllables, names, numbers, paths) in given contexts."""
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]
    syllables = "an er th on in re ed nd st ha ing tion ou ea he es or ti at en ly".split()
    keys, decoys = [], []
    while len(keys) < count:
        before, after = rng.choice(contexts)
        letters = rng.choice(alphabets)
        key = "".join(rng.choice(letters) for _ in range(rng.randint(20, 44)))
        keys.append(windows(before + key + after, len(before), len(before) + len(key))[0])
        spoken = lambda: rng.choice(syllables) if rng.random() < 0.5 else rng.choice("bcdfghjklmnprstvz") + rng.choice("aeiou") + rng.choice(["", "n", "r", "s", "t"])
        word = "".join(spoken() for _ in range(rng.randint(5, 9)))
        decoy = rng.choice([word, word.upper(), word.upper(), word.title(), word.title(), rng.choice(["4", "5", "3"]) + "".join(rng.choice("0123456789") for _ in range(15)), "_".join(rng.sample(syllables, 6)), "-".join(rng.sample(syllables, 7)), "".join(rng.choice("0123456789") for _ in range(rng.randint(16, 19))),
                            "/".join(rng.sample(syllables, 6)), word + str(rng.randint(1, 9999)), "=" * rng.randint(16, 40), "-" * rng.randint(16, 40)])
        decoys.append(windows(before + decoy + after, len(before), len(before) + len(decoy))[0])
    return keys, decoys


def _examples(findings: list[str], others: list[str], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Encoded windows of a shard with those made for it, their labels, kinds, and whether they are kept out."""
    rng = random.Random(seed)
    contexts = [(w[:BEFORE].lstrip("\x01"), w[-AFTER:].rstrip("\x01")) for w in others] or [("", "")]
    contexts += [("x = ", "\n"), ('key: "', '"'), (" ", " "), ("", "")]
    swapped = [b.rjust(BEFORE, "\x01") + w[BEFORE:-AFTER] + a.ljust(AFTER, "\x01") for w in findings for b, a in [rng.choice(contexts)]]
    keys, decoys = _made_up(MADE_UP, rng, contexts)
    shown = [*findings, *swapped, *keys, *others, *decoys]
    y = np.array([1.0] * (2 * len(findings) + len(keys)) + [0.0] * (len(others) + len(decoys)))
    kind = np.array(["finding"] * (2 * len(findings)) + ["key"] * len(keys) + ["other"] * (len(others) + len(decoys)))
    held = np.array([zlib.crc32(w[BEFORE:-AFTER].encode("utf-8", "surrogatepass")) % 4 == 0 for w in shown])  # by the run, whatever stands around it
    return encode(shown), y, kind, held


def _start(seed: int) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    return {"signs": draw.normal(0, 0.5, (SIGNS, CHANNELS)), "filters": draw.normal(0, 0.3, (SPAN * CHANNELS, FILTERS)), "shift": np.zeros(FILTERS),
            "out": draw.normal(0, 0.3, 2 * FILTERS), "bias": np.zeros(1)}


def _flat(steps: Adam) -> np.ndarray:
    """Weights, Adam's two means and his step count, end to end."""
    return np.concatenate([part[k].ravel() for part in (steps.weights, steps.mean, steps.square) for k in steps.weights] + [[steps.step]])


def _adam(state: np.ndarray) -> Adam:
    """The same, back from one array."""
    steps, at = Adam(_start(0)), 0
    for part in (steps.weights, steps.mean, steps.square):
        for k, v in part.items():
            part[k] = state[at:at + v.size].reshape(v.shape).copy()
            at += v.size
    steps.step = state[at]
    return steps


def _round(state: np.ndarray, x: np.ndarray, y: np.ndarray, seed) -> np.ndarray:
    """The state after EPOCHS passes over the examples."""
    steps, draw = _adam(state), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for rows in np.array_split(draw.permutation(len(y)), max(1, len(y) // 64)):
            z, kept = scores(steps.weights, x[rows])
            steps.update(gradient(steps.weights, x[rows], kept, (sigmoid(z) - y[rows]) / len(rows)))
    return _flat(steps)


def _weights(state: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v.astype(np.float32) for k, v in _adam(state).weights.items()}


def _levels(net: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Logits as whole steps of 1 / GRID, rounded down."""
    z = np.concatenate([scores(net, x[k:k + 512])[0] for k in range(0, len(x), 512)] or [np.zeros(0)])
    return np.floor(np.clip(z, -FARTHEST, FARTHEST) * GRID).astype(np.int64)


def _settled(net: dict[str, np.ndarray], kind: np.ndarray, level: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """The network with slope, offset and threshold from counts of the kept-out windows by kind and level.

    `reached` has the recall of kept-out findings, that of kept-out generated keys (NaN where there are none) and the share of
    kept-out other windows that are accepted.
    """
    order = np.argsort(level, kind="stable")
    kind, level, n = kind[order], level[order], n[order]
    slope, offset = calibrate(level / GRID, (kind != "other").astype(float), counts=n)
    p = sigmoid(slope * (level / GRID) + offset)
    least = []
    for k in ("finding", "key"):
        below = np.cumsum(n[kind == k])
        if len(below):
            least.append(p[kind == k][np.searchsorted(below, np.floor((1 - RECALL) * below[-1]), "right")])
    least = min(least)
    of = [kind == k for k in ("finding", "key", "other")]
    reached = [float((n[o] * (p[o] >= least)).sum() / n[o].sum()) if o.any() else np.nan for o in of]
    return net | {"calibration": np.array([slope, offset, least]), "reached": np.array(reached)}


def train(findings: list[str], others: list[str], seed: int = 7) -> dict[str, np.ndarray]:
    """The network from one shard's windows of findings and of other candidates; holds its own slope, offset and threshold."""
    x, y, kind, held = _examples(findings, others, seed)
    state = _flat(Adam(_start(seed)))
    for turn in range(ROUNDS):
        state = _round(state, x[~held], y[~held], (seed, 0, turn))
    net = _weights(state)
    return _settled(net, kind[held], _levels(net, x[held]), np.ones(int(held.sum())))


def labelled(docs: DataFrame) -> DataFrame:
    """(shown, found): the different windows of all findings, and of the candidates that no finding touches."""
    def setup():
        def run(texts, _):
            out = {"shown": [], "found": []}
            for text in texts:
                spans = pattern_spans(text)
                for s, _, e in spans:
                    own = windows(text, s, e)
                    out["shown"] += own
                    out["found"] += [1] * len(own)
                for s, e in apart(candidates(text, spans), spans):
                    own = windows(text, s, e)
                    out["shown"] += own
                    out["found"] += [0] * len(own)
            return out
        return run

    return explode_texts(docs, setup, "shown string, found int", keep=()).distinct()


def fit(docs: DataFrame, seed: int = 7) -> dict[str, np.ndarray]:
    """Train on the candidates of all documents: shards of about SHARD_WINDOWS windows, weights averaged after each round.

    The driver gets the averaged weights and the counts of kept-out windows by level, however many windows there are.
    """
    spark = docs.sparkSession
    found = stored(labelled(docs))
    shards = max(1, -(-found.count() // SHARD_WINDOWS))
    none = spark.range(shards).select(F.lit(None).cast("string").alias("shown"), F.lit(None).cast("int").alias("found"), F.col("id").alias("shard"))
    rows = found.withColumn("shard", F.pmod(F.xxhash64("shown", "found"), F.lit(shards))).unionByName(none)  # no shard is empty
    rows = rows.repartition(shards, "shard")  # few but costly rows; a count that is named is not packed into one task

    def examples(own: pd.DataFrame):
        own = own.sort_values(["found", "shown"])
        shard = int(own["shard"].iloc[0])
        return shard, *_examples(own["shown"][own["found"] == 1].tolist(), own["shown"][own["found"] == 0].tolist(), seed + shard)

    state = _flat(Adam(_start(seed)))
    for turn in range(ROUNDS):
        def step(own: pd.DataFrame) -> pd.DataFrame:  # goes to the tasks before state and turn move on
            shard, x, y, _, held = examples(own)
            return pd.DataFrame({"shard": [shard], "n": [float((~held).sum())], "state": [_round(state, x[~held], y[~held], (seed, shard, turn))]})

        made = rows.groupBy("shard").applyInPandas(step, "shard long, n double, state array<double>")
        parts = made.select("shard", "n", F.posexplode("state").alias("at", "value")).groupBy("at").agg(
            F.array_sort(F.collect_list(F.struct("shard", "n", "value"))).alias("parts"))  # summed in order, so that a run repeats itself
        total = lambda part: F.aggregate("parts", F.lit(0.0), lambda sum_, p: sum_ + part(p))
        mean = total(lambda p: p["n"] * p["value"]) / total(lambda p: p["n"])
        averaged = sorted(parts.select("at", mean.alias("value")).collect())  # one number a weight
        state = np.array([r["value"] for r in averaged])
    net = _weights(state)

    def kept_out(own: pd.DataFrame) -> pd.DataFrame:
        _, x, _, kind, held = examples(own)
        counted = pd.DataFrame({"kind": kind[held], "level": _levels(net, x[held])})
        return counted.groupby(["kind", "level"]).size().reset_index(name="n")

    counts = (rows.groupBy("shard").applyInPandas(kept_out, "kind string, level long, n long")
              .groupBy("kind", "level").agg(F.sum("n").alias("n")).collect())  # at most three kinds at 2 * FARTHEST * GRID levels
    return _settled(net, *(np.array([r[k] for r in counts]) for k in ("kind", "level", "n")))


def scan(docs: DataFrame, net: dict[str, np.ndarray] | None = None, keep=("doc_id",)) -> DataFrame:
    """The kept columns and spans array<struct<kind, start, end>>, by start, then kind as listed, learned ones last."""
    return map_texts(docs, _scanner(net or fit(docs), False), "spans array<struct<kind:string,start:long,end:long>>", keep=keep)


def redacted(docs: DataFrame, net: dict[str, np.ndarray] | None = None, text: str = "text", keep=("doc_id",), mask: str = "[secret]",
             name: str = "clean") -> DataFrame:
    """The kept columns and the text with every span, and every overlap of spans, replaced by the mask."""
    made = map_texts(docs, _scanner(net or fit(docs), True, mask), "__masked string", text=text, keep=keep)
    return made.withColumnRenamed("__masked", name)


def digests(docs: DataFrame, net: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Counts, digest of the pattern spans and all spans as text."""
    return map_texts(docs, _scanner(net or fit(docs), None), "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long")


def _scanner(net, mode, mask=""):
    def setup():
        slope, offset, least = net["calibration"]

        def run(texts):
            base = [pattern_spans(t) for t in texts]
            where, shown = [], []
            for i, text in enumerate(texts):
                for s, e in candidates(text, base[i]):
                    own = windows(text, s, e)
                    where.append((i, s, e, len(own)))
                    shown += own
            logits = np.concatenate([scores(net, encode(shown[k:k + 512]))[0] for k in range(0, len(shown), 512)]) if shown else np.zeros(0)
            accepted = sigmoid(slope * logits + offset) >= least
            all_spans = [list(b) for b in base]
            at = 0
            for i, s, e, n in where:
                if accepted[at:at + n].any():
                    all_spans[i].append((s, len(KINDS), e))
                at += n
            names = [k[0] for k in KINDS] + [LEARNED]
            join = lambda spans: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)
            for spans in all_spans:
                spans.sort()
            if mode is False:
                return {"spans": [[{"kind": names[k], "start": s, "end": e} for s, k, e in spans] for spans in all_spans]}
            if mode is True:
                return {"__masked": [_masked(t, spans, mask) for t, spans in zip(texts, all_spans)]}
            count = lambda spans, k: sum(1 for x in spans if x[1] == k)
            return {"n_assign": [count(b, 0) for b in base], "n_access": [count(b, 1) for b in base], "n_hex": [count(b, 2) for b in base],
                    "base_sha256": [hashlib.sha256(join(b).encode()).hexdigest() for b in base], "spans": [join(s) for s in all_spans], "n_learned": [count(s, len(KINDS)) for s in all_spans]}
        return run
    return setup


def _masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join(out) + text[at:]
