"""Toxicity of whole texts by a bidirectional gated recurrent network with attention pooling, in numpy.

A text becomes words; a word enters as characters (mean of learned trigram vectors), as itself (a learned
vector by hash), by its evidence in the labelled rows (leave-one-out log odds), and by its shape. Overlapping
windows cover the whole text; a document's score is the calibrated score of its most toxic window, so every
window counts at any length. Training picks the windows itself: only document labels are given.

Fitted on at most FIT_TOXIC and FIT_CLEAN labelled rows of at most FIT_CHARS characters, from the training
share only; id, language, source and labels never enter a score. Null and empty texts have one empty window.
Repeated rows give repeated rows. Without a toxic label in the fitting rows all scores are near zero.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.blocks import hashed_sample, map_texts
from riskspark.llm.learn import Adam, calibrate, sigmoid

FIT_TOXIC, FIT_CLEAN, FIT_CHARS = 500, 1_500, 6_000
WINDOW, STRIDE = 64, 56
HIDDEN, WORD_DIM, CHAR_DIM, SHAPE = 6, 4, 4, 3
WORD_SLOTS, CHAR_SLOTS = 2048, 1024
INPUT = 1 + WORD_DIM + CHAR_DIM + SHAPE
MARKS = ".,;:!?\"'()[]{}<>*#$%&|-_=/\\"
TOKENS = 200_000  # distinct tokens remembered in one task


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no training sees."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


class Parts:
    """Parts of distinct tokens as arrays: lower-cased words, their slots, slots of their byte trigrams end to end, shapes."""

    def __init__(self, tokens: list[str]):
        bare = [t.strip(MARKS) for t in tokens]
        self.words = [b.lower() for b in bare]
        rings = [f"^{w}$ ".encode() for w in self.words]  # the last blank only parts it from the next
        self.slots = np.fromiter((zlib.crc32(r) for r in rings), np.int64, len(rings)) % WORD_SLOTS
        lengths = np.fromiter(map(len, rings), np.int64, len(rings))
        data = np.frombuffer(b"".join(rings) + b"  ", np.uint8).astype(np.int64)
        self.sizes = np.maximum(lengths - 3, 1)
        self.begins = np.cumsum(self.sizes) - self.sizes
        at = np.repeat(np.cumsum(lengths) - lengths - self.begins, self.sizes) + np.arange(int(self.sizes.sum()))
        mixed = data[at] * 7919 + data[at + 1] * 104_729 + data[at + 2] * 1_299_709
        self.grams = (mixed ^ (mixed >> 11)) % CHAR_SLOTS
        self.shapes = np.stack([np.fromiter((b.isupper() for b in bare), float, len(bare)), np.fromiter((len(t) - len(b) > 1 for t, b in zip(tokens, bare)), float, len(bare)),
                                np.minimum(np.fromiter(map(len, bare), float, len(bare)), 20) / 10 - 0.5], 1)

    def grams_of(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Trigram slots of some tokens end to end, and for each the place of its token in `some`."""
        sizes = self.sizes[some]
        first = np.cumsum(sizes) - sizes
        at = np.repeat(self.begins[some] - first, sizes) + np.arange(int(sizes.sum()))
        return self.grams[at], np.repeat(np.arange(len(some)), sizes)


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with so many tokens: token places [window, step], which of them exist, the text of each window."""
    number = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(counts)), number)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    begin = np.cumsum(counts) - counts
    place = within[:, None] * STRIDE + np.arange(WINDOW)[None]
    there = place < counts[owner][:, None]
    return np.where(there, place + begin[owner][:, None], 0), there, owner


def recur(gates: np.ndarray, mask: np.ndarray, own: np.ndarray, keep: bool = False):
    """Hidden states [step, window, HIDDEN] of one direction from projected inputs [step, window, 3 HIDDEN]."""
    steps, n, _ = gates.shape
    h, out, kept = np.zeros((n, HIDDEN), gates.dtype), np.empty((steps, n, HIDDEN), gates.dtype), []
    for t in range(steps):
        u = h @ own
        rz = 1 / (1 + np.exp(-(gates[t, :, :2 * HIDDEN] + u[:, :2 * HIDDEN])))
        r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
        c = np.tanh(gates[t, :, 2 * HIDDEN:] + r * u[:, 2 * HIDDEN:])
        new = c + z * (h - c)
        if keep:
            kept.append((h, u[:, 2 * HIDDEN:], r, z, c))
        h = np.where(mask[t][:, None], new, h)
        out[t] = h
    return out, kept


def recur_back(d_out, kept, mask, own):
    """Gradients of the projected inputs and of the recurrent weights."""
    steps, n, _ = d_out.shape
    dg, down, dh = np.empty((steps, n, 3 * HIDDEN)), np.zeros_like(own, dtype=float), np.zeros((n, HIDDEN))
    for t in range(steps - 1, -1, -1):
        h, un, r, z, c = kept[t]
        m = mask[t][:, None]
        dh = dh + d_out[t]
        dn = dh * m
        dc = dn * (1 - z) * (1 - c * c)
        dz = dn * (h - c) * z * (1 - z)
        dr = dc * un * r * (1 - r)
        dg[t] = np.concatenate([dr, dz, dc], 1)
        du = np.concatenate([dr, dz, dc * r], 1)
        down += h.T @ du
        dh = dh * ~m + dn * z + du @ own.T
    return dg, down


def project(net, inputs: np.ndarray) -> np.ndarray:
    return inputs @ net["in"] + net["in_bias"]


def forward(net, gates: np.ndarray, there: np.ndarray, keep: bool = False):
    """Logits of windows from projected inputs [window, step, 6 HIDDEN]."""
    g, mask = np.ascontiguousarray(gates.transpose(1, 0, 2)), np.ascontiguousarray(there.T)
    left, kl = recur(g[:, :, :3 * HIDDEN], mask, net["left"], keep)
    right, kr = recur(g[::-1, :, 3 * HIDDEN:], mask[::-1], net["right"], keep)
    h = np.concatenate([left, right[::-1]], 2)
    a = np.tanh(h @ net["look"])
    e = np.where(mask, a @ net["ask"], -30)
    w = np.exp(e - e.max(0)) * mask
    w = w / np.maximum(w.sum(0), 1e-9)
    pooled = (w[:, :, None] * h).sum(0)
    return pooled @ net["out"] + net["out_bias"][0], (mask, kl, kr, h, a, w, pooled)


def backward(net, kept, d):
    mask, kl, kr, h, a, w, pooled = kept
    dp = d[:, None] * net["out"][None]
    dw = (h * dp[None]).sum(2)
    de = w * (dw - (w * dw).sum(0))
    da = de[:, :, None] * net["ask"] * (1 - a * a)
    dh = w[:, :, None] * dp[None] + da @ net["look"].T
    dl, dleft = recur_back(dh[:, :, :HIDDEN], kl, mask, net["left"])
    dr, dright = recur_back(dh[::-1, :, HIDDEN:], kr, mask[::-1], net["right"])
    grads = {"out": pooled.T @ d, "out_bias": np.array([d.sum()]), "ask": (a * de[:, :, None]).sum((0, 1)), "look": np.tensordot(h, da, ((0, 1), (0, 1))),
             "left": dleft, "right": dright}
    return grads, np.concatenate([dl, dr[::-1]], 2).transpose(1, 0, 2)


def inputs_of(net, evidence: np.ndarray, parts: Parts) -> np.ndarray:
    """Input rows of all the tokens."""
    chars = np.add.reduceat(net["chars"][parts.grams], parts.begins, 0) / parts.sizes[:, None] if len(parts.words) else np.zeros((0, CHAR_DIM))
    return np.concatenate([evidence[:, None], net["words"][parts.slots], chars, parts.shapes], 1)


def _log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """How far a word's odds in toxic rows stand above chance, less one and a half standard errors."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return np.clip(odds - 1.5 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)), 0, 6)


def train(texts: list[str], labels: list[int], odds: float | None = None, seed: int = 5) -> dict:
    """The network, the evidence of words, and the calibration, from whole labelled texts.

    `odds` are those of the toxic label among all labelled rows, if the sample's differ.
    """
    once = dict(sorted(zip(texts, labels)))  # copies count once
    texts, y = list(once), np.array(list(once.values()), float)
    draw = np.random.default_rng(seed)
    split = [t.split() for t in texts]
    listed = sorted({t for own in split for t in own})
    index, parts = {t: k for k, t in enumerate(listed)}, Parts(listed)
    counts = np.array([len(s) for s in split], np.int64)
    ids = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
    place, there, owner = windows_of(counts)
    held = draw.random(len(y)) < 0.2
    word_index = {w: k for k, w in enumerate(dict.fromkeys(parts.words))}
    word = np.fromiter(map(word_index.__getitem__, parts.words), np.int64, len(parts.words))
    seen = np.zeros((2, len(word_index)))
    for k, own in enumerate(np.split(word[ids], np.cumsum(counts)[:-1]) if len(counts) else []):
        if not held[k]:
            seen[int(y[k]), np.unique(own)] += 1
    n_clean, n_toxic = int((~held & (y == 0)).sum()), int((~held & (y == 1)).sum())
    by_word = _log_odds(seen[1], seen[0], n_toxic, n_clean)
    as_new, left_out = by_word[word], _log_odds(np.maximum(seen[1] - 1, 0), seen[0], n_toxic, n_clean)[word]
    net = {"words": draw.normal(0, 0.05, (WORD_SLOTS, WORD_DIM)), "chars": draw.normal(0, 0.05, (CHAR_SLOTS, CHAR_DIM)), "in": draw.normal(0, 0.3, (INPUT, 6 * HIDDEN)),
           "in_bias": np.zeros(6 * HIDDEN), "left": draw.normal(0, 0.2, (HIDDEN, 3 * HIDDEN)), "right": draw.normal(0, 0.2, (HIDDEN, 3 * HIDDEN)),
           "look": draw.normal(0, 0.3, (2 * HIDDEN, HIDDEN)), "ask": draw.normal(0, 0.3, HIDDEN), "out": draw.normal(0, 0.3, 2 * HIDDEN), "out_bias": np.array([-1.0])}
    steps = Adam(net, 0.03)
    toxic_row = y[owner] == 1

    def logits(rows) -> np.ndarray:
        plain, out = project(net, inputs_of(net, as_new, parts)).astype(np.float32), np.empty(len(rows))
        lofo = project(net, inputs_of(net, left_out, parts)).astype(np.float32)
        w32 = {k: v.astype(np.float32) for k, v in net.items()}
        for at in range(0, len(rows), 2048):
            r = rows[at:at + 2048]
            x = np.where((toxic_row[r] & ~held[owner[r]])[:, None, None], lofo[ids[place[r]]], plain[ids[place[r]]]) if len(ids) else np.zeros((len(r), WINDOW, 6 * HIDDEN), np.float32)
            out[at:at + 2048] = forward(w32, x, there[r])[0]
        return out

    def best(values, rows) -> tuple[np.ndarray, np.ndarray]:
        if not len(rows):
            return rows, rows
        order = np.lexsort((values, owner[rows]))
        last = np.flatnonzero(np.append(owner[rows][order][1:] != owner[rows][order][:-1], True))
        return owner[rows][order[last]], order[last]

    used = np.flatnonzero(~held[owner])
    for epoch in range(8 if n_toxic and len(ids) else 0):
        steps.rate = 0.03 * 0.75**epoch
        if epoch in (0, 1, 3, 5):  # choose each document's window anew
            chosen = used[best(logits(used), used)[1]]
        clean = used[~toxic_row[used]]
        extra = draw.choice(clean, min(len(clean), len(chosen)), replace=False) if len(clean) else clean
        rows = np.concatenate([chosen, chosen[toxic_row[chosen]], extra])
        for r in np.array_split(draw.permutation(rows), max(1, len(rows) // 96)):
            evidence = np.where(toxic_row[r][:, None], left_out[ids[place[r]]], as_new[ids[place[r]]])
            need, back = np.unique(ids[place[r]], return_inverse=True)
            back = back.reshape(place[r].shape)
            flat, of = parts.grams_of(need)
            chars = np.zeros((len(need), CHAR_DIM))
            np.add.at(chars, of, net["chars"][flat])
            chars /= parts.sizes[need][:, None]
            slots = parts.slots[need]
            x = np.concatenate([evidence[:, :, None], net["words"][slots][back], chars[back], parts.shapes[need][back]], 2)
            z, kept = forward(net, project(net, x), there[r], True)
            grads, dg = backward(net, kept, (sigmoid(z) - y[owner[r]]) / len(r))
            dx = dg @ net["in"].T
            dwords, dchars, dneed = np.zeros_like(net["words"]), np.zeros_like(net["chars"]), np.zeros((len(need), CHAR_DIM))
            np.add.at(dwords, slots[back].ravel(), dx[:, :, 1:1 + WORD_DIM].reshape(-1, WORD_DIM))
            np.add.at(dneed, back.ravel(), dx[:, :, 1 + WORD_DIM:1 + WORD_DIM + CHAR_DIM].reshape(-1, CHAR_DIM))
            dneed /= parts.sizes[need][:, None]
            np.add.at(dchars, flat, dneed[of])
            steps.update(grads | {"in": np.tensordot(x, dg, ((0, 1), (0, 1))), "in_bias": dg.sum((0, 1)), "words": dwords + 0.006 * net["words"], "chars": dchars + 0.006 * net["chars"]})
    every = np.arange(len(owner))
    docs, at = best(logits(every), every)
    z = logits(every[at])
    fair = held[docs] if y[held].sum() >= 5 else np.ones(len(docs), bool)
    slope, offset = calibrate(z[fair], y[docs][fair]) if n_toxic else (1.0, -6.0)
    if odds and n_toxic:
        offset += np.log(odds) - np.log(y[docs][fair].sum() / max(1, (1 - y[docs][fair]).sum()))
    words = {w: v for w, v in zip(word_index, by_word.tolist()) if v}
    return {"net": {k: v.astype(np.float32) for k, v in net.items()}, "evidence": words, "calibration": (slope, offset)}


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Train on labelled rows of the training share."""
    marked = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = []
    for label, bound in ((1, FIT_TOXIC), (0, FIT_CLEAN)):
        sample = hashed_sample(marked.where(F.col("toxic") == label), "doc_id", bound)
        drawn = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= FIT_CHARS).join(F.broadcast(sample), "doc_id")  # at most `bound` ids
        rows += drawn.select("text", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(bound).collect()
    totals = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two labels
    return train([r["text"] for r in rows], [r["toxic"] for r in rows], totals.get(1, 0) / max(1, totals.get(0, 0)))


def scored(docs: DataFrame, model: dict, keep=("doc_id",), name: str = "score") -> DataFrame:
    """The kept columns and the score under the given name."""
    def setup():
        net, evidence, (slope, offset) = model["net"], model["evidence"], model["calibration"]
        state = {"index": {}, "gates": np.zeros((0, 6 * HIDDEN), np.float32)}

        def run(texts):
            split = [t.split() for t in texts]
            wanted = set(chain.from_iterable(split))
            if len(state["index"]) > TOKENS:
                state["index"], state["gates"] = {}, state["gates"][:0]
            index = state["index"]
            new = [t for t in wanted if t not in index]
            if new:
                parts = Parts(new)
                known = np.fromiter((evidence.get(w, 0.0) for w in parts.words), np.float32, len(new))
                index.update(zip(new, range(len(index), len(index) + len(new))))
                state["gates"] = np.concatenate([state["gates"], project(net, inputs_of(net, known, parts)).astype(np.float32)])
            counts = np.array([len(s) for s in split], np.int64)
            ids = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
            if not len(ids):
                ids = np.zeros(1, np.int64)
            gates = state["gates"] if len(state["gates"]) else np.zeros((1, 6 * HIDDEN), np.float32)
            place, there, owner = windows_of(counts)
            best = np.full(len(texts), -np.inf)
            for at in range(0, len(owner), 1024):
                z = forward(net, gates[ids[place[at:at + 1024]]], there[at:at + 1024])[0]
                np.maximum.at(best, owner[at:at + 1024], z)
            return {name: sigmoid(slope * best.astype(float) + offset)}
        return run

    return map_texts(docs, setup, f"{name} double", keep=keep)
