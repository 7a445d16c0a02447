"""Quality of documents: fixed rules, then gradient-boosted trees over document statistics.

Trees are grown in numpy on binned features of labelled rows, with monotonic constraints (more symbols or
repetition never raises quality), then flattened into node arrays so that a block of documents is scored in one
loop over the levels. Statistics are taken over whole texts.

Null and empty texts have no words and fail the fixed rules. Repeated rows give repeated rows. Without both
labels in the fitting rows the trees give one constant and only the fixed rules decide.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.blocks import hashed_sample, map_texts
from riskspark.llm.learn import sigmoid

SYMBOLS = "#*$%&|<>"
BLANKS = "\x20\t\n\x0b\x0c\r"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
FIT_ROWS = 20_000  # bound of the labelled rows that the trees are grown on; a row is a dozen numbers
FEATURES = {  # and the direction that quality may take as it grows
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
    "digit_share": -1, "punctuation_share": 0, "distinct_share": 0, "long_word_share": 0, "bar_line_share": -1, "stop_mark_share": 0,
}
_NOT_SYMBOL = re.compile(r"[^#*$%&|<>]+")
_UPPER, _DIGIT, _MARK = (re.compile(p) for p in ("[^A-Z]+", "[^0-9]+", r"[^.,;:!?]+"))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _rolled(values: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for each run of `size` word hashes."""
    h = np.zeros(len(values) - size + 1, np.uint64)
    for k in range(size):
        h = (h ^ (h >> np.uint64(29))) * _MULTIPLIER + values[k:k + len(h)]
    return h


def repeated_words(hashes: np.ndarray, size: int = WINDOW) -> int:
    """Words inside windows that the text holds twice or more, first ones included."""
    if len(hashes) < size:
        return 0
    h = _rolled(hashes, size)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(again), 1)
    np.add.at(covered, np.flatnonzero(again) + size, -1)
    return int((covered.cumsum()[:-1] > 0).sum())


def statistics(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then the features in order."""
    data = text.encode()
    words = data.split()  # bytes split at exactly the six ASCII blanks
    n = len(words)
    blanks = sum(map(text.count, BLANKS))
    chars = len(text) - blanks
    symbols = len(_NOT_SYMBOL.sub("", text))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    dups = len(lines) - len(set(lines))
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    repeats = repeated_words(hashes)
    many, some = max(1, n), max(1, chars)
    features = (
        np.log1p(n), chars / many, symbols / some, dups / max(1, len(lines)), repeats / many, len(_UPPER.sub("", text)) / some, len(_DIGIT.sub("", text)) / some,
        len(_MARK.sub("", text)) / some, len(set(words)) / many, sum([len(w) > 12 for w in words]) / many, sum(["|" in x for x in lines]) / max(1, len(lines)),
        sum([x.rstrip()[-1:] in ".!?" for x in lines]) / max(1, len(lines)))
    return (n, chars, symbols, dups, repeats, *features)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, least: float = 3.0) -> dict[str, np.ndarray]:
    """Boosted trees of logistic loss as node arrays [tree, node]: feature, threshold, value; children of k are 2k+1, 2k+2."""
    signs = np.array(list(FEATURES.values()))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin b: values up to edges[b]
    nodes = 2 ** (depth + 1) - 1
    feature, threshold, value = np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    rate_pos = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    start = float(np.log(rate_pos / (1 - rate_pos)))
    margin = np.full(len(y), start)
    for t in range(trees if 0 < y.sum() < len(y) else 0):
        p = sigmoid(margin)
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        low, high = np.full(nodes, -np.inf), np.full(nodes, np.inf)
        for k in range(nodes):
            rows = np.flatnonzero(at == k)
            if not len(rows) and k:
                continue
            G, H = g[rows].sum(), h[rows].sum()
            value[t, k] = np.clip(-G / (H + 1), low[k], high[k])
            if k >= 2**depth - 1 or H < 2 * least:
                continue
            best, choice = 1e-3, None
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                gl, hl = np.bincount(b, g[rows], len(e) + 1).cumsum()[:-1], np.bincount(b, h[rows], len(e) + 1).cumsum()[:-1]
                gr, hr = G - gl, H - hl
                vl, vr = np.clip(-gl / (hl + 1), low[k], high[k]), np.clip(-gr / (hr + 1), low[k], high[k])
                gain = G * G / (H + 1) * -1 + gl * gl / (hl + 1) + gr * gr / (hr + 1)
                ok = (hl >= least) & (hr >= least) & (signs[j] * (vr - vl) >= 0)
                gain = np.where(ok, gain, -1)
                m = int(gain.argmax())
                if gain[m] > best:
                    best, choice = gain[m], (j, m, vl[m], vr[m])
            if choice:
                j, m, vl, vr = choice
                feature[t, k], threshold[t, k] = j, edges[j][m]
                go = binned[rows, j] > m
                at[rows] = 2 * k + 1 + go
                mid = (vl + vr) / 2
                for child, right in ((2 * k + 1, 0), (2 * k + 2, 1)):
                    low[child], high[child] = low[k], high[k]
                    if signs[j]:  # what lies below may not cross the middle
                        if (signs[j] > 0) == bool(right):
                            low[child] = max(low[child], mid)
                        else:
                            high[child] = min(high[child], mid)
        value[t] *= rate
        margin += value[t, at]
    return {"feature": feature, "threshold": threshold, "value": value, "start": np.array([start]), "depth": np.array([depth])}


def score(trees: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probability of good quality for rows of features, all trees side by side."""
    total = np.full(len(x), trees["start"][0])
    every, rows = np.arange(len(trees["feature"]))[None, :], np.arange(len(x))[:, None]
    at = np.zeros((len(x), len(trees["feature"])), np.int64)
    for _ in range(int(trees["depth"][0])):
        f = trees["feature"][every, at]
        go = x[rows, np.maximum(f, 0)] > trees["threshold"][every, at]
        at = np.where(f >= 0, 2 * at + 1 + go, at)
    return sigmoid(total + trees["value"][every, at].sum(1))


_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _setup(trees):
    def setup():
        def run(texts):
            found = [statistics(t) for t in texts]
            out = {n: [f[i] for f in found] for i, n in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}
            if trees is None:
                return out | {"features": [[float(v) for v in f[5:]] for f in found]}
            p = score(trees, np.array([f[5:] for f in found], float).reshape(len(found), len(FEATURES)))
            failed = [base_failed(f[0], f[4]) for f in found]
            return out | {"base_failed": failed, "kept": [bool(not b and q >= 0.5) for b, q in zip(failed, p)], "score": [float(q) for q in p]}
        return run
    return setup


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """Grow the trees on at most FIT_ROWS labelled documents that pass the fixed rules."""
    sample = hashed_sample(labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", FIT_ROWS)
    drawn = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most FIT_ROWS ids
    found = map_texts(drawn, _setup(None), _STATS + ", features array<double>", keep=("doc_id", "quality"))
    rows = found.where(f"n_words >= {MIN_WORDS} AND 100 * n_repeat_words <= {REPEAT_PERCENT} * n_words").select("quality", "features").limit(2 * FIT_ROWS).toArrow()
    x = np.array(rows.column("features").to_pylist(), float).reshape(rows.num_rows, len(FEATURES))
    y = np.array(rows.column("quality").to_pylist(), float)
    order = np.lexsort(np.column_stack([x, y]).T) if len(x) else np.zeros(0, int)  # one order, however the rows came
    return grow(x[order], y[order])


def judge(docs: DataFrame, trees: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and score."""
    return map_texts(docs, _setup(trees), _STATS + ", base_failed boolean, kept boolean, score double")
