"""Licence notices by a positional index of rare words, in DataFrame functions only.

Each template is a sequence of words with a mandatory key phrase inside. Document frequencies of all template
words are counted over the whole corpus; every template is indexed under its POSTINGS words of highest inverse
document frequency, each with its position. A file's words are looked up; a hit of a posting says where the template
would begin, and the template's postings are intersected there by relative position: at least AGREE of them (all, where
a template has fewer) must stand. Then the key phrase is verified word by word, and the template's words that stand at
their relative positions, weighted by inverse document frequency, give the score of the place.

A place where AGREE of the postings stand has one of the POSTINGS - AGREE + 1 rarest among them, so only these are
looked up; the first of them that stands reports the place, so each place comes once. A base phrase is its whole
template, so all its places agree. The index travels inside the expression, so nothing is joined or shuffled
but the counts of a fixed list of words. Null and empty texts have no words, no labels and score 0.
Repeated rows give repeated rows; other columns play no part. A k that only case folding of a special sign
would make is of no effect: no template word has one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label, words, first word and number of words of the mandatory key phrase, counted in the base columns.
TEMPLATES = (
    ("cc-by", "cc by", 0, 2, True),
    ("gpl", "general public license", 0, 3, True),
    ("reserved", "all rights reserved", 0, 3, True),
    ("agpl", "gnu affero general public license", 1, 4, False),
    ("apache-2.0", "licensed under the apache license version 2 0", 3, 4, False),
    ("bsd", "redistribution and use in source and binary forms", 4, 4, False),
    ("cc-by-nc", "licensed under cc by nc 4 0", 2, 3, False),
    ("cc-by-sa", "licensed under cc by sa 4 0", 2, 3, False),
    ("gpl-3.0", "licensed under the gnu general public license version 3", 4, 5, False),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 0, 5, False),
    ("lgpl", "gnu lesser general public license", 1, 4, False),
    ("mit", "released under the mit license", 3, 2, False),
    ("mpl", "subject to the terms of the mozilla public license", 6, 3, False),
    ("public-domain", "released into the public domain", 1, 4, False),
)
POSTINGS, AGREE = 3, 2  # rarest words of a template, and how many must stand at their places
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
VOCABULARY = sorted({w for t in TEMPLATES for w in t[1].split()})


def words(text: str = "text") -> Column:
    """Words of a text with A-Z lower-cased."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), SEPARATORS, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def inverse_frequencies(docs: DataFrame) -> dict[str, float]:
    """Of each template word over all documents; at most as many rows as there are template words reach the driver."""
    found = docs.select(F.array_intersect(words(), F.array(*map(F.lit, VOCABULARY))).alias("w"))
    counts = found.select(F.explode(F.array_append("w", F.lit(" "))).alias("w")).groupBy("w").count()  # the blank counts all documents
    known = {r["w"]: r["count"] for r in counts.collect()}
    total = known.get(" ", 0)
    return {w: math.log(1 + (total + 1) / (known.get(w, 0) + 1)) for w in VOCABULARY}


def postings(phrase: str, idf: dict[str, float]) -> tuple[list[int], int, int]:
    """Positions of a template's rarest words, rarest first; how many must stand; how many are looked up."""
    parts = phrase.split()
    rare = sorted(range(len(parts)), key=lambda j: (-idf[parts[j]], j))[:POSTINGS]
    need = min(AGREE, len(rare))
    return rare, need, len(rare) - need + 1


def index(idf: dict[str, float]) -> Column:
    """The postings as a constant: word and position, the template's other postings, key phrase and weights."""
    rows = []
    for label, phrase, key, size, base in TEMPLATES:
        parts = phrase.split()
        part = [F.struct(F.lit(j).alias("j"), F.lit(w).alias("w"), F.lit(idf[w]).alias("idf")) for j, w in enumerate(parts)]
        rare, need, leading = postings(phrase, idf)
        held = lambda places: F.array(*[part[j] for j in places]) if places else F.filter(F.array(part[0]), lambda q: F.lit(False))  # noqa: E731, B023
        for rank, at in enumerate(rare[:leading]):
            rows.append(F.struct(
                F.lit(parts[at]).alias("word"), F.lit(at).alias("at"), held(rare[:rank]).alias("rarer"), held(rare).alias("postings"), F.lit(need).alias("need"),
                F.lit(key).alias("key"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(sum(idf[w] for w in parts)).alias("total"),
                F.array(*part).alias("parts"), F.array(*part[key:key + size]).alias("phrase")))
    return F.array(*rows)


def places(docs: DataFrame, idf: dict[str, float] | None = None, keep=("doc_id",)) -> DataFrame:
    """The kept columns, n_words, and places array<struct<start, label, base, score>>: start is of the key phrase."""
    idf = idf or inverse_frequencies(docs)
    looked_up = index_words(idf)
    row = docs.select(*keep, words().alias("__words"))
    row = row.select(*keep, "__words", F.filter(F.transform("__words", lambda w, i: F.when(w.isin(looked_up), i)), lambda i: i.isNotNull()).alias("__hits"))

    def at_hit(i):
        own = F.filter(index(idf), lambda p: p["word"] == F.get("__words", i))
        stands = lambda p: lambda q: F.coalesce(F.get("__words", i - p["at"] + q["j"]) == q["w"], F.lit(False))
        agreed = F.filter(own, lambda p: ~F.exists(p["rarer"], stands(p)) & (F.size(F.filter(p["postings"], stands(p))) >= p["need"]))
        verified = F.filter(agreed, lambda p: F.forall(p["phrase"], stands(p)))
        return F.transform(verified, lambda p: F.struct(
            (i - p["at"] + p["key"]).cast("long").alias("start"), p["label"].alias("label"), p["base"].alias("base"),
            (F.aggregate(p["parts"], F.lit(0.0), lambda a, q: a + F.when(stands(p)(q), q["idf"]).otherwise(0.0)) / p["total"]).alias("score")))

    return row.select(*keep, F.size("__words").cast("long").alias("n_words"), F.flatten(F.transform("__hits", at_hit)).alias("places"))


def index_words(idf: dict[str, float]) -> list[str]:
    """The words that are looked up."""
    found = set()
    for _, phrase, *_ in TEMPLATES:
        rare, _, leading = postings(phrase, idf)
        found.update(phrase.split()[j] for j in rare[:leading])
    return sorted(found)


def summary(docs: DataFrame) -> DataFrame:
    """One row per document: counts, first and last base place, labels, score."""
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    best = F.array_max(F.transform("places", lambda p: p["score"]))
    return places(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), F.round(F.least(F.coalesce(best, F.lit(0.0)), F.lit(1.0)), 9).alias("score"))


def summary_sql() -> str:
    """The same in DuckDB's SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    listed = ", ".join(f"'{w}'" for w in VOCABULARY)
    picks, scores, rare = [], [], []
    for k, (label, phrase, key, size, base) in enumerate(TEMPLATES):
        parts = phrase.split()
        at = lambda j: f"w[i + {j - key}] = '{parts[j]}'"  # noqa: E731, B023
        stands = " AND ".join(at(j) for j in range(key, key + size))
        rows = ", ".join(f"{{'a': -idf['{p}'], 'j': {j}, 'w': '{p}'}}" for j, p in enumerate(parts))
        rare.append(f"list_slice(list_sort([{rows}]), 1, {POSTINGS}) AS r{k}")
        agree = f"len(list_filter(r{k}, lambda x: i + x.j - {key} >= 1 AND coalesce(w[i + x.j - {key}] = x.w, false))) >= {min(AGREE, len(parts))}"
        picks.append(f"list_filter(list_filter(range(1, len(w) + 1), lambda i: coalesce({stands}, false)), lambda i: {agree}) AS p{k}")
        total = " + ".join(f"idf['{p}']" for p in parts)
        got = " + ".join(f"(CASE WHEN i + {j - key} >= 1 AND coalesce({at(j)}, false) THEN idf['{parts[j]}'] ELSE 0.0 END)" for j in range(len(parts)))
        scores.append(f"coalesce(list_max(list_transform(p{k}, lambda i: ({got}) / ({total}))), 0.0)")
    bases = [k for k, t in enumerate(TEMPLATES) if t[4]]
    joined = " || ".join(f"p{k}" for k in bases)
    labels = lambda ks: "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{TEMPLATES[k][0]}' END" for k in ks) + "], lambda x: x IS NOT NULL)), ',')"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
n AS (SELECT count(*) AS total FROM d),
f AS (SELECT v, count(*) AS docs FROM (SELECT unnest(list_distinct(list_filter(w, lambda x: x IN ({listed})))) AS v FROM d) GROUP BY v),
m AS (SELECT map(list(v), list(ln(1 + (total + 1) / (coalesce(docs, 0) + 1)))) AS idf FROM (SELECT unnest([{listed}]) AS v) LEFT JOIN f USING (v), n),
r AS (SELECT idf, {", ".join(rare)} FROM m),
p AS (SELECT doc_id, w, idf, {", ".join(picks)} FROM d, r),
s AS (SELECT doc_id, w, {joined} AS b, {labels(bases)} AS base_labels, {labels(range(len(TEMPLATES)))} AS labels, greatest({", ".join(scores)}) AS best FROM p)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(b) AS BIGINT) AS n_base, list_min(b) - 1 AS first_word, list_max(b) - 1 AS last_word,
       base_labels, labels, round(least(best, 1.0), 9) AS score FROM s"""
