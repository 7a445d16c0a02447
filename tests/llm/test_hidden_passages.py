"""Passages that near copies of their later part stand between in suffix order."""

import random

import pytest

from riskspark.llm import repeated_passages


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def hidden():
    """60 pairs that share 60 words, and 150 documents each that share the last 40 of them only."""
    rng, rows, want = random.Random(3), [], {}
    for _ in range(60):
        own = words(rng, 60)
        for k in range(152):
            head, tail = words(rng, rng.randint(5, 30)), words(rng, 30)
            shared = own if k < 2 else own[20:]
            if k < 2:
                want[len(rows)] = (len(head), len(head) + 60)
            rows.append((len(rows), " ".join(head + shared + tail)))
    rng.shuffle(rows)
    return rows, want


@pytest.mark.parametrize("size", (60_000, 300))
def test_no_passage_is_hidden(spark, monkeypatch, size):
    monkeypatch.setattr(repeated_passages, "PARTITION_ROWS", size)
    rows, want = hidden()
    got = repeated_passages.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(want) and {r["doc_id"]: (r["start_word"], r["end_word"]) for r in got} == want
    assert all(len(r["others"]) == 1 and r["others"][0] in want for r in got)
