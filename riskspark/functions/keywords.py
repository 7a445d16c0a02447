"""Keyword tests over note text, packed into one bit mask per note."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskspark.functions.values import (
    COMPETITORS, EXECUTIVE_KEYWORDS, NEGATIVE_KEYWORDS, POSITIVE_KEYWORDS,
)

KEYWORDS = [*[("negative", k) for k in NEGATIVE_KEYWORDS], *[("positive", k) for k in POSITIVE_KEYWORDS],
            *[("competitor", k) for k in COMPETITORS], *[("executive", k) for k in EXECUTIVE_KEYWORDS]]
BIT = {entry: i for i, entry in enumerate(KEYWORDS)}


def _mask(tests: list[tuple[int, str]]) -> Column:
    return F.expr(" + ".join(["0L"] + [f"IF({test}, {1 << bit}L, 0L)" for bit, test in tests]))


def _literal(text: str) -> str:
    return "r'" + text + "'"  # keywords and their patterns hold no quotes


def _word(keyword: str) -> str:
    return re.escape(keyword.strip())


def inside_mask(text: str, word_boundary: bool = False) -> Column:
    """Keywords found inside the lower-cased note in column `text`."""
    def test(keyword: str) -> str:
        if word_boundary:
            return f"{text} RLIKE {_literal(rf'(?U)(?<!\w){_word(keyword)}(?!\w)')}"
        return f"contains({text}, {_literal(keyword)})"
    return _mask([(i, test(k)) for i, (_, k) in enumerate(KEYWORDS)])


def _spaced(word_boundary: bool) -> list[tuple[int, str, str]]:
    parts = []
    for i, (_, keyword) in enumerate(KEYWORDS):
        text = keyword.strip() if word_boundary else keyword
        if " " in text:
            left, right = text.split(" ", 1)
            parts.append((i, left, right))
    return parts


def tail_mask(text: str, word_boundary: bool = False) -> Column:
    """Keywords whose part before the blank ends this note."""
    def edge(left: str) -> str:
        if word_boundary:
            return f"{text} RLIKE {_literal(rf'(?U)(?<!\w){re.escape(left)}$')}"
        return f"endswith({text}, {_literal(left)})"
    return _mask([(i, edge(left)) for i, left, _ in _spaced(word_boundary)])


def head_mask(text: str, word_boundary: bool = False) -> Column:
    """Keywords whose part after the blank opens this note."""
    def edge(right: str) -> str:
        if word_boundary:
            return f"{text} RLIKE {_literal(rf'(?U)^{re.escape(right)}(?!\w)')}"
        return f"startswith({text}, {_literal(right)})"
    return _mask([(i, edge(right)) for i, _, right in _spaced(word_boundary)])


def hit(mask: str, kind: str, keyword: str) -> str:
    """SQL condition: the keyword's bit is set in column `mask`."""
    return f"({mask} & {1 << BIT[(kind, keyword)]}L) <> 0"


def hits(mask: str, kind: str) -> Column:
    """The keywords of one kind that were found, in list order."""
    return flagged([(hit(mask, k, word), _literal(word)) for k, word in KEYWORDS if k == kind])


def flagged(pairs: list[tuple[str, str]]) -> Column:
    """Array of the values whose condition holds, in order."""
    items = ", ".join(f"IF({condition}, {value}, NULL)" for condition, value in pairs)
    return F.expr(f"CAST(array_compact(array({items})) AS ARRAY<STRING>)")
