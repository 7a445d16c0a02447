"""Best common subsequence of each header among many names, by branch and bound over the names' shared beginnings."""

import sys
from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import cloudpickle

# executors need no installed copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Letters and digits by themselves. Six bits a letter, ten of them in one word.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
COUNT_BITS, LETTERS_PER_WORD = 6, 10
WORDS = -(-len(LETTERS) // LETTERS_PER_WORD)
HEADS_AT_ONCE = 4096
# Rows of a step; more are cut in two, the more promising half first, so that memory stays bounded.
STEP_ROWS = 1 << 18
# Nodes of each depth that the first walk keeps per header: it only looks for a good score to start from.
BEAM = 8
ONE, FULL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def _code_points(texts, width: int) -> np.ndarray:
    """One row per text; what stands behind its end is zero."""
    return np.array(texts, dtype=f"U{max(1, width)}").view(np.uint32).reshape(len(texts), max(1, width))


def _letters(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each letter occurs in each text, n of a letter as n bits of its place, and the number of characters without a bit."""
    place = {ord(ch): i for i, letter in enumerate(LETTERS) for ch in (letter, letter.upper())}
    table = np.full(128, -1)
    table[list(place)] = list(place.values())
    kind = np.where(codes < 128, table[np.minimum(codes, 127)], -1)
    kind[np.arange(codes.shape[1]) >= lengths[:, None]] = -1
    row, col = np.nonzero(kind >= 0)
    counts = np.bincount(row * len(LETTERS) + kind[row, col], minlength=len(codes) * len(LETTERS)).reshape(len(codes), -1)
    counts = np.minimum(counts, COUNT_BITS)
    bits = np.zeros((len(codes), WORDS), np.uint64)
    for i in range(len(LETTERS)):
        unary = (ONE << counts[:, i].astype(np.uint64)) - ONE
        bits[:, i // LETTERS_PER_WORD] |= unary << np.uint64(COUNT_BITS * (i % LETTERS_PER_WORD))
    return bits, lengths - counts.sum(axis=1)


def _sorted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the texts, and how many characters each begins with like the one before it."""
    at = np.lexsort(codes.T[::-1])
    differ = codes[at[1:]] != codes[at[:-1]]
    return at, np.concatenate([[-1], np.where(differ.any(axis=1), differ.argmax(axis=1), codes.shape[1])])


class NameTree:
    """Distinct names of one length by their beginnings; a node of one name has no nodes below it.

    Names that end alike more than they begin alike are read backwards; a common subsequence is one both ways.
    """

    def __init__(self, names: np.ndarray, order: np.ndarray):
        self.length, n = len(names[0]), len(names)
        codes = _code_points(names, self.length)
        (at, alike), back = _sorted(codes), _sorted(codes[:, ::-1])
        self.backwards = bool(back[1].sum() > alike.sum())
        if self.backwards:
            codes, (at, alike) = codes[:, ::-1], back
        self.row, codes, self.order = at, codes[at], order[at]
        self.alphabet, flat = np.unique(codes, return_inverse=True)
        self.codes = flat.reshape(codes.shape).astype(np.int32)
        bits, over = _letters(codes, np.full(n, self.length))
        tokens = [name.split(" ") for name in names[at]]
        uses = Counter(chain.from_iterable(tokens)).most_common(64)
        self.tokens = {token: 1 << i for i, (token, many) in enumerate(uses) if many > 1}
        own = _masks(tokens, self.tokens)
        # characters that occur at a place or behind it
        seen = np.zeros((self.length + 1, len(self.alphabet)), bool)
        for d in range(self.length - 1, -1, -1):
            seen[d] = seen[d + 1]
            seen[d, self.codes[:, d]] = True
        self.seen = seen
        self.levels, starts, ends = [], np.array([0]), np.array([n])
        while True:
            d = len(self.levels)
            level = {"start": starts, "char": self.codes[starts, d - 1], "single": ends - starts == 1,
                     "order": self._of(np.minimum, self.order, starts, ends),
                     "bits": self._of(np.bitwise_or, bits, starts, ends), "over": self._of(np.maximum, over, starts, ends),
                     "tokens": self._of(np.bitwise_and, own, starts, ends)}
            self.levels.append(level)
            split = np.flatnonzero(~level["single"])
            if not len(split) or d == self.length:
                break
            begins = np.flatnonzero(alike <= d)  # rows that differ from the one before within d + 1 characters
            first, last = np.searchsorted(begins, starts[split]), np.searchsorted(begins, ends[split])
            below = np.repeat(first, last - first) + _within(last - first)
            level["children"] = np.zeros(len(starts), np.int64)
            level["children"][split] = last - first
            level["first"] = np.zeros(len(starts), np.int64)
            level["first"][split] = np.cumsum(last - first) - (last - first)
            starts, ends = begins[below], np.append(begins, n)[below + 1]

    @staticmethod
    def _of(combine, values, starts, ends):
        """`combine` over the rows of each node; nodes come in order and may leave rows between them out."""
        cuts = np.column_stack([starts, ends]).ravel()
        if cuts[-1] == len(values):
            cuts = cuts[:-1]
        return combine.reduceat(values, cuts, axis=0)[::2]


def _masks(lists: list[list[str]], bits: dict[str, int]) -> np.ndarray:
    return np.array([sum({bits.get(token, 0) for token in tokens}) for tokens in lists], np.uint64)


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of the runs."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _step(row: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """One more character of the name; the words of a row are one number of many bits."""
    added, carry = row + hit, None
    for w in range(1, row.shape[1]):
        carry = added[:, w - 1] < row[:, w - 1] if carry is None else carry | (added[:, w - 1] < row[:, w - 1])
        plain = added[:, w]
        added[:, w] = plain + carry
        carry = carry & (added[:, w] < plain)
    return added | (row - hit)


def _count(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=1, dtype=np.int64)


class Search:
    """The best name of each header of a batch: the longest common subsequence, then the earliest name.

    `best` is the length that a name must reach, `order` the position it must come before if it reaches no more.
    """

    def __init__(self, tree: NameTree, names: np.ndarray, heads: list[str], best: np.ndarray, order: np.ndarray):
        self.tree, self.names, self.size = tree, names, len(heads)
        self.best, self.order, self.name = best.copy(), order.copy(), np.full(len(heads), -1)
        self.tokens = [frozenset(h.split(" ")) for h in heads]
        self.shared = _masks(self.tokens, tree.tokens)
        lengths = np.fromiter(map(len, heads), np.int64, len(heads))
        codes = _code_points([h[::-1] for h in heads] if tree.backwards else heads, int(lengths.max()))
        self.bits, self.over = _letters(codes, lengths)
        words = -(-int(lengths.max()) // 64)
        # where each character of the names stands in a header
        self.masks = np.zeros((len(heads), len(tree.alphabet), words), np.uint64)
        for p in range(codes.shape[1]):
            char = np.minimum(np.searchsorted(tree.alphabet, codes[:, p]), len(tree.alphabet) - 1)
            of = np.flatnonzero((tree.alphabet[char] == codes[:, p]) & (p < lengths))
            self.masks[of, char[of], p // 64] |= ONE << np.uint64(p % 64)
        # places of a header whose character still comes in some name
        self.reach = np.zeros((tree.length + 1, len(heads), words), np.uint64)
        for d in range(tree.length - 1, -1, -1):
            self.reach[d] = self.reach[d + 1]
            for c in np.flatnonzero(tree.seen[d] & ~tree.seen[d + 1]):
                self.reach[d] |= self.masks[:, c]

    def run(self) -> None:
        every = np.arange(self.size)
        rows = np.full((len(every), self.masks.shape[2]), FULL)
        start = (0, every, np.zeros(len(every), np.int64), rows, np.full(len(every), self.tree.length))
        if self.tree.levels[0]["single"][0]:
            self._ends(0, every, np.zeros(len(every), np.int64), rows)
            return
        walk = start
        while len(walk[1]):
            walk = self._kept(self._below(walk))
        todo = [start]
        while todo:
            depth, head, node, row, bound = walk = todo.pop()
            keep = self._worth(head, bound, self.tree.levels[depth]["order"][node])
            if not keep.all():
                depth, head, node, row, bound = walk = (depth, *(x[keep] for x in walk[1:]))
            if not len(head):
                continue
            if len(head) > 1 and self.tree.levels[depth]["children"][node].sum() > STEP_ROWS:
                by = np.argsort(self.best[head] - bound, kind="stable")
                for half in (by[len(by) // 2:], by[:len(by) // 2]):
                    todo.append((depth, *(x[half] for x in walk[1:])))
                continue
            below = self._below(walk)
            if len(below[1]):
                todo.append(below)

    def _worth(self, head, bound, order) -> np.ndarray:
        best = self.best[head]
        return (bound > best) | ((bound == best) & (order < self.order[head]))

    def _below(self, walk):
        """The nodes one character on that may still hold a better name; those of a single name are walked to its end."""
        depth, head, node, row, _ = walk
        above, level = self.tree.levels[depth], self.tree.levels[depth + 1]
        many = above["children"][node]
        at = np.repeat(np.arange(len(node)), many)
        child, head = np.repeat(above["first"][node], many) + _within(many), head[at]
        letters = _count(self.bits[head] & level["bits"][child]) + np.minimum(self.over[head], level["over"][child])
        apart = self.shared[head] & level["tokens"][child] == 0  # else all names below share a token with the header
        keep = apart & self._worth(head, letters, level["order"][child])
        at, child, head, letters = at[keep], child[keep], head[keep], letters[keep]
        row, bound = self._next(depth, head, row[at], level["char"][child])
        bound = np.minimum(bound, letters)
        single = level["single"][child]
        alone = single & self._worth(head, bound, level["order"][child])
        if alone.any():
            self._ends(depth + 1, head[alone], level["start"][child[alone]], row[alone])
        keep = ~single & self._worth(head, bound, level["order"][child])
        return depth + 1, head[keep], child[keep], row[keep], bound[keep]

    def _next(self, depth, head, row, char):
        row = _step(row, row & self.masks[head, char])
        reached = ~row
        # each further character adds one at most, and only at places whose character still comes
        return row, np.minimum(_count(reached) + self.tree.length - depth - 1, _count(reached | self.reach[depth + 1, head]))

    def _kept(self, walk):
        """The most promising nodes of each header."""
        depth, head, node, row, bound = walk
        if not len(head):
            return walk
        by = np.lexsort((self.tree.levels[depth]["order"][node], -_count(~row), -bound, head))
        own = head[by]
        counts = np.diff(np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own)))
        by = by[_within(counts) < BEAM]
        return depth, head[by], node[by], row[by], bound[by]

    def _ends(self, depth, head, name, row) -> None:
        """Single names to their ends, then the best of them."""
        for d in range(depth, self.tree.length):
            row, bound = self._next(d, head, row, self.tree.codes[name, d])
            keep = self._worth(head, bound, self.tree.order[name])
            if not keep.all():
                head, name, row = head[keep], name[keep], row[keep]
            if not len(head):
                return
        reached = _count(~row)
        keep = np.flatnonzero(self._worth(head, reached, self.tree.order[name]))
        done = -1
        for i in keep[np.lexsort((self.tree.order[name[keep]], -reached[keep], head[keep]))]:
            h = head[i]
            if h != done and self._apart(h, self.tree.row[name[i]]):
                self.best[h], self.order[h], self.name[h], done = reached[i], self.tree.order[name[i]], name[i], h

    def _apart(self, head: int, name: int) -> bool:
        """No token in common: pairs that share one are scored without it, elsewhere."""
        return self.tokens[head].isdisjoint(self.names[name].split(" "))


def best_names(heads: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
    """The best name among those of one length for each header, where it reaches the header's floor; one row per header at most.

    `shared_length` counts the characters of shared tokens, their gap and the common subsequence of what is left of both.
    """
    order = names["ord"].to_numpy()
    if not len(heads) or not len(names):  # all headers of the cell went to its other parts
        return pd.DataFrame({"hid": [], "nid": [], "ord": [], "shared_length": [], "total": []}).astype("int64").astype({"ord": order.dtype})
    last = np.iinfo(np.int64).max if order.dtype.kind == "i" else np.finfo(np.float64).max
    texts = names["rest"].to_numpy(dtype=object)
    tree = NameTree(texts, order)
    known, total = heads["known"].to_numpy(np.int64), heads["total"].to_numpy(np.int64)
    floor = heads["floor"].to_numpy(np.float64)
    need = np.maximum(np.ceil(floor * total / 200.0 - known - 1e-6), 0).astype(np.int64)
    equal = np.abs(200.0 * (known + need) / total - floor) < 1e-9  # then only an earlier name is better
    limit = np.where(equal, heads["before"].to_numpy(order.dtype), last)
    rest = heads["rest"].to_numpy(dtype=object)
    size = np.fromiter(map(len, rest), np.int64, len(rest))
    by = np.argsort(size, kind="stable")  # short headers need one word each
    out, hid, nid = [], heads["hid"].to_numpy(np.int64), names["nid"].to_numpy(np.int64)
    at_once = max(1, min(HEADS_AT_ONCE, (1 << 24) // (len(tree.alphabet) * max(1, -(-int(size.max()) // 64)))))
    edge = int(np.searchsorted(size[by], 64, side="right"))
    for part in (by[:edge], by[edge:]):
        for batch in (part[i:i + at_once] for i in range(0, len(part), at_once)):
            found = Search(tree, texts, list(rest[batch]), need[batch], limit[batch])
            found.run()
            hit = np.flatnonzero(found.name >= 0)
            out.append(pd.DataFrame({"hid": hid[batch[hit]], "nid": nid[tree.row[found.name[hit]]], "ord": found.order[hit],
                                     "shared_length": known[batch[hit]] + found.best[hit], "total": total[batch[hit]]}))
    return pd.concat(out)
