"""Runs of repeated words, by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words with least period q, at least twice that long, that cannot be extended.

1. Only stretches whose every word lies in a word n-gram that the stretch holds twice can hold a run
   (a run of length >= max(least, 2q) repeats each of its grams of least/2 words at distance q), so
   the rest of a text never enters the tree. This is a necessary condition, not a cut-off.
2. The stretches of a batch of texts, each closed by a symbol of its own, form one sequence with one
   suffix tree, kept as a sorted list of suffixes with the ranks of all substrings of 2^j symbols: a
   node is an interval of that list, a suffix link or a child is a search in it.
3. The blocks of the sequence's Lempel-Ziv factorisation give the squares that cover the leftmost
   occurrence of every square. Squares of a root that is itself a power are left out: no run has them.
4. Walks by suffix links from those squares visit every other square: from w = a v to v a, as long as the
   tree has it and it is not yet marked.
5. The leaves under each marked place are the occurrences. Those of one period that start next to each
   other merge into a run.

A task holds a batch of texts and some 30 numbers per repeated word and level (the levels are the base-2
logarithm of the longest stretch); nothing is shuffled and texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import id_back, id_text
from .vocab import chunks

#: Odd multipliers of the gram hash; equal grams of one stretch always meet, a chance meeting costs time only.
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (n[0] numbers), then the same from start[1], and so on."""
    first = np.cumsum(n) - n
    return np.arange(int(n.sum()), dtype=np.int64) + np.repeat(start - first, n)


class SuffixTree:
    """A sequence of whole numbers, closed by a number that occurs once, and its suffixes in order."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = self.n = len(symbols)
        ranks = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.ranks = [ranks.astype(np.int32)]
        while int(ranks.max()) + 1 < n:
            step = 1 << (len(self.ranks) - 1)
            after = np.zeros(n, np.int64)
            after[: n - step] = ranks[step:] + 1
            ranks = np.unique(ranks * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
            self.ranks.append(ranks.astype(np.int32))
        self.order = np.empty(n, np.int64)
        self.order[ranks] = np.arange(n)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the suffixes at a and b agree (a != b)."""
        a, b, start = a.copy(), b.copy(), a
        for j in range(len(self.ranks) - 1, -1, -1):
            inside = np.maximum(a, b) + (1 << j) <= self.n
            same = inside & (self.ranks[j][np.where(inside, a, 0)] == self.ranks[j][np.where(inside, b, 0)])
            a += same << j
            b += same << j
        return a - start

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the prefixes that end with a and b agree, read backwards; -1 is before the first symbol."""
        a, b, start = a.copy(), b.copy(), a
        for j in range(len(self.ranks) - 1, -1, -1):
            back = (1 << j) - 1
            inside = np.minimum(a, b) >= back
            same = inside & (self.ranks[j][np.where(inside, a - back, 0)] == self.ranks[j][np.where(inside, b - back, 0)])
            a -= same << j
            b -= same << j
        return start - a

    def level(self, length: np.ndarray) -> np.ndarray:
        """The largest j that has ranks and 2^j <= length."""
        return np.minimum(np.frexp(length.astype(float))[1] - 1, len(self.ranks) - 1)

    def bounds(self, j: np.ndarray, shift: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Within [low, high) of the order, where the rank at level j of the symbols from shift on is wanted; they are in order there."""
        found = []
        for right in (False, True):
            lo, hi = low.copy(), high.copy()
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                at = self.order[np.minimum(mid, self.n - 1)] + shift
                rank = self._rank(j, at)
                go = (rank <= wanted) if right else (rank < wanted)
                lo = np.where(open_ & go, mid + 1, lo)
                hi = np.where(open_ & ~go, mid, hi)
            found.append(lo)
        return found[0], found[1]

    def _rank(self, j: np.ndarray, at: np.ndarray) -> np.ndarray:
        out, at = np.full(len(at), -1, np.int64), np.broadcast_to(at, j.shape)
        for level in np.unique(j):
            own = (j == level) & (at < self.n)
            out[own] = self.ranks[level][at[own]]
        return out

    def node(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with the length symbols (at most 2^levels) from start."""
        j, zero = self.level(length), np.zeros(len(start), np.int64)
        lo, hi = self.bounds(j, zero, self._rank(j, start), zero, zero + self.n)
        # Of suffixes that share 2^j symbols, the order is that of the last 2^j of the length.
        rest = length - (1 << j)
        return self.bounds(j, rest, self._rank(j, start + rest), lo, hi)

    def turned(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For w = a v at start: where v a occurs, by the suffix link and the child for a; -1 if nowhere."""
        lo, hi = self.node(start + 1, length - 1)
        zero = np.zeros(len(start), np.int64)
        lo, hi = self.bounds(zero, length - 1, self._rank(zero, start), lo, hi)
        return np.where(lo < hi, self.order[np.minimum(lo, self.n - 1)], -1)


def blocks(tree: SuffixTree) -> np.ndarray:
    """The starts of the Lempel-Ziv blocks: each is the longest stretch that also starts earlier, or one new symbol."""
    n, order = tree.n, tree.order.tolist()
    before, after, stack = [-1] * n, [-1] * n, []
    for at in order:  # the nearest suffixes in order, to both sides, that start earlier
        while stack and stack[-1] > at:
            after[stack.pop()] = at
        if stack:
            before[at] = stack[-1]
        stack.append(at)
    longest = np.zeros(n, np.int64)
    for other in (np.array(before), np.array(after)):
        has = np.flatnonzero(other >= 0)
        longest[has] = np.maximum(longest[has], tree.forward(has, other[has]))
    starts, at, steps = [], 0, np.maximum(longest, 1).tolist()
    while at < n:
        starts.append(at)
        at += steps[at]
    return np.array(starts, np.int64)


def leftmost_squares(tree: SuffixTree, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, half length) of squares of which each one's run holds the leftmost occurrence of every square.

    A square's right half meets at most two blocks. Its centre lies in one, [here, next): either it goes over
    that block's end, or over its start.
    """
    here = blocks(tree)
    nexts = np.append(here[1:], tree.n)
    size = nexts - here
    found = []
    # Over the end: the halves meet k before the next block.
    k, edge = ranges(np.ones(len(here), np.int64), size), np.repeat(nexts, size)
    ok = edge < tree.n
    ok[ok] = symbols[edge[ok]] == symbols[edge[ok] - k[ok]]
    k, edge = k[ok], edge[ok]
    q = edge - k
    right, left = tree.forward(edge, q), tree.backward(edge - 1, q - 1)
    ok = right + left >= k
    found.append((np.maximum(q - left, q - k + 1)[ok], k[ok]))
    # Over the start: the second half begins k after it, in this block or the next.
    reach = size + np.append(size[1:], 0)
    k, edge, stop = ranges(np.ones(len(here), np.int64), reach), np.repeat(here, reach), np.repeat(nexts, reach)
    ok = edge + k < tree.n
    ok[ok] = symbols[edge[ok]] == symbols[edge[ok] + k[ok]]
    k, edge, stop = k[ok], edge[ok], stop[ok]
    right, left = tree.forward(edge, edge + k), tree.backward(edge - 1, edge + k - 1)
    start = np.maximum(edge - left, edge - k + 1)
    ok = (right + left >= k) & (start + k <= stop)
    found.append((start[ok], k[ok]))
    start, half = (np.concatenate(x) for x in zip(*found))
    both = np.unique(half * np.int64(tree.n) + start)
    return both % tree.n, both // tree.n


def primitive(tree: SuffixTree, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether the half symbols from start are no power of a shorter stretch."""
    ok, rest = np.ones(len(start), bool), half.copy()
    least = np.arange(int(half.max(initial=1)) + 1)  # the least prime factor of each number
    for p in range(int(len(least) ** 0.5), 1, -1):
        least[p::p] = p
    while (open_ := np.flatnonzero(rest > 1)).size:
        factor = least[rest[open_]]
        period = half[open_] // factor
        ok[open_] &= tree.forward(start[open_], start[open_] + period) < half[open_] - period
        rest[open_] //= factor
    return ok


def vocabulary(tree: SuffixTree, start: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every square of a primitive root as (node's first, node's end, half length), by walks from the given ones."""
    marked = np.zeros(0, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(start):
        # As long as the text itself goes on, it shows where the suffix link leads; a full turn closes a walk.
        room = tree.forward(start, start + half) - half + 1
        n = np.minimum(room, half)
        at, q = ranges(start, n), np.repeat(half, n)
        lo, hi = tree.node(at, 2 * q)
        mark, first = np.unique(q * np.int64(tree.n) + lo, return_index=True)
        new = ~np.isin(mark, marked, assume_unique=True)
        marked = np.union1d(marked, mark)
        first = first[new]
        out.append((lo[first], hi[first], q[first]))
        ends = np.cumsum(n) - 1
        fresh = np.isin(ends, first) | (np.isin(q[ends] * np.int64(tree.n) + lo[ends], mark[new]))
        ends = ends[(n < half) & fresh]
        after = tree.turned(at[ends], 2 * q[ends])
        start, half = after[after >= 0], q[ends][after >= 0]
        if len(start):
            both = np.unique(half * np.int64(tree.n) + start)
            start, half = both % tree.n, both // tree.n
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def sequence_runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of a sequence whose last symbol occurs once, by period and start."""
    tree = SuffixTree(symbols)
    start, half = leftmost_squares(tree, symbols)
    whole = primitive(tree, start, half)
    lo, hi, q = vocabulary(tree, start[whole], half[whole])
    at = tree.order[ranges(lo, hi - lo)]
    key = np.sort(np.repeat(q, hi - lo) * np.int64(2 * tree.n) + at)
    if not len(key):
        return (np.zeros(0, np.int64),) * 3
    cuts = np.flatnonzero(np.diff(key) != 1) + 1
    first, last = key[np.concatenate([[0], cuts])], key[np.concatenate([cuts - 1, [len(key) - 1]])]
    period, begin = first // (2 * tree.n), first % (2 * tree.n)
    return begin, last - first + 2 * period, period


def repeated_stretches(ids: np.ndarray, owner: np.ndarray, gram: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches whose words all lie in grams that their own stretch holds twice.

    owner tells the texts apart. What one pass leaves is looked at again until nothing goes.
    """
    start, end = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, parts = np.arange(len(ids)), owner.astype(np.int64)
    while len(held) >= gram:
        h = np.zeros(len(held) - gram + 1, np.uint64)
        for i in range(gram):
            h = (h ^ ids[held[i : len(held) - gram + 1 + i]].astype(np.uint64)) * _MIX
            h ^= h >> np.uint64(29)
        h = (h ^ parts[: len(h)].astype(np.uint64)) * _MIX
        inside = np.flatnonzero(parts[: len(h)] == parts[gram - 1 :])
        h = h[inside]
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        change = np.zeros(len(held) + 1, np.int64)
        np.add.at(change, inside[twice], 1)
        np.add.at(change, inside[twice] + gram, -1)
        covered = np.cumsum(change[:-1]) > 0
        opens = covered & ~(np.append(False, covered[:-1]) & np.append(False, parts[1:] == parts[:-1]))
        number = np.cumsum(opens)
        sizes = np.bincount(number[covered], minlength=int(number[-1]) + 1)
        keep = covered & (sizes[number] >= least)
        gone = len(held) - int(keep.sum())
        held, parts = held[keep], number[keep]
        if not gone:
            break
    if len(held) >= least:
        cuts = np.flatnonzero(np.diff(parts) != 0) + 1
        firsts = np.concatenate([[0], cuts])
        start, end = held[firsts], held[np.concatenate([cuts - 1, [len(held) - 1]])] + 1
    return start, end


def batch_runs(ids: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs of at least so many words, by text, start and period.

    ids: the words of the texts one after the other as numbers; sizes: how many each text has.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    a, b = repeated_stretches(ids, owner, -(-least // 2), least)
    if not len(a):
        return (np.zeros(0, np.int64),) * 4
    n = b - a + 1
    place = ranges(a, n)  # of each symbol among the words; the last of each stretch is its own end
    closing = np.cumsum(n) - 1
    symbols = ids[np.minimum(place, len(ids) - 1)].astype(np.int64)
    symbols[closing] = int(ids.max()) + 1 + np.arange(len(a))
    start, length, period = sequence_runs(symbols)
    long = length >= least
    at, length, period = place[start[long]], length[long], period[long]
    text = owner[at]
    at = at - (np.cumsum(sizes) - sizes)[text]
    order = np.lexsort((period, at, text))
    return text[order], at[order], length[order], period[order]


def tandem_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """Per row: id, n_words, runs array<struct<start, length, period>> by start and period, collapsed string.

    Words are those of common.WORD, numbered from 0. A run has at least max(least, 2 * period) words.
    collapsed: the words joined by one space, but those that a run holds after its first period. Null and
    empty texts have no words, no runs and an empty string. Every row gives one row, whether its id is null or
    shared; other columns do not matter.
    """
    ship(docs.sparkSession)

    def one(some: list[bytes]) -> tuple[list, list[int], list[bytes]]:
        # bytes.split() cuts at just the characters that are no part of a word.
        split = [t.split() for t in some]
        flat = [w for ws in split for w in ws]
        table = dict(zip(dict.fromkeys(flat), count()))
        ids = np.fromiter(map(table.__getitem__, flat), np.int32, len(flat))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        text, start, length, period = batch_runs(ids, sizes, least)
        bounds = np.searchsorted(text, np.arange(len(split) + 1))
        kept = []
        for i, ws in enumerate(split):
            a, b = bounds[i], bounds[i + 1]
            if a < b:
                change = np.zeros(len(ws) + 1, np.int64)
                np.add.at(change, start[a:b] + period[a:b], 1)
                np.add.at(change, start[a:b] + length[a:b], -1)
                dropped = np.cumsum(change[:-1]) > 0
                ws = [ws[x] for x in np.flatnonzero(~dropped)]
            kept.append(b" ".join(ws))
        runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs), sizes.tolist(), kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            for a, b in chunks(texts):
                runs, n, kept = one(texts[a:b])
                columns = [batch.column("id").slice(a, b - a), pa.array(n, pa.int64()), runs, pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])

    found = docs.select(id_text(docs, id_col).alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(
        run, "id string, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )
    return found.select(id_back(docs, id_col, F.col("id")).alias(id_col), "n_words", "runs", "collapsed")
