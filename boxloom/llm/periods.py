"""Periodic runs of words, found with a grammar made by recompression.

A run is a stretch of words with smallest period q, at least ``max(SHORTEST, POWER * q)`` long, that no
neighbouring word extends with that period.

* Candidates lie on the harmonic grid: a run of length 4q or more with period q holds a multiple i of q with
  i, i + q, i + 2q and i + 3q inside it, so for each q only multiples of q are tried, n log n places a text.
  Places whose four words differ are no candidates.
* ``Grammar`` rewrites the words of many texts side by side by recompression: blocks of one symbol become one
  symbol, then pairs of symbols whose random bits are 0 and 1, in turn, until every text is one symbol.  Equal
  stretches are parsed alike but for a few symbols at their ends, at every level.
* How far words q apart agree, forwards and backwards, is a longest common extension of two places of the
  text.  The grammar answers it exactly: climb while both places begin a symbol and these are equal, go on, and at
  the first difference come down again; a block is passed in one step.  No suffix array is built.

A stretch has several periods only if the smallest divides the others (its length is at least four times each),
and its extent is the same for all of them, so the smallest period found for a pair (start, length) is its period.

Null and empty texts have no words and no runs.  Repeated rows are documents of their own.  Texts without a
candidate need no grammar.  Very long texts are handled whole; a task holds the texts of ``WORDS`` words at once, or one text.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_or_empty

SHORTEST, POWER = 6, 4
#: Words of the texts whose grammar is built together, extensions that are asked for at once, and grid places that are kept.
WORDS, QUERIES, GRID = 1 << 20, 1 << 18, 1 << 21


class Grammar:
    """A run-length grammar of ``words``: a separator, a text, a separator, a text, ..., a separator.

    ``words`` are numbers from 0; separators are negative and all different, so that no extension crosses them.
    Nodes of all levels lie end to end, level by level; level 0 has a node for each word.
    """

    def __init__(self, words: np.ndarray):
        rng = np.random.default_rng(7)
        symbols = words
        fresh = int(words.max(initial=-1)) + 1
        names, parents, firsts, lasts, left, right, widths = [], [], [np.full(len(words), -1)], [np.full(len(words), -1)], [], [], [np.ones(len(words), np.int64)]
        base, blocks = 0, True
        while True:
            n = len(symbols)
            inner = np.flatnonzero(symbols >= 0)
            if blocks:
                joined = (symbols[1:] == symbols[:-1]) & (symbols[1:] >= 0)
                head = np.append(True, ~joined)
            else:
                # two random bits make pairs 01; the other way round if there are more pairs 10
                bit = rng.integers(0, 2, fresh, dtype=np.int8)
                bits = np.where(symbols >= 0, bit[np.maximum(symbols, 0)], -1)
                pair = (bits[:-1] == 0) & (bits[1:] == 1)
                other = (bits[:-1] == 1) & (bits[1:] == 0)
                if other.sum() > pair.sum():
                    pair = other
                head = np.append(True, ~pair)
            group = np.cumsum(head) - 1
            first = np.flatnonzero(head)
            size = np.diff(np.append(first, n))
            last = first + size - 1
            new = symbols[first].copy()
            several = np.flatnonzero(size > 1)
            if len(several):
                # a block is named by its symbol and its size, a pair by its two symbols
                key = new[several].astype(np.int64) * (int(size.max()) + 1 if blocks else fresh) + (size[several] if blocks else symbols[last[several]])
                kinds, name = np.unique(key, return_inverse=True)
                new[several] = fresh + name
                fresh += len(kinds)
            names.append(symbols)
            parents.append(base + n + group)
            # copies of a symbol in its block from a node on, itself included, and up to it
            left.append(np.arange(n) - first[group] + 1 if blocks else np.ones(n, np.int64))
            right.append(last[group] - np.arange(n) + 1 if blocks else np.ones(n, np.int64))
            firsts.append(base + first)
            lasts.append(base + last)
            widths.append(np.add.reduceat(widths[-1], first) if n else widths[-1])
            done = not len(several) and not len(inner) or (len(new) == n and not ((new[1:] >= 0) & (new[:-1] >= 0)).any())
            base, symbols, blocks = base + n, new, not blocks
            if done:
                break
        names.append(symbols)
        parents.append(np.full(len(symbols), -1))
        left.append(np.ones(len(symbols), np.int64))
        right.append(np.ones(len(symbols), np.int64))
        self.symbol, self.parent, self.first, self.last, self.width = (np.concatenate(x) for x in (names, parents, firsts, lasts, widths))
        self.copies = {1: np.concatenate(right), -1: np.concatenate(left)}
        self.ends = {1: self.first, -1: self.last}
        self.levels = len(names)

    def extension(self, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """How many words from places x and y on agree, forwards (step 1) or backwards (step -1); x and y differ."""
        edge, copies = self.ends[step], self.copies[step]
        found = np.zeros(len(x), np.int64)
        open_, x, y = np.arange(len(x)), x.copy(), y.copy()
        down = np.zeros(len(x), bool)
        while len(open_):
            same = self.symbol[x] == self.symbol[y]
            # a difference: come down to the first (last) symbols below, or stop at the words
            down |= ~same
            below = edge[x]
            stop = ~same & (below < 0)
            lower = ~same & ~stop
            # agreement on the way up where both begin (end) a symbol of the next level: climb
            px, py = self.parent[x], self.parent[y]
            climb = same & ~down & (px >= 0) & (edge[px] == x) & (edge[py] == y)
            # other agreement: pass all copies that both have left
            go = same & ~climb
            times = np.minimum(copies[x], copies[y])
            found[open_[go]] += (times * self.width[x])[go]
            ahead = np.where(go, step * times, 0)
            x = np.where(lower, below, np.where(climb, px, x + ahead))
            y = np.where(lower, edge[y], np.where(climb, py, y + ahead))
            if stop.any():
                keep = ~stop
                open_, x, y, down = open_[keep], x[keep], y[keep], down[keep]
        return found


class _Grid:
    """Places (i, q) of the harmonic grid, ordered by their last word i + (POWER - 1) q; those of short texts are kept."""

    def __init__(self):
        self.n, self.at, self.period, self.last = 0, np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int64)

    @staticmethod
    def places(n: int, lowest: int, highest: int) -> tuple[np.ndarray, np.ndarray]:
        periods = np.arange(lowest, highest, dtype=np.int64)
        many = np.maximum((n - 1 - (POWER - 1) * periods) // periods + 1, 0)
        period = np.repeat(periods, many)
        return (np.arange(len(period)) - np.repeat(np.cumsum(many) - many, many)) * period, period

    def of(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Parts of the places of a text of n words."""
        most = n // POWER + 1
        if n * max(np.log(n), 1) <= GRID:
            if n > self.n:
                self.n = max(1024, 2 * n)
                at, period = self.places(self.n, 1, self.n // POWER + 1)
                order = np.argsort(at + (POWER - 1) * period, kind="stable")
                self.at, self.period = at[order].astype(np.int32), period[order].astype(np.int32)
                self.last = (at + (POWER - 1) * period)[order]
            end = np.searchsorted(self.last, n)
            yield self.at[:end], self.period[:end]
            return
        low = 1
        while low < most:
            high = min(most, low + max(1, GRID * low // n))
            yield self.places(n, low, high)
            low = high


_grid = _Grid()


def candidates(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid places whose POWER words, q apart, agree."""
    found = []
    for at, period in _grid.of(len(words)):
        for k in range(POWER - 1):
            ahead = at + k * period
            same = words[ahead] == words[ahead + period]
            at, period = at[same], period[same]
        if len(at):
            found.append((at.astype(np.int64), period.astype(np.int64)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text of word numbers: rows (start, length, period) of its runs, by start, then period."""
    none = np.empty((0, 3), np.int64)
    found = [none] * len(texts)
    tried = {k: c for k, t in enumerate(texts) if len(t) >= SHORTEST and len((c := candidates(t))[0])}
    if not tried:
        return found
    line, starts, parts = 0, {}, []
    for number, k in enumerate(tried):
        parts += [np.array([-1 - number]), texts[k].astype(np.int64)]
        starts[k] = line + 1
        line += 1 + len(texts[k])
    grammar = Grammar(np.concatenate([*parts, np.array([-1 - len(tried)])]))
    doc = np.repeat(np.fromiter(tried, np.int64), [len(c[0]) for c in tried.values()])
    offset = np.repeat(np.array([starts[k] for k in tried]), [len(c[0]) for c in tried.values()])
    at, period = (np.concatenate(x) for x in zip(*tried.values()))
    at = at + offset
    # neighbours on one grid mostly lie in one run: ask for the first of each row of neighbours, then for those it left open
    order = np.lexsort((at, period, doc))
    doc, at, period = doc[order], at[order], period[order]
    head = np.append(True, (np.diff(doc) != 0) | (np.diff(period) != 0) | (np.diff(at) != period[1:]))
    row = np.cumsum(head) - 1
    rows = [_stretches(grammar, at[head], period[head])]
    reach = (rows[0][:, 0] + rows[0][:, 1] - period[head])[row]
    left = ~head & (at >= reach)
    rows.append(_stretches(grammar, at[left], period[left]))
    stretch, q = np.concatenate(rows), np.concatenate([period[head], period[left]])
    whose = np.concatenate([doc[head], doc[left]])
    long = stretch[:, 1] >= np.maximum(SHORTEST, POWER * q)
    stretch, q, whose = stretch[long], q[long], whose[long]
    order = np.lexsort((q, stretch[:, 1], stretch[:, 0], whose))
    stretch, q, whose = stretch[order], q[order], whose[order]
    keep = np.append(True, (np.diff(stretch, axis=0) != 0).any(1))[: len(q)]
    stretch, q, whose = stretch[keep], q[keep], whose[keep]
    cuts = np.searchsorted(whose, np.arange(len(texts) + 1))
    for k in tried:
        part = slice(cuts[k], cuts[k + 1])
        table = np.column_stack([stretch[part, 0] - starts[k], stretch[part, 1], q[part]])
        found[k] = table[np.lexsort((table[:, 2], table[:, 0]))]
    return found


def _stretches(grammar: Grammar, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """(start, length) of the longest stretches around the places in which words one period apart agree."""
    out = np.empty((len(at), 2), np.int64)
    for k in range(0, len(at), QUERIES):
        i, q = at[k : k + QUERIES], period[k : k + QUERIES]
        back = grammar.extension(i - 1, i + q - 1, -1)
        out[k : k + QUERIES] = np.column_stack([i - back, back + q + grammar.extension(i, i + q, 1)])
    return out


def collapsed(n: int, table: np.ndarray) -> np.ndarray:
    """Which of n words stay when every run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, table[:, 0] + table[:, 2], 1)
    np.add.at(change, table[:, 0] + table[:, 1], -1)
    return np.cumsum(change)[:n] == 0


# ---- on tables

_OUT = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
#: Takes a document's mark and its words, gives the words to look at.
Change = Callable[[int, list], list]


def with_tail(mark: int, words: list) -> list:
    """Every tenth document gets a periodic tail, as its mark (a checksum of its id) says."""
    g, n = mark // 10, len(words)
    if mark % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * (-(-(n - a) // p)))[: n - a]


def find(docs: DataFrame, text_col: str = "text", mark: Column | None = None, change: Change | None = None, collapse_col: str | None = None) -> DataFrame:
    """The input's columns but the text, and the columns of ``_OUT``; with ``collapse_col`` also the text without repeats.

    ``change`` may alter the words of a text first; it also gets the long ``mark`` of the row.
    """
    kept = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(kept)], F.lit(0).alias("none")).alias("row"), (F.lit(0) if mark is None else mark).cast("long").alias("mark"), text_or_empty(text_col).alias("text"))
    shape = rows.schema["row"].dataType.simpleString()
    more = "text string, " if collapse_col else ""

    def handle(part: list[tuple[int, str]]) -> Iterator[list]:
        numbers: dict = defaultdict(count().__next__)
        texts, coded = [], []
        for m, text in part:
            words = text.encode().split()
            words = change(m, words) if change else words
            texts.append(words)
            coded.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        for words, table in zip(texts, runs(coded)):
            stay = collapsed(len(words), table)
            text = b" ".join(words if stay.all() else [words[k] for k in np.flatnonzero(stay)])
            best = [None] * 4
            if len(table):
                s, length, q = max(table.tolist(), key=lambda r: (r[1], -r[0], -r[2]))
                best = [s, length, q, 1000 * length // q]
            listed = "".join(f"{a},{b},{c}\n" for a, b, c in table.tolist())
            cells = [len(table), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()]
            yield ([text.decode()] if collapse_col else []) + cells

    types = ([pa.string()] if collapse_col else []) + [pa.int64()] * 5 + [pa.string()] * 2
    names = (["text"] if collapse_col else []) + [c.split()[0] for c in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            weights = np.cumsum([len(t) // 6 + 1 for t in batch.column(2).to_pylist()]) if batch.num_rows else np.empty(0)
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(weights, (weights[low - 1] if low else 0) + WORDS)))
                part = batch.slice(low, high - low)
                out = list(handle(list(zip(part.column(1).to_pylist(), part.column(2).to_pylist()))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), types))], names=["row", *names])
                low = high

    found = rows.mapInArrow(run, f"row {shape}, {more}{_OUT}")
    text = [F.col("text").alias(collapse_col)] if collapse_col else []
    return found.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(kept)], *text, *[c.split()[0] for c in _OUT.split(", ")])
