"""Detection of periodic runs of words, by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) that no neighbouring word extends. For every document:

1. The suffix automaton of its words is built; its suffix links form a tree
   in which the path from a prefix to the root holds all suffixes of the prefix.
2. The prefixes are accessed in order in a link-cut tree over the links. The
   access of the prefix that ends at word i recolours its path with i. Each
   preferred path that it passes holds one colour, the end j of the last
   occurrence, down to a deepest state of ``length`` words: the words ending at
   i and at j agree on exactly ``length`` words.
3. Where the distance d = i - j is at most ``length``, a square with period d
   ends at i, and period d reaches exactly ``length + d`` words to the left. If
   word i + 1 does not go on, this is a run: an older end would give a
   shorter agreement, and a smaller period of the same stretch would have a
   later end, so d is its smallest period.

A stretch that can hold no run of the wanted size is left out first, exactly:
every word of a run of at least ``max(least, power * q)`` words is covered by a
gram that occurs twice in the document (``gram_words`` picks its size), so
stretches that such grams do not cover hold none, and the covered stretches are
independent of each other. The grams are compared by 64-bit hashes; equal
hashes of different grams only add work.

Scale. Documents are independent: one pass, no shuffle. Per text byte a task
holds the words of one document; the automaton and tree take up to about 400
bytes a word of a covered stretch. A null text has no words. A null ``doc_id``
counts as the empty id. Repeated rows give equal results, no rows none; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import frames

SPLIT_BYTES = 4 << 20


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of ``words``: per state the length of its longest
    string and its suffix link, and the state of every prefix. State 0 is the
    start. Most states have one way out: it is kept in two lists, and in a
    dictionary only where there are more."""
    length, link = [0], [-1]
    by, to = [-1], [-1]  # the first way out of a state
    more: dict[int, dict[int, int]] = {}
    prefixes = []
    last = 0
    for n, w in enumerate(words):
        new = len(length)
        length.append(n + 1)
        link.append(0)
        by.append(-1)
        to.append(-1)
        prefixes.append(new)
        p, q = last, -1
        while p >= 0:
            if by[p] == w:
                q = to[p]
                break
            if by[p] < 0:
                by[p], to[p] = w, new
            else:
                ways = more.get(p)
                if ways is None:
                    more[p] = {w: new}
                elif w in ways:
                    q = ways[w]
                    break
                else:
                    ways[w] = new
            p = link[p]
        last = new
        if p < 0:
            continue
        if length[q] == length[p] + 1:
            link[new] = q
            continue
        clone = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        by.append(by[q])
        to.append(to[q])
        if q in more:
            more[clone] = dict(more[q])
        link[q] = link[new] = clone
        while p >= 0:
            if by[p] == w:
                if to[p] != q:
                    break
                to[p] = clone
            else:
                ways = more.get(p)
                if ways is None or ways.get(w) != q:
                    break
                ways[w] = clone
            p = link[p]
    return length, link, prefixes


class AccessTree:
    """Link-cut tree over fixed links. A preferred path is a splay tree in the
    order of depth whose nodes share one colour, kept at its root."""

    def __init__(self, link: list[int]):
        n = len(link)
        self.up = [x if x >= 0 else -1 for x in link]  # parent in the splay tree, or of the path's top
        self.low = [-1] * n   # nodes above on the path
        self.high = [-1] * n  # nodes below
        self.colour = [-1] * n

    def access(self, v: int, colour: int) -> list[tuple[int, int]]:
        """Give the path from the root to ``v`` this colour. Returns, for
        every path passed that had one, its old colour and deepest node."""
        up, low, high, colours = self.up, self.low, self.high, self.colour
        seen = []
        below = -1
        u = v
        while u >= 0:
            # splay u to the root of its tree
            p = up[u]
            while p >= 0 and (low[p] == u or high[p] == u):
                g = up[p]
                if g >= 0 and low[g] == p:
                    side = 0
                elif g >= 0 and high[g] == p:
                    side = 1
                else:  # p is the root: one rotation ends it
                    colours[u] = colours[p]
                    if low[p] == u:
                        x = high[u]
                        low[p] = x
                        high[u] = p
                    else:
                        x = low[u]
                        high[p] = x
                        low[u] = p
                    if x >= 0:
                        up[x] = p
                    up[p] = u
                    up[u] = g
                    break
                top = up[g]
                if top >= 0:
                    if low[top] == g:
                        low[top] = u
                    elif high[top] == g:
                        high[top] = u
                    else:
                        colours[u] = colours[g]
                else:
                    colours[u] = colours[g]
                if side == 0:
                    if low[p] == u:  # zig-zig
                        x, y = high[p], high[u]
                        low[g], low[p] = x, y
                        high[p], high[u] = g, p
                        if x >= 0:
                            up[x] = g
                        if y >= 0:
                            up[y] = p
                        up[g], up[p] = p, u
                    else:  # zig-zag
                        x, y = low[u], high[u]
                        high[p], low[g] = x, y
                        low[u], high[u] = p, g
                        if x >= 0:
                            up[x] = p
                        if y >= 0:
                            up[y] = g
                        up[p] = up[g] = u
                elif high[p] == u:
                    x, y = low[p], low[u]
                    high[g], high[p] = x, y
                    low[p], low[u] = g, p
                    if x >= 0:
                        up[x] = g
                    if y >= 0:
                        up[y] = p
                    up[g], up[p] = p, u
                else:
                    x, y = high[u], low[u]
                    low[p], high[g] = x, y
                    high[u], low[u] = p, g
                    if x >= 0:
                        up[x] = p
                    if y >= 0:
                        up[y] = g
                    up[p] = up[g] = u
                up[u] = top
                p = top
            old = colours[u]
            if old >= 0:
                seen.append((old, u))
            cut = high[u]
            if cut >= 0:
                colours[cut] = old  # a path of its own from now on
            high[u] = below
            below = u
            u = up[u]
        colours[below] = colour
        return seen


def runs(words: list[int], least: int, power: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``max(least, power *
    period)`` words, ``power`` at least 2."""
    n = len(words)
    if n < least:
        return []
    length, link, prefixes = automaton(words)
    tree = AccessTree(link)
    found = []
    for i, state in enumerate(prefixes):
        for j, deepest in tree.access(state, i):
            d, same = i - j, length[deepest]
            size = same + d
            if d <= same and size >= power * d and size >= least and (i + 1 == n or words[i + 1] != words[i + 1 - d]):
                found.append((i + 1 - size, size, d))
    return found


def gram_words(least: int, power: int) -> int:
    """Words of a gram that any run of at least ``max(least, power * q)`` words
    must repeat wherever it lies in it: with q words apart, grams of g words
    cover the run and each has a copy in it if the run has 2q + g - 1 words or more."""
    return max(1, min(max(least, power * q) - 2 * q + 1 for q in range(1, least + 1)))


def covered(words: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """The maximal stretches [start, end) covered by grams that occur twice."""
    n = len(words) - gram + 1
    if n < 2:
        return []
    x = words.astype(np.uint64) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    for k in range(gram):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + x[k:k + n]
        h *= np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    depth = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + gram, minlength=len(words) + 1)
    inside = np.concatenate([[False], np.cumsum(depth[:-1]) > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def document_runs(words: list[bytes], least: int, power: int) -> list[tuple[int, int, int]]:
    """The runs of one document, by start, then period."""
    if len(words) < least:
        return []
    code: dict[bytes, int] = {}
    ids = [code.setdefault(w, len(code)) for w in words]
    if len(code) == len(ids):
        return []
    found = []
    for a, b in covered(np.array(ids, np.int64), gram_words(least, power)):
        found += [(a + s, size, q) for s, size, q in runs(ids[a:b], least, power)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeat_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's input: for a tenth of the ids the words from a place on
    repeat with a period, both drawn from the id."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a:a + p]
    return words[:a] + (tail * (-(-(n - a) // len(tail))))[:n - a]


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not found:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, size, q in found:
        depth[start + q] += 1
        depth[start + size] -= 1
    gone = np.cumsum(depth[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length/period; of equals the first start,
    then the smallest period."""
    if not found:
        return None
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


_SCHEMA = ("doc_id long, starts array<long>, lengths array<long>, periods array<long>, "
           "start long, length long, period long, collapsed binary")


def _detect(least: int, power: int, prepare):
    def run(batches):
        for batch in batches:
            raw, offsets = frames.utf8(batch.column("text"))
            data = memoryview(raw)
            for i, j in frames.chunks(offsets, SPLIT_BYTES):
                ids = batch.column("doc_id").slice(i, j - i)
                rows = []
                for doc_id, k in zip(ids.to_pylist(), range(i, j)):
                    words = bytes(data[offsets[k]:offsets[k + 1]]).split()
                    if prepare is not None:
                        words = prepare(words, doc_id)
                    found = document_runs(words, least, power)
                    best = strongest(found) or (None, None, None)
                    rows.append(([r[0] for r in found], [r[1] for r in found], [r[2] for r in found],
                                 *best, b" ".join(collapse(words, found))))
                lists = [pa.array([r[c] for r in rows], pa.list_(pa.int64())) for c in range(3)]
                numbers = [pa.array([r[c] for r in rows], pa.int64()) for c in range(3, 6)]
                yield pa.record_batch([ids, *lists, *numbers, pa.array([r[6] for r in rows], pa.binary())],
                                      names=["doc_id", "starts", "lengths", "periods", "start", "length", "period", "collapsed"])
    return frames.lean(run)


def find_runs(docs: DataFrame, least: int = 6, power: int = 4, prepare=None) -> DataFrame:
    """The periodic runs of every row of ``docs`` (doc_id, text).

    Words are runs of bytes other than space and \\t to \\r. A run counts from
    ``max(least, power * period)`` words (``power`` at least 2). Returns per row
    ``doc_id, starts, lengths, periods`` (every run, by start, then period),
    ``start, length, period`` (the run of the greatest length/period, null
    without runs) and ``collapsed``: the words, joined by a space, without
    those that a run holds after its first period. ``prepare(words, doc_id)``
    may change a document's words before. Null, empty and blank texts have no
    runs and an empty ``collapsed``; other columns of ``docs`` are not read, an
    empty table gives no rows and repeated rows give equal ones.
    """
    if power < 2 or least < 2:
        raise ValueError("least and power must be 2 or more")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_detect(least, power, prepare), _SCHEMA)
