"""Packing token sequences: first-fit decreasing with a tournament tree.

Every document is tokenised and closed by an end id; a document longer than a
sequence is cut into full sequences and a rest. The rests are packed in
randomised groups, each on its own: longest first, each into the first
sequence that has room. A tournament tree over the sequences' free room finds
that one in logarithmic time. Sequences that stay emptier than the room left
in the others are then dissolved: their pieces are cut to fill gaps of at
least ``least_cut`` ids.

Scale. One shuffle, of the ids in two bytes each where the vocabulary allows.
A group has about ``group_docs`` documents at any size of the input; full
sequences of long documents are dealt out one by one, so neither a long
document nor a hot source loads a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import frames, rolling, tokens

SEQUENCE = 2048
GROUP_DOCS = 1024
LEAST_CUT = 32
CHUNK_BYTES = 1 << 20


class Tournament:
    """The free room of ``n`` sequences; each inner node holds the largest
    room below it."""

    def __init__(self, n: int, room: int):
        self.leaves = 1
        while self.leaves < n:
            self.leaves *= 2
        self.room = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first sequence with room for ``size``, which it takes."""
        room, i = self.room, 1
        if room[1] < size:
            raise ValueError("no sequence has room")
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        found = i - self.leaves
        room[i] -= size
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return found


def pack(sizes: list[int], sequence: int, least_cut: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length): every item's ids 0 ..
    size-1 lie in exactly one piece, no sequence has more than ``sequence``."""
    tree = Tournament(len(sizes), sequence)
    bins: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if sizes[item]:
            bins[tree.place(sizes[item])].append((item, 0, sizes[item]))
    bins = [b for b in bins if b]
    bins.sort(key=lambda b: -sum(p[2] for p in b))
    free = [sequence - sum(p[2] for p in b) for b in bins]
    while len(bins) > 1:
        moves = _fill(bins[-1], free[:-1], least_cut)
        if moves is None:
            break
        bins.pop()
        free.pop()
        for at, piece in moves:
            bins[at].append(piece)
            free[at] -= piece[2]
    return bins


def _fill(pieces: list[tuple[int, int, int]], free: list[int], least_cut: int):
    """Cuts of ``pieces`` for the gaps of at least ``least_cut``, as (gap,
    piece); None if they have no room."""
    moves, gaps, at, room = [], [g for g, f in enumerate(free) if f >= least_cut], -1, 0
    for item, start, length in pieces:
        while length:
            if room < least_cut:
                at += 1
                if at == len(gaps):
                    return None
                room = free[gaps[at]]
            take = min(length, room)
            moves.append((gaps[at], (item, start, take)))
            start, length, room = start + take, length - take, room - take
    return moves


def _numbers(keys: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """The number of each key among its equals so far; ``seen`` counts them."""
    out = np.empty(len(keys), np.uint64)
    for i, key in enumerate(keys.tolist()):
        out[i] = n = seen.get(key, 0)
        seen[key] = n + 1
    return out


def _deal(path: str, sequence: int, groups: int, seed: int):
    def deal(batches):
        tokenizer = tokens.load(path)
        seen: dict[int, int] = {}
        for batch in batches:
            _, offsets = frames.utf8(batch.column("text"))
            for i, j in frames.chunks(offsets, CHUNK_BYTES):
                ids, at = tokenizer.encode(batch.column("text").slice(i, j - i).to_pylist())
                n = np.diff(at)
                pieces = -(-n // sequence)
                row = np.repeat(np.arange(len(n)), pieces)
                k = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = k * sequence
                length = np.minimum(sequence, n[row] - start)
                doc = batch.column("doc_id").slice(i, j - i)
                tag = batch.column("tag").slice(i, j - i).to_numpy().view(np.uint64)
                own = rolling.mix(tag + rolling.mix(pc.fill_null(doc, frames.HIGHEST).to_numpy().view(np.uint64)))
                h = rolling.mix(own[row] + np.uint64(seed) + _numbers(own, seen)[row] * np.uint64(0xBF58476D1CE4E5B9)
                                + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                data = memoryview(ids.tobytes())
                w = ids.dtype.itemsize
                begin = (at[:-1][row] + start) * w
                yield pa.record_batch(
                    [pa.array((h % np.uint64(groups)).astype(np.int32)), doc.take(pa.array(row)),
                     pa.array(n[row]), pa.array(start),
                     pa.array([data[a:b] for a, b in zip(begin.tolist(), (begin + length * w).tolist())], pa.binary())],
                    names=["grp", "doc_id", "doc_tokens", "start", "ids"])
        tokenizer.rest()
    return frames.lean(deal)


def _pack_group(sequence: int, least_cut: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        # an order of the rows that does not depend on how they arrived
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")])
        group = table.column("grp")[0].as_py()
        ids = table.column("ids").to_pylist()
        doc, total = table.column("doc_id").to_pylist(), table.column("doc_tokens").to_pylist()
        start = table.column("start").to_pylist()
        rows = []
        for b, pieces in enumerate(pack([len(x) // width for x in ids], sequence, least_cut)):
            offset = 0
            for item, a, n in pieces:
                part = np.frombuffer(ids[item][a * width:(a + n) * width], f"<u{width}")
                rows.append((doc[item], start[item] + a, n, part.astype("<u4").tobytes(),
                             total[item], (group << 32) + b, offset))
                offset += n
        cols = list(zip(*rows))
        return pa.table([pa.array(c, t) for c, t in zip(cols, (
            pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
    return run


def pack_documents(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE,
                   group_docs: int = GROUP_DOCS, least_cut: int = LEAST_CUT, seed: int = 0) -> DataFrame:
    """Pieces of the tokenised ``docs`` in sequences of at most ``sequence``.

    Returns ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``:
    ids are little-endian unsigned 32-bit numbers, start counts the document's
    ids before the piece, offset those before it in its sequence. A null or
    empty text is a document of the end id alone. Rows that repeat a doc_id
    are separate documents; null ids stay null. No rows give no pieces; other
    columns are not read. A piece's group follows from its document's id and
    text, its place and the row's number among equal rows of its task, not from
    the order of the rows, so a task that is run again deals as before. A task
    holds a number for each of its documents and about a megabyte of texts (or one
    longer text) with its ids.
    """
    groups = max(1, -(-docs.count() // group_docs))
    if groups >= 1 << 31:
        raise ValueError("too many groups: raise group_docs")
    width = tokens.load(tokenizer).dtype.itemsize
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), frames.text_tag().alias("tag"),
                       F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.mapInArrow(_deal(tokenizer, sequence, groups, seed),
                            "grp int, doc_id long, doc_tokens long, start long, ids binary")
    return dealt.groupBy("grp").applyInArrow(
        _pack_group(sequence, least_cut, width),
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
