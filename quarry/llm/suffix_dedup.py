"""Repeated byte strings by winnowed names, doubled once.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id. Strings are known by names (hashes, dealt into
buckets and compared there), first of ``half`` bytes, then by pairs of names at
offset length - half, which are names of ``length`` bytes; a place leaves as
soon as its name is unique or settled.

This is not prefix doubling in full: no (position, rank) pairs of all suffixes
are sorted, offsets do not grow and nothing is reranked. A row for every
position takes at least a rank and a position, 16 bytes for a byte of text, in
each round, where the disk limit is four bytes a byte of compressed input.

The first round takes a sample of the places only: of every ``length``
consecutive bytes the ``half``-byte string with the least hash. Equal strings
sample the same place, so a string whose sampled place is unique is unique.
With its name a place carries that of its surroundings (all bytes that strings
around it can reach): where a smaller document has equal surroundings, all
those strings are settled at once. Only the places left, whose name also
occurs with other surroundings, have all their strings compared in round two.

Round one takes two places for copies if 32 bits of the name and the 64-bit
hash of the surroundings (which hold the named bytes) are equal. Places of equal
names and m different surroundings give about m * m / 2**65 false copies, 4e-6
where one string lies in 12 million documents. Names that meet in their 32 bits
only add work. Round two knows a string by 64 bits: r compared strings in b
buckets give about r * r / (b * 2**65) false matches.

Very long texts: a text is taken whole; a task needs about 65 bytes of memory
for each byte of the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import firsts, frames, rolling
from quarry.session import materialize

LENGTH = 50
CHUNK_BYTES = 1 << 18
COPIED, UNSURE, REPEATED = 0, 1, 2
U = np.uint64


class Suffixes:
    """Names of the suffixes of some texts."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, length: int):
        half = (length + 1) // 2
        self.length, self.half, self.offsets = length, half, offsets
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.names = rolling.Slices(rolling.byte_values(raw))
        n = max(0, len(raw) - length + 1)
        self.valid = self.doc[:n] == self.doc[length - 1:] if n else np.zeros(0, bool)

    def sampled(self):
        """(name of the first half, places of the sample)."""
        if not self.valid.any():
            return np.zeros(0, U), np.zeros(0, np.int64)
        h = self.names.every(self.half)
        return h, np.flatnonzero(rolling.selected(h, self.valid, self.length - self.half + 1))

    def surroundings(self, at: np.ndarray) -> np.ndarray:
        """Names of all bytes that a string around the sampled place reaches."""
        doc = self.doc[at]
        low = np.maximum(at - (self.length - self.half), self.offsets[doc])
        high = np.minimum(at + self.length, self.offsets[doc + 1])
        return rolling.mix(self.names.of(low, high) + (at - low).astype(U))

    def choosing(self, h: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Starts of the strings whose sampled place is one of ``places``."""
        width = self.length - self.half + 1
        own = np.full(len(h), U(0xFFFFFFFFFFFFFFFF))
        own[places] = h[places]
        least = rolling.sliding(h, width, np.minimum)
        return np.flatnonzero((rolling.sliding(own, width, np.minimum) == least) & self.valid)

    def doubled(self, at: np.ndarray, base_names: "rolling.Slices | None" = None) -> np.ndarray:
        """Names of ``length`` bytes: the pair of two names of half the
        length, the second at offset length - half."""
        names = base_names or self.names
        first = names.of(at, at + self.half)
        second = names.of(at + self.length - self.half, at + self.length)
        return rolling.mix(first * U(rolling.BASES[1]) + second)


def _columns(batch):
    raw, offsets = frames.utf8(batch.column("text"))
    return raw, offsets, batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy().view(U)


def _sample(length: int, buckets: int, parts: int):
    def run(batches):
        def rows():
            held = firsts.Batch()
            for batch in batches:
                raw, offsets, ids, tags = _columns(batch)
                for i, j in frames.chunks(offsets, CHUNK_BYTES):
                    s = Suffixes(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], length)
                    base = held.add_docs(ids[i:j], tags[i:j], int(offsets[j] - offsets[i]))
                    h, at = s.sampled()
                    if len(at):
                        around = s.surroundings(at)
                        held.add(s.doc[at] + base, at - s.offsets[s.doc[at]], h[at],
                                 rolling.mix(h[at] + U(1)), around)
                    if held.bytes >= firsts.BATCH_BYTES:
                        yield from held.rows(buckets, parts, COPIED)
                        held = firsts.Batch()
            yield from held.rows(buckets, parts, COPIED)
        yield from firsts.to_batches(rows())
    return run


def _rank_sample(key, ids, around):
    """Judge of round one: copied surroundings, and places to look at again."""
    order = np.lexsort((around, key))
    k, a, d = key[order], around[order], ids[order]
    new_key = np.r_[True, k[1:] != k[:-1]]
    new_pair = new_key | np.r_[True, a[1:] != a[:-1]]
    pair = np.cumsum(new_pair) - 1
    group = np.cumsum(new_key) - 1
    least = np.minimum.reduceat(d, np.flatnonzero(new_pair))[pair]
    kinds = np.add.reduceat(new_pair.astype(np.int64), np.flatnonzero(new_key))[group]
    low = np.minimum.reduceat(d, np.flatnonzero(new_key))[group]
    high = np.maximum.reduceat(d, np.flatnonzero(new_key))[group]
    copied, unsure = np.empty(len(k), bool), np.empty(len(k), bool)
    copied[order] = d > least
    unsure[order] = (d == least) & (kinds > 1) & (low < high)
    return [(COPIED, copied), (UNSURE, unsure)]


def _double(length: int, buckets: int, parts: int):
    """Round two: pairs of names of the strings whose place is unsure."""
    def work(groups):
        def rows():
            held = firsts.Batch()
            for ids, tags, raw, offsets, found in groups:
                want = np.array([UNSURE in found.get((i, t), ()) for i, t in zip(ids.tolist(), tags.tolist())], bool)
                for k in np.flatnonzero(want).tolist():
                    part = raw[offsets[k]:offsets[k + 1]]
                    s = Suffixes(part, np.array([0, len(part)]), length)
                    h, _ = s.sampled()
                    places = np.concatenate(found[int(ids[k]), int(tags[k])][UNSURE])
                    at = s.choosing(h, places)
                    base = held.add_docs(ids[k:k + 1], tags[k:k + 1], len(part))
                    other = rolling.Slices(rolling.byte_values(part), rolling.BASES[1])
                    held.add(np.full(len(at), base), at, s.doubled(at), s.doubled(at, other))
                    if held.bytes >= firsts.BATCH_BYTES // 2:
                        yield from held.rows(buckets, parts, REPEATED)
                        held = firsts.Batch()
            yield from held.rows(buckets, parts, REPEATED)
        yield from firsts.to_batches(rows())
    return work


_REMOVED = "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<start:long,end:long>>"


def removed_bytes(n: int, found: dict | None, length: int) -> np.ndarray:
    """Mask of the bytes of a text that its reports cover."""
    half = (length + 1) // 2
    edge = np.zeros(n + 1, np.int64)
    if found:
        if COPIED in found:
            at = np.concatenate(found[COPIED])
            np.add.at(edge, np.maximum(at - (length - half), 0), 1)
            np.add.at(edge, np.minimum(at + length, n), -1)
        if REPEATED in found:
            at = np.concatenate(found[REPEATED])
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:n]) > 0


def _apply(length: int):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(groups):
        for ids, tags, raw, offsets, found in groups:
            for i, j in frames.chunks(offsets, 8 * CHUNK_BYTES):
                out = []
                for k in range(i, j):
                    part = raw[offsets[k]:offsets[k + 1]]
                    reports = found.get((int(ids[k]), int(tags[k])))
                    spans, kept, gone = [], part, 0
                    if reports and (COPIED in reports or REPEATED in reports):
                        mask = removed_bytes(len(part), reports, length)
                        gone = int(mask.sum())
                        kept = part[~mask]
                        edges = np.flatnonzero(np.diff(np.r_[False, mask, False]))
                        spans = [{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()]
                    out.append((int(ids[k]), len(part), gone, kept.tobytes(), spans))
                cols = list(zip(*out))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (
                    pa.int64(), pa.int64(), pa.int64(), pa.binary(), spans_type))],
                    names=["doc_id", "n_bytes", "n_removed", "kept", "spans"])
    return work


def remove_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, kept, spans`` for every row of ``docs``:
    the remaining bytes of the text's UTF-8 form and the removed intervals.

    Strings are judged on the input and lie within one text. ``kept`` is
    binary, as a removal may cut a character. A null text is empty. A null id
    counts as the largest and comes back as null; rows that repeat an id do
    not remove from each other. No rows give no rows; other columns of
    ``docs`` are not read.
    """
    if length < 4:
        raise ValueError("length must be at least 4")
    parts = firsts.partitions_for(docs)
    buckets = 2 * parts
    keyed = frames.keyed(docs, frames.HIGHEST)
    sample = keyed.mapInArrow(frames.lean(_sample(length, buckets, parts)), firsts.ROW)
    first = materialize(firsts.buckets(sample, parts, _rank_sample, parts), "suffix-ranks")
    frames.release(docs.sparkSession)
    unsure = first.filter(F.col("kind") == UNSURE)
    pairs = firsts.with_texts(keyed, unsure, parts, _double(length, buckets, parts), firsts.ROW)
    second = materialize(firsts.buckets(pairs, parts, firsts.seen_before(REPEATED), parts), "suffix-pairs")
    frames.release(docs.sparkSession)
    reports = first.filter(F.col("kind") == COPIED).unionByName(second)
    out = firsts.with_texts(keyed, reports, parts, _apply(length), _REMOVED)
    return out.select(frames.restore_null(frames.HIGHEST), "n_bytes", "n_removed", "kept", "spans")
