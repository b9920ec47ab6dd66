"""Substring deduplication: repeated windows of a fixed number of words.

Rabin-Karp hashes of every window of ``window`` consecutive words are compared
over all documents (see ``firsts``); a window that a document with a smaller
id also has is removed, and removed windows that touch merge into maximal
intervals of words.

Windows are known by 64 bits of hash within buckets chosen by a second,
independent hash: with n windows and b buckets about n * n / (b * 2**65)
windows are expected to be taken for another, 1e-5 at 10**8 windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import firsts, frames, rolling
from quarry.session import materialize

WINDOW_WORDS = 13
CHUNK_BYTES = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SETTLED, REPEATED = 0, 1


def word_bounds(raw: np.ndarray, offsets: np.ndarray):
    """(start, end) of every word and the words before each text."""
    inside = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def _scan(window: int, buckets: int, parts: int):
    def run(batches):
        def rows():
            held = firsts.Batch()
            for batch in batches:
                raw, offsets = frames.utf8(batch.column("text"))
                ids = batch.column("doc_id").to_numpy()
                tags = batch.column("tag").to_numpy().view(np.uint64)
                for i, j in frames.chunks(offsets, CHUNK_BYTES):
                    part, at = raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                    base = held.add_docs(ids[i:j], tags[i:j], len(part))
                    start, end, words = word_bounds(part, at)
                    doc = np.repeat(np.arange(j - i), np.diff(words))
                    n = len(doc) - window + 1
                    if n > 0:
                        values = rolling.Slices(rolling.byte_values(part)).of(start, end)
                        whole = np.flatnonzero(doc[:n] == doc[window - 1:])
                        key = rolling.Slices(values).every(window)[whole]
                        spread = rolling.Slices(values, rolling.BASES[1]).every(window)[whole]
                        held.add(doc[whole] + base, whole - words[:-1][doc[whole]], key, spread)
                    if held.bytes >= firsts.BATCH_BYTES:
                        yield from held.rows(buckets, parts, SETTLED)
                        held = firsts.Batch()
            yield from held.rows(buckets, parts, SETTLED)
        yield from firsts.to_batches(rows())
    return run


_REMOVED = "doc_id long, n_words long, n_removed long, kept binary, spans array<struct<start:long,end:long>>"


def _apply(window: int):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(groups):
        for ids, tags, raw, offsets, found in groups:
            for i, j in frames.chunks(offsets, CHUNK_BYTES):
                part, at = raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                start, end, words = word_bounds(part, at)
                data = part.tobytes()
                start, end = start.tolist(), end.tolist()
                out = []
                for k in range(i, j):
                    a, b = int(words[k - i]), int(words[k - i + 1])
                    flags = found.get((int(ids[k]), int(tags[k])))
                    spans = []
                    keep = range(a, b)
                    if flags:
                        gone = firsts.covered(b - a, np.concatenate([p for v in flags.values() for p in v]), window)
                        keep = (np.flatnonzero(~gone) + a).tolist()
                        edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                        spans = [{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()]
                    kept = b" ".join([data[start[w]:end[w]] for w in keep])
                    out.append((int(ids[k]), b - a, b - a - len(keep), kept, spans))
                cols = list(zip(*out))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (
                    pa.int64(), pa.int64(), pa.int64(), pa.binary(), spans_type))],
                    names=["doc_id", "n_words", "n_removed", "kept", "spans"])
    return work


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, spans`` for every row of ``docs``:
    the kept words joined by one space, and the removed intervals of words.

    Words are runs without ASCII white space. Windows are judged on the input.
    A null text has no words. A null id counts as the largest and comes back
    as null; rows that repeat an id do not remove from each other. No rows
    give no rows; other columns of ``docs`` are not read. A text is taken whole: a
    task needs some tens of bytes for each byte of the longest text.
    """
    parts = firsts.partitions_for(docs)
    buckets = 2 * parts
    keyed = frames.keyed(docs, frames.HIGHEST)
    scanned = keyed.mapInArrow(frames.lean(_scan(window, buckets, parts)), firsts.ROW)
    reports = materialize(firsts.buckets(scanned, parts, firsts.seen_before(REPEATED), parts), "repeats")
    frames.release(docs.sparkSession)  # the shuffled windows are not needed any more
    out = firsts.with_texts(keyed, reports, parts, _apply(window), _REMOVED)
    return out.select(frames.restore_null(frames.HIGHEST), "n_words", "n_removed",
                      F.decode("kept", "UTF-8").alias("kept"), "spans")
