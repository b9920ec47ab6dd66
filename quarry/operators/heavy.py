"""Heaviest terms of weighted rows without shuffling every term.

Each task keeps a summary of at most ``capacity`` term hashes: counts are
added up, and when there are more hashes than that the next largest count is
taken off all of them and what reaches zero goes. A hash's count in the
summary is then at most the true one and short of it by at most the total
taken off, whether the hash is in the summary or not. Both numbers add up
over tasks, so the summaries merge by a sum per hash (the mergeable form of
the Misra-Gries summary).

The ``k``-th largest merged count is a floor under the answer's counts. Terms
whose count plus the total taken off is below it cannot be in the answer; the
others are counted exactly, and the exact ``k``-th count confirms the floor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.sizing import maybe_broadcast
from quarry.session import materialize

#: Term hashes a task keeps for each term asked for (16 bytes each, some
#: copies while merging). With words spread as in prose the k-th count then
#: stays above what the summaries lose.
KEPT_PER_TERM = 32


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(counts, starts)


def cut(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """At most ``capacity`` of the keys, and what was taken off every count."""
    extra = len(keys) - capacity
    if extra <= 0:
        return keys, counts, 0
    off = int(np.partition(counts, extra - 1)[extra - 1])
    left = counts > off
    return keys[left], counts[left] - off, off


def summaries(capacity: int):
    """A task's summary of batches ``h, n`` (long), for :func:`settled`."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(keys, counts, taken):
            for i in range(0, len(keys), 1 << 16):
                yield pa.record_batch({"h": keys[i:i + (1 << 16)], "n": counts[i:i + (1 << 16)]})
            if taken:
                yield pa.record_batch({"h": pa.array([None], pa.int64()), "n": pa.array([taken], pa.int64())})

        keys = counts = np.empty(0, np.int64)
        taken, waiting, held = 0, [], 0
        for b in batches:
            waiting.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)))
            held += b.num_rows
            if held >= capacity:
                keys, counts, off = _added(keys, counts, waiting, capacity)
                taken, waiting, held = taken + off, [], 0
        keys, counts, off = _added(keys, counts, waiting, capacity)
        yield from rows(keys, counts, taken + off)
    return run


def _added(keys, counts, waiting, capacity):
    keys, counts = merged(np.concatenate([keys] + [w[0] for w in waiting]),
                          np.concatenate([counts] + [w[1] for w in waiting]))
    return cut(keys, counts, capacity)


def term_hash(term: str) -> Column:
    """What a summary knows a term by."""
    return F.xxhash64(term)


def summary(rows: DataFrame, capacity: int) -> DataFrame:
    """``h, n`` of rows ``term, tf`` (``tf`` positive): per term hash a count
    that is not above the true one; the row with a null ``h`` holds the most
    that any hash's count can be short of it (no such row: none is short)."""
    hashed = rows.select(term_hash("term").alias("h"), F.col("tf").cast("long").alias("n"))
    return (hashed.mapInArrow(summaries(capacity), "h long, n long")
            .groupBy("h").agg(F.sum("n").alias("n")))


def _exact(rows: DataFrame, k: int) -> DataFrame:
    return (rows.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
            .orderBy(F.desc("cf"), F.asc("term")).limit(k))


def _least(top: DataFrame, column: str, k: int) -> int:
    """The ``k``-th largest value, 0 where there are fewer rows."""
    r = top.agg(F.count(F.lit(1)).alias("rows"), F.min(column).alias("least")).first()
    return int(r["least"]) if r["rows"] >= k else 0


def top_terms(rows: DataFrame, k: int, capacity: int | None = None, n_rows: int | None = None) -> DataFrame:
    """The ``k`` terms of largest total ``tf`` (ties: smallest term) of rows
    ``term, tf`` as ``term, cf, df`` (``df``: rows of the term), written to the
    shared folder. Exact, also when terms share a hash.

    ``capacity`` hashes a task (default: ``KEPT_PER_TERM`` times ``k``) are
    kept. ``rows`` is read up to four times: give a stored table. Rows with a
    null term are left out; no rows give no rows; ``tf`` has to be positive.
    All terms are counted in one plain aggregate where tasks have no more rows
    than a summary holds (it would keep every term), where the summaries rule
    out no term (the k-th count is not above what was taken off) and where
    they leave more candidates than may be broadcast. ``n_rows``: the number of
    rows, where it is known; else they are counted.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    capacity = capacity or KEPT_PER_TERM * k
    rows = rows.filter(F.col("term").isNotNull()).select("term", "tf")
    if (rows.count() if n_rows is None else n_rows) <= capacity * rows.rdd.getNumPartitions():
        return materialize(_exact(rows, k), "heavy-terms")
    def exact(keys):
        return _exact(rows if keys is None else rows.join(keys, term_hash("term") == F.col("h"), "left_semi"), k)
    return settled(summary(rows, capacity), exact, k)


def settled(bounds: DataFrame, exact: Callable, k: int) -> DataFrame:
    """The ``k`` heaviest terms, from summaries ``h, n`` (see :func:`summary`) and
    ``exact(keys)``: the ``k`` heaviest of the terms whose hash is in ``keys`` (a
    frame ``h`` that measures small; None: of all terms) as ``term, cf, df``."""
    bounds = materialize(bounds, "heavy-summary")
    lost = bounds.filter(F.col("h").isNull()).first()
    short = int(lost["n"]) if lost else 0
    known = bounds.filter(F.col("h").isNotNull())
    floor = _least(known.orderBy(F.desc("n")).limit(k), "n", k)
    while floor > short:
        keys, small = maybe_broadcast(known.filter(F.col("n") + F.lit(short) >= floor).select("h"))
        if not small:
            break
        top = materialize(exact(keys), "heavy-terms")
        least = _least(top, "cf", k)
        if least >= floor:
            return top
        # terms that share a hash had raised the floor: once more under the
        # exact count, which cannot fall again
        floor = least
    return materialize(exact(None), "heavy-terms")
