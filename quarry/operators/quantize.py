"""IVF with 8-bit scalar quantisation.

Every dimension gets 256 levels between its least and largest value in the
table (one aggregate). A vector is stored as one byte a dimension, a quarter of
32-bit floats, and the length of what rounding lost. A search scans the codes of
the probed lists only. The triangle inequality bounds the true distance,

    |q - decoded| - lost <= |q - x| <= |q - decoded| + lost,

so a passage whose lower bound is above the k-th smallest upper bound cannot be
among the k nearest; all others (k and a few more a question) are looked up
in the full vectors and ranked exactly. The result is that of the uncoded index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import retrieve as R
from quarry.session import materialize

LEVELS = 255


@dataclass
class CodedIndex:
    """``codes``: pid, cluster_id, code, lost; ``vectors``: pid, cluster_id,
    vec, read for the candidates only; ``low`` and ``step`` per dimension."""

    codes: DataFrame
    vectors: DataFrame
    centroids: DataFrame
    low: np.ndarray
    step: np.ndarray


def dimension_ranges(vectors: DataFrame, vec: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """Least value and distance of levels of each dimension, from one
    aggregate with one row a dimension."""
    x = F.col("x").cast("double")
    rows = (vectors.select(F.posexplode(vec).alias("i", "x")).groupBy("i")
            .agg(F.min(x).alias("low"), F.max(x).alias("high")).orderBy("i").collect())
    low = np.array([r["low"] for r in rows], float)
    return low, (np.array([r["high"] for r in rows], float) - low) / LEVELS


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def encode(vectors: DataFrame, low: np.ndarray, step: np.ndarray) -> DataFrame:
    """``vectors`` with ``code`` (a byte a dimension) and ``lost`` instead of ``vec``."""
    keep = [c for c in vectors.columns if c != "vec"]
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}

    def run(batches):
        dim = len(low)
        for batch in batches:
            x = _vectors(batch.column("vec"), dim)
            code = np.rint(np.divide(x - low, step, out=np.zeros_like(x), where=step > 0)).clip(0, LEVELS).astype(np.uint8)
            lost = np.sqrt(((x - (low + code * step)) ** 2).sum(axis=1))
            raw = pa.Array.from_buffers(pa.binary(dim), len(batch), [None, pa.py_buffer(np.ascontiguousarray(code))])
            yield pa.record_batch([*(batch.column(c) for c in keep), raw.cast(pa.binary()), pa.array(lost)],
                                  names=[*keep, "code", "lost"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "code binary", "lost double"])
    return vectors.select(*keep, "vec").mapInArrow(run, schema)


def build(vectors: DataFrame, centroids: DataFrame) -> CodedIndex:
    """The coded index of ``vectors`` (pid, cluster_id, vec)."""
    low, step = dimension_ranges(vectors)
    plain = vectors.select("pid", "cluster_id", "vec")
    return CodedIndex(encode(plain, low, step), plain, centroids, low, step)


class _Bounds:
    """Of each question's passages those that its k-th upper bound leaves."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.kth = np.full(n, np.inf)
        self.rows: list = [None] * n

    def offer(self, i: int, pid, low, high) -> None:
        if self.rows[i] is not None:
            pid, low, high = (np.concatenate(x) for x in zip(self.rows[i], (pid, low, high)))
        if len(high) >= self.k:
            self.kth[i] = np.partition(high, self.k - 1)[self.k - 1]
            keep = low <= self.kth[i]
            pid, low, high = pid[keep], low[keep], high[keep]
        self.rows[i] = (pid, low, high)


def _scan_codes(found: _Bounds, Q, pid, codes, lost, low, step) -> None:
    """Offer coded passages to all questions ``Q``, a tile of bounds at a time."""
    slack = 2 * 10.0 ** -R.SCORE_DIGITS   # equal after rounding counts as equal
    qn = (Q ** 2).sum(1)
    tile = max(1, R.TILE_BYTES // (8 * max(len(low), R.HELD_TILE)))
    for a in range(0, len(codes), tile):
        rows = slice(a, a + tile)
        x = low + codes[rows] * step
        xn, off = (x * x).sum(1), lost[rows] + 1e-9
        for b in range(0, len(Q), R.HELD_TILE):
            near = Q[b:b + R.HELD_TILE] @ x.T
            near *= -2
            near += qn[b:b + R.HELD_TILE, None]
            near += xn[None, :]
            np.sqrt(np.maximum(near, 0.0, out=near), out=near)
            # low <= kth, without squares: near - off <= sqrt(kth + slack)
            reach = np.sqrt(found.kth[b:b + R.HELD_TILE] + slack) * (1 + 1e-12) + 1e-12
            wanted = near <= reach[:, None] + off[None, :]
            for i in np.flatnonzero(wanted.any(axis=1)):
                w = wanted[i]
                least = np.maximum(near[i, w] - off[w], 0.0) ** 2 - slack
                found.offer(b + int(i), pid[rows][w], least, (near[i, w] + off[w]) ** 2)


def _coded_scan(low, step, k: int):
    """Candidates (qid, pid, low, high: bounds of the squared distance) of lists
    of held questions and the codes of their clusters."""
    def run(batches):
        here = found = None

        def left():
            full = [i for i, r in enumerate(found.rows) if r is not None] if found is not None else []
            for a in range(0, len(full), 4096):
                some = full[a:a + 4096]
                p, lo, hi = (np.concatenate([found.rows[i][c] for i in some]) for c in range(3))
                yield pa.record_batch({"qid": pa.array(np.repeat(qids[some], [len(found.rows[i][0]) for i in some])),
                                       "pid": pa.array(p), "low": pa.array(lo), "high": pa.array(hi)})

        for at, questions, batch in R._lists(batches):
            if at != here:
                yield from left()
                here, qids = at, R._ids(questions.column("qid").to_pandas())
                Q, found = R._arrow_matrix(questions.column("vec")), _Bounds(len(qids), k)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, len(low))
            _scan_codes(found, Q, R._ids(batch.column("pid").to_pandas()), codes,
                        batch.column("lost").to_numpy(), low, step)
        yield from left()
    return run


def candidates(index: CodedIndex, queries: DataFrame, k: int, nprobe: int = 1) -> DataFrame:
    """``qid, pid`` of the passages that the bounds leave. Tasks hold lists of
    questions past which the codes of the probed clusters move
    (``retrieve.held_lists``); the bounds of a question and probe come from one task."""
    small = R._model_fits(index.centroids)
    probes = materialize(R.ivf_probes(queries, index.centroids, nprobe, stream=small), "coded-probes")
    probed = probes.select("cluster_id").distinct()
    live = index.codes.join(F.broadcast(probed) if small else probed, "cluster_id", "left_semi")
    kinds = {"qid": queries.schema["qid"].dataType.simpleString(), "pid": index.codes.schema["pid"].dataType.simpleString()}
    part = R.held_lists(live.select("pid", "cluster_id", "code", "lost"), probes, small).mapInArrow(
        _coded_scan(index.low, index.step, k), f"qid {kinds['qid']}, pid {kinds['pid']}, low double, high double")
    if nprobe == 1:
        return part.select("qid", "pid")
    # a question stands once per probe, each with its own k smallest
    part = materialize(part, "coded-bounds")
    kth = (R.rank_topk(part, k, score="high", tie="pid", ascending=True)
           .groupBy("qid").agg(F.max("high").alias("kth"), F.count(F.lit(1)).alias("n")))
    slack = 2 * 10.0 ** -R.SCORE_DIGITS
    return (part.join(kth, "qid").filter((F.col("n") < k) | (F.col("low") <= F.col("kth") + slack))
            .select("qid", "pid"))


def coded_topk(index: CodedIndex, queries: DataFrame, k: int = 10, nprobe: int = 1) -> DataFrame:
    """``qid, rank, pid, score`` (squared L2), equal to ``ivf_topk``."""
    # a few rows a question: joined without a hint, since a broadcast is built in
    # the driver and these rows grow with the questions
    left = materialize(candidates(index, queries, k, nprobe), "coded-candidates")
    pairs = (index.vectors.select("pid", "vec").join(left, "pid")
             .join(queries.select("qid", F.col("vec").alias("qvec")), "qid"))
    far = F.aggregate(F.zip_with(F.col("vec").cast("array<double>"), F.col("qvec").cast("array<double>"),
                                 lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select("qid", "pid", far.alias("score"))
    return R.rank_topk(scored, k, tie="pid", ascending=True).select("qid", "rank", "pid", "score")
