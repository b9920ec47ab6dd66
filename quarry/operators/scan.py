"""Sparse scores in the tasks that hold the documents.

A document is one row with its terms, so its score for a question is known where
the row is read. The question side (measured small before) is broadcast; a
task takes the documents that pass by in tiles, adds up the products of equal
terms and keeps the k best documents of each question. Only these are
shuffled: no (question, document) rows move, whatever the size of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6
CELLS = 1 << 20      # (document, question) scores of one tile
PAIRS = 1 << 21      # products of one tile, unless one document has more
ID_TYPES = ("string", "bigint", "int", "smallint", "tinyint")


@dataclass
class Side:
    """Questions by term: those of term i are ``q[starts[i]:starts[i + 1]]``
    with weights ``w``; ``qids`` in order; ``more``: further columns as ``w``."""

    terms: pa.Array
    starts: np.ndarray
    q: np.ndarray
    w: np.ndarray
    qids: pa.Array
    more: dict

    @property
    def n(self) -> int:
        return len(self.qids)


def by_term(rows: pa.Table, qid: str, weight: str, more: tuple[str, ...] = ()) -> Side:
    """Of rows ``qid, term, weight`` (not null), and columns ``more``, in any order."""
    rows = rows.sort_by([(qid, "ascending"), ("term", "ascending")]).combine_chunks()
    ids = pc.dictionary_encode(rows.column(qid).combine_chunks(), null_encoding="encode")
    terms = rows.column("term").combine_chunks().dictionary_encode()
    if isinstance(ids, pa.ChunkedArray):
        ids, terms = ids.combine_chunks(), terms.combine_chunks()
    code = terms.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(terms.dictionary)))])
    column = lambda c: rows.column(c).to_numpy()[order]
    return Side(terms.dictionary, starts, ids.indices.to_numpy(zero_copy_only=False)[order].astype(np.int64),
                column(weight), ids.dictionary, {c: column(c) for c in more})


def _places(names: pa.Array, terms: pa.Array) -> pa.Array:
    if pa.types.is_dictionary(names.type):     # each distinct term is looked up once
        return pc.index_in(names.dictionary, value_set=terms).take(names.indices)
    return pc.index_in(names, value_set=terms)


def products(lists: pa.Array, values: Callable, side: Side):
    """``first row, rows, cells, posting of cell, entry of side`` of tiles: the cell of
    (document, question) is row * questions + question. ``values(x, row)`` is
    what the second field of the terms is multiplied with; it comes along."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    code = pc.fill_null(_places(flat.field(0), side.terms), -1).to_numpy(zero_copy_only=False)
    hit = np.flatnonzero(code >= 0)
    row, code = np.repeat(np.arange(len(lists)), size)[hit], code[hit]
    x = values(flat.field(1).to_numpy(zero_copy_only=False)[hit].astype(np.float64), row)
    fan = side.starts[code + 1] - side.starts[code]
    made = np.concatenate([[0], np.cumsum(np.bincount(row, fan, minlength=len(lists)).astype(np.int64))])
    a = 0
    while a < len(lists):
        b = min(len(lists), a + max(1, CELLS // max(1, side.n)))
        b = max(a + 1, min(b, int(np.searchsorted(made, made[a] + PAIRS, "right")) - 1))
        lo, hi = np.searchsorted(row, [a, b])
        f = fan[lo:hi]
        one = np.repeat(np.arange(lo, hi), f)
        entry = np.arange(len(one)) - np.repeat(np.cumsum(f) - f, f) + side.starts[code[one]]
        yield a, b - a, (row[one] - a) * side.n + side.q[entry], x[one], entry
        a = b


class _Best:
    """The k best documents so far of each question: least key, then document
    id (null first)."""

    def __init__(self, n: int, k: int):
        self.k, self.kth, self.rows = k, np.full(n, np.inf), None

    def offer(self, q, key, score, ids: pa.Array) -> None:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(ids, "" if pa.types.is_string(ids.type) else 0).to_numpy(zero_copy_only=False)
        new = [q, key, score, known, ids.astype(str) if ids.dtype == object else ids]
        if self.rows is not None:
            new = [np.concatenate(c) for c in zip(self.rows, new)]
        order = np.lexsort((new[4], new[3], new[1], new[0]))
        q = new[0][order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        order = order[place < self.k]
        self.rows = [c[order] for c in new]
        last = place[place < self.k] == self.k - 1
        self.kth[self.rows[0][last]] = self.rows[1][last]


def _lists(batch, terms: str | Callable) -> pa.Array:
    return terms(batch) if callable(terms) else batch.column(terms)


def _text(column):
    return column.cast(pa.string()) if pa.types.is_large_string(column.type) else column


def topk(documents: DataFrame, terms: str | Callable, side: DataFrame, k: int, weight: str = "weight", values: Callable | None = None,
         pad: str | None = None, distance: bool = False, probes: DataFrame | None = None) -> DataFrame:
    """``qid, document_id, score``: a superset of the k best of each question,
    at most k a task.

    ``documents``: document_id and ``terms``, an array of structs (term, x), or what
    makes it of a batch; ``side`` (small): qid, term, weight. The score is the sum of weight * x over equal terms,
    where ``values(batch)(x, row)`` may replace x; documents without a common
    term are left out, but for those whose column ``pad`` is true: they score 0.
    ``distance``: the score is 2 - 2 * sum, least first. ``probes`` (qid,
    cluster_id; small): only documents of these ``cluster_id`` count for a question."""
    spark = documents.sparkSession
    made = by_term(side.select("qid", "term", weight).toArrow(), "qid", weight)
    allowed = None
    if probes is not None:
        rows = probes.select("qid", "cluster_id").toArrow().combine_chunks()
        place = pc.index_in(rows.column("qid"), value_set=made.qids).to_numpy()
        clusters, at = np.unique(rows.column("cluster_id").to_numpy(), return_inverse=True)
        allowed = np.zeros((made.n, len(clusters) + 1), bool)      # the last column: clusters of no question
        allowed[place, at] = True
    bc = spark.sparkContext.broadcast((made, allowed, clusters if probes is not None else None))

    def run(batches):
        side, allowed, clusters = bc.value
        best = _Best(side.n, k)
        for batch in batches:
            if not batch.num_rows or not side.n:
                continue
            ids, fill = _text(batch.column("document_id")), None
            if pad:
                fill = pc.fill_null(batch.column(pad), False).to_numpy(zero_copy_only=False)
            if allowed is not None:
                own = batch.column("cluster_id").to_numpy()
                at = np.searchsorted(clusters, own)
                at = np.where(np.append(clusters, -1)[at] == own, at, len(clusters))
            value = values(batch) if values else lambda x, row: x
            for a, n, cell, x, entry in products(_lists(batch, terms), value, side):
                S = np.bincount(cell, x * side.w[entry], minlength=n * side.n)
                S = (2.0 - 2.0 * S if distance else S).reshape(n, side.n)
                live = np.zeros(n * side.n, bool)
                live[cell] = True
                live = live.reshape(n, side.n)
                if pad:
                    live |= fill[a:a + n, None]
                if allowed is not None:
                    live &= allowed[:, at[a:a + n]].T
                key = np.round(S if distance else -S, DIGITS)
                r, q = np.nonzero(live & (key <= best.kth))
                if len(r):
                    best.offer(q, key[r, q], S[r, q], ids.take(pa.array(a + r)))
        if best.rows is not None:
            q, _, score, known, ids = best.rows
            for i in range(0, len(q), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.record_batch([side.qids.take(pa.array(q[part])), pa.array(ids[part], mask=~known[part]),
                                       pa.array(score[part])], names=["qid", "document_id", "score"])

    kinds = {"qid": side.schema["qid"].dataType.simpleString(),
             "document_id": documents.schema["document_id"].dataType.simpleString()}
    return documents.drop("dkey").mapInArrow(run, f"qid {kinds['qid']}, document_id {kinds['document_id']}, score double")


def fits(*frames: tuple[DataFrame, str]) -> bool:
    """Whether the id columns are of types that numpy sorts as Spark does."""
    return all(df.schema[c].dataType.simpleString() in ID_TYPES for df, c in frames)


def nearest(documents: DataFrame, terms: str | Callable, centroids: DataFrame, bias: str | int, digits: int,
            values: Callable | None = None) -> DataFrame:
    """``documents`` (all columns) with ``cluster_id``: that of the largest sum
    of products plus the centroid's weight of the term ``bias`` (rounded to
    ``digits`` places; ties: the smaller cluster). ``centroids`` (small):
    cluster_id, term, c; ``terms`` and ``values`` as in :func:`topk`."""
    rows = centroids.select("cluster_id", "term", "c").toArrow()
    made = by_term(rows, "cluster_id", "c")
    flat = rows.filter(pc.equal(rows.column("term"), bias)).sort_by("cluster_id")
    bc = documents.sparkSession.sparkContext.broadcast((made, flat.column("c").to_numpy()))

    def run(batches):
        side, base = bc.value
        for batch in batches:
            parts = [np.empty(0, np.int64)]
            value = values(batch) if values else lambda x, row: x
            for _, n, cell, x, entry in products(_lists(batch, terms), value, side):
                S = np.bincount(cell, x * side.w[entry], minlength=n * side.n).reshape(n, side.n) + base
                parts.append(np.round(S, digits).argmax(axis=1))
            if batch.num_rows:
                yield batch.append_column("cluster_id", side.qids.take(pa.array(np.concatenate(parts))))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    kind = centroids.schema["cluster_id"].dataType.simpleString()
    return documents.mapInArrow(run, f"{names}, cluster_id {kind}")


def numbered(batch) -> pa.Array:
    """The terms of ``index.numbered_counts`` as (number, tf) lists."""
    number, tf = batch.column("tn"), batch.column("tf")
    size = pc.list_value_length(number).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([number.flatten(), tf.flatten()], ["term", "tf"]))


def over_norm(batch) -> Callable:
    """``values`` of :func:`topk` and :func:`nearest`: tf / norm of the document's
    vector (for weights that hold the idf of the term)."""
    norm = batch.column("norm").to_numpy()
    return lambda tf, row: tf / norm[row]


def by_number(side: DataFrame, vocab: DataFrame, weight: str) -> DataFrame:
    """``side`` (term, ``weight``, other columns) with numbers for terms (-1: not in the
    vocabulary) and the idf in the weight: what :func:`numbered` terms meet."""
    known = vocab.select("term", F.col("idf").alias("_idf"), F.col("number").alias("_number"))
    others = [c for c in side.columns if c not in ("term", weight)]
    return side.join(F.broadcast(known), "term", "left").select(
        *others, F.coalesce("_number", F.lit(-1)).cast("int").alias("term"),
        (F.col(weight) * F.coalesce("_idf", F.lit(1.0))).alias(weight))


def weigh(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``dkey, document_id, v`` of ``index.numbered_counts``: the terms (term, w)
    of each document, w = tf * idf / norm."""
    rows = vocab.select("term", "idf", "number").toArrow().combine_chunks().sort_by("number")
    bc = vocab.sparkSession.sparkContext.broadcast((rows.column("term").combine_chunks(), rows.column("idf").to_numpy()))

    def run(batches):
        names, idf = bc.value
        for batch in batches:
            lists = numbered(batch)
            number = lists.values.field(0)
            code = number.to_numpy()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            w = lists.values.field(1).to_numpy() * idf[code] / batch.column("norm").to_numpy()[row]
            v = pa.StructArray.from_arrays([names.take(number), pa.array(w)], ["term", "w"])
            yield pa.record_batch([batch.column("dkey"), batch.column("document_id"), pa.ListArray.from_arrays(lists.offsets, v)],
                                  names=["dkey", "document_id", "v"])

    kind = counts.schema["document_id"].dataType.simpleString()
    return counts.select("dkey", "document_id", "tn", "tf", "norm").mapInArrow(
        run, f"dkey string, document_id {kind}, v array<struct<term:string,w:double>>")
