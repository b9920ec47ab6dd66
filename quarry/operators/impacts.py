"""BM25 top-k with impact bounds.

Documents are dealt into blocks of alike ones: ordered by their most frequent
term, then by length. A block is kept with its documents and, for every term, the
largest contribution of the term to a document of the block (twice where a block's
documents are read by two tasks, each with its own bounds). A contribution is that
of a question weight (count times idf) of 1. Some blocks together are stored as one
row, compressed (a piece): a task holds one piece at a time as arrays. A search:

1. The rarest terms of each question (as many as keep the rows small) are scored
   in full; the best documents by these partial scores are scored by all terms.
   The k-th best of their scores is a threshold: at least k documents reach it.
2. The most frequent terms of a question whose largest contributions together
   stay below the threshold cannot bring a document there alone. So only
   documents with one of the other, essential terms can be among the k best.
   The postings of essential terms are scored, in the task that reads the block.
3. Of these documents those go on whose partial score and the stored maxima of
   the frequent terms in their block reach the threshold. Only for them the
   postings of the frequent terms are scored, from the same row.

No postings and no (question, document) rows are shuffled, but for the k best of
each task. The result is that of ``bm25_topk``. The maximum of a term with a
negative weight (see the idf floor) counts as zero, since a document may lack the term. A
question without rare terms, or whose rare terms match fewer than k documents,
has no threshold: all its terms are essential and all its documents go on.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import retrieve as R
from quarry.operators import scan
from quarry.operators.chunk import _sorted_by
from quarry.operators.index import Bm25Index, document_postings
from quarry.plans.sizing import broadcast_limit, maybe_broadcast, measured_bytes
from quarry.session import BATCH_BYTES, materialize

BLOCK_DOCS = 128
PIECE = 1 << 18      # postings stored as one row, unless one block has more
GROUP_ROWS = 16      # such rows of one row group: what a reader decodes together
OUT_ROWS = 1 << 16   # rows of one batch of survivors
SLACK = 2 * 10.0 ** -R.SCORE_DIGITS  # scores that round to the threshold count


@dataclass
class ImpactIndex:
    """``blocks``: block (the first), data: rows block, docs (dkey, document_id, dl, tc),
    tops (term, top), see :func:`_stored`; as rows ``postings``: dkey, document_id, term, block, impact (contribution a
    unit of question weight) and ``bounds``: term, block, top; ``terms``: term, df,
    idf, most (its largest contribution anywhere)."""

    bm25: Bm25Index
    postings: DataFrame
    bounds: DataFrame
    terms: DataFrame
    blocks: DataFrame


def _impact(index: Bm25Index) -> Column:
    tf, dl = F.col("tf"), F.col("dl")
    return tf * (index.k1 + 1) / (tf + index.k1 * (1 - index.b + index.b * dl / F.lit(float(index.avgdl))))


def _packed(lists: pa.Array) -> pa.Array:
    """Terms with counts (not null) as bytes, for the exchange: how many they are, the
    counts, the lengths of the terms, the terms."""
    if not len(lists):
        return pa.array([], pa.binary())
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
    flat = lists.flatten()
    names, tf = pc.cast(flat.field(0), pa.large_binary()), flat.field(1).to_numpy(zero_copy_only=False).astype(np.int32)
    at = np.frombuffer(names.buffers()[1], np.int64)[names.offset:names.offset + len(names) + 1]
    size, raw = np.diff(at).astype(np.int32), memoryview(names.buffers()[2] or b"")
    return pa.array([b"".join((np.int32(b - a).tobytes(), tf[a:b].tobytes(), size[a:b].tobytes(), raw[at[a]:at[b]]))
                     for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())


def _unpacked(rows: pa.Array) -> pa.Array:
    """What :func:`_packed` has packed."""
    rows = [r.as_buffer() for r in rows]
    n = [int(np.frombuffer(r, np.int32, 1)[0]) for r in rows]
    ints = [np.frombuffer(r, np.int32, 2 * k, 4) for r, k in zip(rows, n)]
    none = [np.empty(0, np.int32)]
    tf, size = np.concatenate(none + [x[:k] for x, k in zip(ints, n)]), np.concatenate(none + [x[k:] for x, k in zip(ints, n)])
    raw = b"".join(memoryview(r)[4 + 8 * k:] for r, k in zip(rows, n))
    names = pa.Array.from_buffers(pa.string(), len(size), [None, _ends(size).buffers()[1], pa.py_buffer(raw)])
    return pa.ListArray.from_arrays(_ends(np.array(n, np.int64)), pa.StructArray.from_arrays([names, pa.array(tf)], ["term", "tf"]))


def document_blocks(documents: DataFrame, block_docs: int) -> DataFrame:
    """``dkey, document_id, dl, tc (packed), block`` of the documents with a term, ordered by
    their most frequent term (ties: the larger term), length and key and cut into
    blocks of at most ``block_docs`` in each range of that order. Rows of a block
    follow each other; a block's number says its place in the order."""
    docs = documents.filter(F.size("tc") > 0)
    most = F.array_max(F.arrays_zip(F.col("tc.tf").alias("tf"), F.col("tc.term").alias("term")))["term"]
    order = F.concat_ws("\x00", most, F.lpad(F.col("dl").cast("string"), 12, "0"), "dkey", F.col("document_id").cast("string"))
    packed = F.arrow_udf(_packed, "binary")("tc")
    ordered = _sorted_by(docs.select("dkey", "document_id", "dl", packed.alias("tc"), order.alias("place")), "place", None)
    return ordered.select("dkey", "document_id", "dl", "tc", F.expr(f"monotonically_increasing_id() div {int(block_docs)}").alias("block"))


def _pieces(batch):
    """Rows of documents, those of a block in sequence, some whole blocks at a time."""
    batch = batch.set_column(batch.schema.get_field_index("tc"), "tc", _unpacked(batch.column("tc")))
    block = batch.column("block").to_numpy()
    first = np.append(np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), len(block))
    size = batch.column("tc").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(size)])[first]
    a = 0
    while a < len(first) - 1:
        b = max(a + 1, int(np.searchsorted(before, before[a] + PIECE, "right")) - 1)
        yield batch.slice(first[a], first[b] - first[a])
        a = b


def _ends(size: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))


def _not_less(x: np.ndarray) -> np.ndarray:
    """The least 32-bit numbers that are not less: bounds stay bounds in half the bytes."""
    near = x.astype(np.float32)
    return np.where(near < x, np.nextafter(near, np.float32(np.inf)), near)


def _blocks_of(batch, values) -> pa.RecordBatch:
    """Of a piece of documents the rows block, docs, tops. Terms are numbers in a dictionary,
    those of ``tops`` (in order in a block) as the difference to the number before."""
    block = batch.column("block").to_numpy()
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    ends = np.append(first, len(block)).astype(np.int32)
    lists = batch.column("tc")
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    terms, tf = lists.flatten().field(0).dictionary_encode(), lists.flatten().field(1)
    width = max(1, len(terms.dictionary))
    row = np.repeat(np.arange(len(lists)), size)
    part = np.repeat(np.arange(len(first)), np.diff(ends))[row]
    key = part * width + terms.indices.to_numpy(zero_copy_only=False)
    impact = values(batch)(tf.to_numpy(zero_copy_only=False).astype(np.float64), row)
    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    top, key = _not_less(np.maximum.reduceat(impact[order], at)), key[order][at]
    names = pa.array(np.diff(key % width, prepend=0).astype(np.int32))
    tops = pa.ListArray.from_arrays(_ends(np.bincount(key // width, minlength=len(first))),
                                    pa.StructArray.from_arrays([names, pa.array(top)], ["term", "top"]))
    tc = pa.ListArray.from_arrays(_ends(size), pa.StructArray.from_arrays([terms, tf], ["term", "tf"]))
    docs = pa.StructArray.from_arrays([*(batch.column(c) for c in ("dkey", "document_id", "dl")), tc], ["dkey", "document_id", "dl", "tc"])
    return pa.record_batch([pa.array(block[first]), pa.ListArray.from_arrays(pa.array(ends), docs), tops], names=["block", "docs", "tops"])


def _with_bounds(values):
    """Rows of documents, those of a block in sequence -> stored pieces."""
    def run(batches):
        for batch in batches:
            for part in _pieces(batch) if batch.num_rows else ():
                piece, sink = _blocks_of(part, values), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(piece)
                yield pa.record_batch([piece.column("block").slice(0, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                      names=["block", "data"])
    return run


def _stored(batches):
    """The pieces of stored rows, one by one: record batches block, docs, tops."""
    for batch in batches:
        for data in batch.column("data"):
            with pa.ipc.open_stream(data.as_buffer()) as stream:
                piece = stream.read_next_batch()
            names = piece.column("docs").flatten().field("tc").flatten().field(0).dictionary
            tops = piece.column("tops")
            step, top = tops.flatten().flatten()
            terms = pa.DictionaryArray.from_arrays(pa.array(np.cumsum(step.to_numpy(), dtype=np.int32)), names)
            yield piece.set_column(2, "tops", pa.ListArray.from_arrays(tops.offsets, pa.StructArray.from_arrays([terms, top], ["term", "top"])))


def _documents(piece) -> tuple[np.ndarray, pa.RecordBatch]:
    """The documents of a piece, and to which of its blocks each belongs."""
    lists = piece.column("docs")
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), size), pa.RecordBatch.from_struct_array(lists.flatten())


def _posting_rows(piece):
    of, docs = _documents(piece)
    lists = docs.column("tc")
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    at, flat = pa.array(row), lists.flatten()
    return pa.record_batch([*(docs.column(c).take(at) for c in ("dkey", "document_id", "dl")), piece.column("block").take(pa.array(of[row])),
                            flat.field(0).dictionary_decode(), flat.field(1)], names=["dkey", "document_id", "dl", "block", "term", "tf"])


def _bound_rows(piece):
    lists = piece.column("tops")
    of, flat = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten()
    return pa.record_batch([flat.field(0).dictionary_decode(), piece.column("block").take(pa.array(of)),
                            flat.field(1).cast(pa.float64())], names=["term", "block", "top"])


def _most_rows(piece):
    """The largest bound of each term of a piece."""
    flat = piece.column("tops").flatten()
    names, top = flat.field(0), flat.field(1).to_numpy().astype(np.float64)
    most = np.full(len(names.dictionary), -np.inf)
    np.maximum.at(most, names.indices.to_numpy(), top)
    return pa.record_batch([names.dictionary, pa.array(most)], names=["term", "most"])


def _rows(blocks: DataFrame, of, schema: str) -> DataFrame:
    return blocks.select("data").mapInArrow(lambda batches: (of(piece) for piece in _stored(batches)), schema)


def build(index: Bm25Index, block_docs: int = BLOCK_DOCS) -> ImpactIndex:
    """The documents moved once, in the order of their blocks, and stored in pieces
    of blocks with the bounds."""
    docs = document_blocks(document_postings(index), block_docs)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    of = ", ".join(f"{c} {kinds[c]}" for c in ("dkey", "document_id", "dl"))
    blocks = materialize(docs.mapInArrow(_with_bounds(R.bm25_values(index)), "block bigint, data binary"), "impact-blocks", BATCH_BYTES,
                         compression="uncompressed", **{"parquet.block.row.count.limit": GROUP_ROWS})
    rows = _rows(blocks, _posting_rows, f"{of}, block bigint, term string, tf int")
    postings = rows.select("dkey", "document_id", "term", "block", _impact(index).alias("impact"))
    bounds = _rows(blocks, _bound_rows, "term string, block bigint, top double").groupBy("term", "block").agg(F.max("top").alias("top"))
    most = _rows(blocks, _most_rows, "term string, most double").groupBy("term").agg(F.max("most").alias("most"))
    terms = materialize(index.terms.join(most, "term"), "impact-terms")
    return ImpactIndex(index, postings, bounds, terms, blocks)


def _question_side(index: ImpactIndex, questions: DataFrame, seed_rows: int, **kw) -> DataFrame:
    """``qid, term, weight, seed``: the question's terms in the corpus and
    whether they are among its rarest, of ``seed_rows`` postings together."""
    bm25 = index.bm25
    qt = R.query_terms(questions, bm25.tokenizer, **kw).join(index.terms.select("term", "df", "idf"), "term")
    rare = Window.partitionBy("qid").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, 0)
    return qt.select("qid", "term", (F.col("qtf") * F.col("idf")).alias("weight"),
                     (F.sum("df").over(rare) <= seed_rows).alias("seed"))


def _scores(rows: DataFrame) -> DataFrame:
    return rows.groupBy("qid", "dkey", "document_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))


def thresholds(index: ImpactIndex, side: DataFrame, k: int) -> DataFrame:
    """``qid, least``: a score that k documents of the question reach, for
    questions whose seed terms match at least k documents."""
    bm25 = index.bm25
    seeds, small = maybe_broadcast(side.filter("seed").select("qid", "term", "weight"), [F.octet_length("term")])
    documents = document_postings(bm25)
    if small and scan.fits((documents, "document_id")):
        partial = scan.topk(documents, "tc", seeds, 2 * k, values=R.bm25_values(bm25))
    else:
        partial = _scores(index.postings.join(seeds, "term"))
    few = materialize(R.rank_topk(partial, 2 * k).select("qid", "document_id").distinct(), "impact-seeds", BATCH_BYTES)
    wanted, _ = maybe_broadcast(few)  # 2k rows a question
    own = (documents.join(wanted, "document_id").select("qid", "dkey", "document_id", "dl", F.explode("tc").alias("p"))
           .select("qid", "dkey", "document_id", "dl", F.col("p.term").alias("term"), F.col("p.tf").alias("tf"))
           .join(side.select("qid", "term", "weight"), ["qid", "term"]))
    best = R.rank_topk(_scores(own.withColumn("impact", _impact(bm25))), k)
    return (best.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
            .filter(F.col("n") >= k).select("qid", "least"))


def split_terms(index: ImpactIndex, side: DataFrame, least: DataFrame) -> DataFrame:
    """``side`` with ``least`` (null without a threshold) and ``essential``."""
    frequent = Window.partitionBy("qid").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.sum(F.greatest(F.lit(0.0), F.col("weight") * F.col("most"))).over(frequent)
    return (side.join(index.terms.select("term", "df", "most"), "term").join(least, "qid", "left")
            .withColumn("essential", F.col("least").isNull() | (reach >= F.col("least") - SLACK))
            .select("qid", "term", "weight", "least", "essential"))


def survivors(index: ImpactIndex, split: DataFrame) -> DataFrame:
    """``qid, dkey, document_id, score`` (partial, by essential terms) of the
    documents that can still be among the k best, with their postings of frequent terms
    ``frequent`` (weight, impact). Questions that are too many to broadcast are
    dealt into slices; each is a pass over the blocks."""
    need = measured_bytes(split, [F.octet_length("term")])
    n = max(1, -(-need // broadcast_limit(split.sparkSession)))
    slices = [split.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)] if n > 1 else [split]
    return reduce(DataFrame.unionByName, [_survivors(index, part) for part in slices])


def _survivors(index: ImpactIndex, split: DataFrame) -> DataFrame:
    made = scan.by_term(split.select("qid", "term", "weight", "least", "essential").toArrow(), "qid", "weight", ("least", "essential"))
    least = np.full(made.n, np.nan)
    least[made.q] = made.more["least"].astype(np.float64)
    bc = split.sparkSession.sparkContext.broadcast((made, made.more["essential"].astype(bool), least))
    values = R.bm25_values(index.bm25)

    def scored(blocks, side, essential, least):
        """Of some blocks of a piece: rows of the documents that go on."""
        reach = []
        for _, n, cell, top, entry in scan.products(blocks.column("tops"), lambda x, row: x, side):
            most = np.where(essential[entry], 0.0, np.maximum(0.0, side.w[entry] * top))
            reach.append(np.bincount(cell, most, minlength=n * side.n).reshape(n, side.n))
        reach, (of, docs) = np.concatenate(reach), _documents(blocks)
        for a, n, cell, x, entry in scan.products(docs.column("tc"), values(docs), side):
            own = essential[entry]
            S = np.bincount(cell[own], (x * side.w[entry])[own], minlength=n * side.n)
            live = np.zeros(n * side.n, bool)
            live[cell[own]] = True
            can = S.reshape(n, side.n) + reach[of[a:a + n]] >= least - SLACK
            live &= (np.isnan(least) | can).reshape(-1)
            at = np.flatnonzero(live)
            more = np.flatnonzero(~own & live[cell])
            more = more[np.argsort(cell[more], kind="stable")]
            ends = np.append(np.searchsorted(cell[more], at), len(more))
            for i in range(0, len(at), OUT_ROWS):
                chosen, bound = at[i:i + OUT_ROWS], ends[i:i + OUT_ROWS + 1]
                part = more[bound[0]:bound[-1]]
                frequent = pa.ListArray.from_arrays(
                    pa.array((bound - bound[0]).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(side.w[entry[part]]), pa.array(x[part])], ["weight", "impact"]))
                row = pa.array(a + chosen // side.n)
                yield pa.record_batch([side.qids.take(pa.array(chosen % side.n)), docs.column("dkey").take(row),
                                       docs.column("document_id").take(row), pa.array(S[chosen]), frequent],
                                      names=["qid", "dkey", "document_id", "score", "frequent"])

    def run(batches):
        side, essential, least = bc.value
        step = max(1, scan.CELLS // max(1, side.n))
        for piece in _stored(batches):
            for a in range(0, piece.num_rows if side.n else 0, step):
                yield from scored(piece.slice(a, step), side, essential, least)

    kinds = split.schema["qid"].dataType.simpleString(), index.postings.schema["document_id"].dataType.simpleString()
    return index.blocks.select("data").mapInArrow(run, f"qid {kinds[0]}, dkey string, document_id {kinds[1]}, score double, "
                                        "frequent array<struct<weight:double,impact:double>>")


def frequent_postings(index: ImpactIndex, split: DataFrame, live: DataFrame) -> DataFrame:
    """The postings of the frequent terms of the documents ``live``:
    ``qid, dkey, document_id, weight, impact``."""
    return live.select("qid", "dkey", "document_id", F.explode("frequent").alias("p")).select(
        "qid", "dkey", "document_id", "p.weight", "p.impact")


def whole_scores(live: DataFrame) -> DataFrame:
    """``live`` with the contributions of the frequent terms added."""
    more = F.aggregate("frequent", F.lit(0.0), lambda s, p: s + p["weight"] * p["impact"])
    return live.select("qid", "dkey", "document_id", (F.col("score") + more).alias("score"))


def topk(index: ImpactIndex, questions: DataFrame, k: int = 10, seed_rows: int | None = None, **kw) -> DataFrame:
    """``(qid, rank, document_id, score)`` as ``bm25_topk`` gives it.
    ``seed_rows`` bounds the postings a question may score for its threshold
    (default 200 k)."""
    side = materialize(_question_side(index, questions, seed_rows or 200 * k, **kw), "impact-questions")
    least = thresholds(index, side, k)
    split = materialize(split_terms(index, side, least), "impact-terms")
    scores = whole_scores(survivors(index, split))
    return R.rank_topk(scores, k).select("qid", "rank", "document_id", "score")
