"""Retrieval: sparse and dense top-k over whole question tables.

Sparse scoring: the query-term side (questions x their distinct terms, with
weights) is measured and broadcast when small; documents, a row each with
their terms, are scored where they are read, and a task hands on its k best a
question (:mod:`.scan`), so no (question, document) rows are shuffled. When the
query side is too large to broadcast, or an index has postings only, it is an
inverted-index equi-join on ``term`` and a sum per (question, document): both
sides are shuffled by term and AQE splits skewed (frequent-term) partitions.
``row_number() <= k`` plans as a partial WindowGroupLimit before the shuffle by
question.

Dense scoring never materialises question x passage rows. A question matrix
that measures small is broadcast and the passages stream through
``mapInPandas`` (no shuffle); otherwise tasks hold lists of questions past which
the passages move. Either way NumPy computes tiles of scores
and keeps the top k per question (R6, R7, R8), and the final top-k is
again a window limit.

Tie rule everywhere: score rounded to 6 places, descending, then document id
ascending.
"""

from __future__ import annotations

import math
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quarry.functions import text as T
from quarry.operators import scan
from quarry.operators.index import Bm25Index, TfidfIndex, tfidf_terms
from quarry.plans.sizing import maybe_broadcast
from quarry.session import materialize

SCORE_DIGITS = 6


def rank_topk(scores: DataFrame, k: int, group: str = "qid",
              score: str = "score", tie: str = "document_id",
              ascending: bool = False) -> DataFrame:
    """``row_number() over (partition by group order by score, tie) <= k``.

    Adds ``rank`` (1-based). Scores are rounded before ranking so both
    engines see the same ties.
    """
    s = F.round(F.col(score), SCORE_DIGITS)
    order = [s.asc() if ascending else s.desc(), F.col(tie).asc()]
    w = Window.partitionBy(group).orderBy(*order)
    return (scores.withColumn(score, s)
                  .withColumn("rank", F.row_number().over(w))
                  .filter(F.col("rank") <= k))


def query_terms(questions: DataFrame, terms_of: Callable[[Column], Column],
                qid: str = "qid", question: str = "question",
                preprocess: bool = True) -> DataFrame:
    """Questions -> ``(qid, term, qtf)``; repeated terms counted."""
    q = F.col(question)
    if preprocess:
        q = T.preprocess(q)
    pre = questions.select(F.col(qid).alias("qid"), q.alias("_q"))
    return (pre.select("qid", F.explode_outer(terms_of(F.col("_q"))).alias("term"))
               .filter(F.col("term").isNotNull())
               .groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf")))


def _join_postings(postings: DataFrame, qside: DataFrame, small: bool) -> DataFrame:
    """Inverted-index join: the query side is broadcast when its measured
    size allows (the postings then stream through without a shuffle);
    otherwise both sides shuffle by term and AQE splits skewed terms."""
    return postings.join(F.broadcast(qside) if small else qside, "term")


# --------------------------------------------------------------------------
# BM25 (R4, R5)
# --------------------------------------------------------------------------

def bm25_scores(index: Bm25Index, questions: DataFrame, qid: str = "qid",
                question: str = "question", preprocess: bool = True) -> DataFrame:
    """BM25 scores of all matching pairs: ``(qid, dkey, document_id, score)``."""
    qside, small = bm25_question_side(index, questions, qid, question, preprocess)
    return _bm25_sums(index, qside, small)


def bm25_question_side(index: Bm25Index, questions: DataFrame, qid: str = "qid", question: str = "question",
                       preprocess: bool = True):
    """``qid, term, qtf, idf`` and whether its measured size allows a broadcast."""
    qt = query_terms(questions, index.tokenizer, qid, question, preprocess)
    # measure the question side only; joining the (unique-term) statistics
    # cannot add rows, so the bound carries over to the joined side
    qt, small = maybe_broadcast(qt, [F.octet_length("term")])
    # idf per query term; terms absent from the corpus contribute 0 -> dropped
    return qt.join(index.terms.select("term", "idf"), "term"), small


def _bm25_sums(index: Bm25Index, qside: DataFrame, small: bool) -> DataFrame:
    k1, b = index.k1, index.b
    tf, dl = F.col("tf"), F.col("dl")
    contrib = (F.col("qtf") * F.col("idf") * tf * (k1 + 1)
               / (tf + k1 * (1 - b + b * dl / F.lit(float(index.avgdl)))))
    return (_join_postings(index.postings, qside, small)
            .groupBy("qid", "dkey", "document_id")
            .agg(F.sum(contrib).alias("score")))


def bm25_topk(index: Bm25Index, questions: DataFrame, k: int = 10,
              pad_zero: bool = False, docs: DataFrame | None = None, **kw) -> DataFrame:
    """R5 (R4 = one question): ``(qid, rank, document_id, score)``.

    Every document that shares a term with the question is ranked, also one
    with a negative score (the idf floor is negative where most terms are in
    more than half of the documents). A document that shares none scores 0;
    with ``pad_zero`` such documents are ranked too, after positive and before
    negative scores, so that every question gets k rows, as the source returns
    them. ``docs`` is the prepared corpus they are taken from (default: the
    documents with at least one term)."""
    qside, small = bm25_question_side(index, questions, **kw)
    qid = kw.get("qid", "qid")
    if small and index.documents is not None and scan.fits((index.documents, "document_id")):
        rows, side = index.documents, qside.select("qid", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
        if not pad_zero:
            s = scan.topk(rows, "tc", side, k, values=bm25_values(index))
            return rank_topk(s, k).select("qid", "rank", "document_id", "score")
        rows = _with_padding_flag(rows, docs)
        if rows is not None:
            s = scan.topk(rows, "tc", _with_empty_questions(side, questions, qid), k, values=bm25_values(index), pad="pad")
            return rank_topk(s, k).select("qid", "rank", "document_id", "score")
    s = _bm25_sums(index, qside, small)
    if pad_zero:
        s = with_zero_padding(s, docs if docs is not None else index.postings, questions, k, qid)
    return rank_topk(s, k).select("qid", "rank", "document_id", "score")


def bm25_values(index: Bm25Index) -> Callable:
    """What a document's term adds for a weight of 1 (see :func:`scan.topk`)."""
    k1, b, avgdl = index.k1, index.b, float(index.avgdl)

    def values(batch):
        dl = batch.column("dl").to_numpy(zero_copy_only=False)
        return lambda tf, row: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl))
    return values


def _with_padding_flag(rows: DataFrame, docs: DataFrame | None) -> DataFrame | None:
    """``rows`` of an index, and those of ``docs`` that it lacks, with ``pad``:
    whether the document may fill a top k (it is in ``docs``; without ``docs``: it
    has a term). None where an id stands for several rows: a row does not show
    then whether its id matches."""
    ids = rows.select("document_id")
    n = ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("document_id").alias("ids")).first()
    if n["n"] != n["ids"]:
        return None
    if docs is None:
        return rows.withColumn("pad", F.size("tc") > 0)
    own = docs.select("document_id").distinct().withColumn("pad", F.lit(True))
    return rows.join(own, "document_id", "full_outer")


def _with_empty_questions(side: DataFrame, questions: DataFrame, qid: str) -> DataFrame:
    """``side`` with a row of an impossible term for every question, so that
    those without a known term are padded too."""
    every = questions.select(F.col(qid).alias("qid")).distinct()
    return side.unionByName(every.select("qid", F.lit(NO_TERM).alias("term"), F.lit(0.0).alias("weight")))


NO_TERM = "\u0001"  # no token holds a control character after P6
PAD_BLOCK = 1024


def with_zero_padding(scores: DataFrame, docs: DataFrame, questions: DataFrame, k: int,
                      qid: str = "qid") -> DataFrame:
    """``scores`` with the score-0 documents that can reach a top k.

    A question that has p matched documents of positive score needs the
    k - p unmatched ones of smallest id; questions with p >= k need none.

    All ids are numbered in their order (``chunk.number_rows``, distributed).
    Per question the matched numbers are counted by blocks of numbers; the
    running count shows how many unmatched ids there are up to each block, and
    so the block in which the last one needed lies. Only the blocks up to it that
    are not full of matched ids (at most k + 1 a question) are spelled out
    and reduced by an anti join. Windows run over one question's block counts.
    """
    from quarry.operators.chunk import number_rows
    pairs = materialize(scores.select("qid", "document_id", "score"), "bm25-scores")
    positive = pairs.groupBy("qid").agg(F.sum((F.round("score", SCORE_DIGITS) > 0).cast("int")).alias("p"))
    need = materialize(questions.select(F.col(qid).alias("qid")).distinct().join(positive, "qid", "left")
                       .select("qid", (F.lit(k) - F.coalesce("p", F.lit(0))).alias("need")).filter("need > 0"), "padding")
    if need.isEmpty():
        return pairs
    numbered = materialize(number_rows(docs.select("document_id").distinct(), "document_id", "i"), "document-numbers")
    total = numbered.count()
    size = max(PAD_BLOCK, k)
    matched = materialize(pairs.join(need, "qid", "left_semi").join(numbered, "document_id").select("qid", "i"),
                          "matched-numbers")
    block = F.floor(F.col("i") / size)
    counts = matched.groupBy("qid", block.alias("b")).agg(F.count(F.lit(1)).alias("m"))
    up_to = Window.partitionBy("qid").orderBy("b")
    seen = (counts.withColumn("free", (F.col("b") + 1) * size - F.sum("m").over(up_to))
            .withColumn("next", F.lead("b").over(up_to)).join(need, "qid"))
    # a whole block is unmatched before the first counted one, or after one
    # whose successor is not counted; a block holds at least k ids
    ends = F.when(F.col("free") >= F.col("need"), F.col("b")).when(
        F.col("next").isNull() | (F.col("next") > F.col("b") + 1), F.col("b") + 1)
    last = (seen.groupBy("qid").agg(F.min(ends).alias("end"), F.min("b").alias("first"))
            .select("qid", F.when(F.col("first") > 0, F.lit(0)).otherwise(F.col("end")).alias("end")))
    last = need.select("qid").join(last, "qid", "left").select("qid", F.coalesce("end", F.lit(0)).alias("end"))
    open_blocks = (seen.filter(F.col("m") < size).select("qid", "b").join(last, "qid").filter("b <= end").select("qid", "b")
                   .unionByName(last.select("qid", F.col("end").alias("b"))).distinct())
    first = F.col("b") * size
    spelled = open_blocks.select("qid", F.explode(F.sequence(first, first + size - 1)).alias("i")).filter(F.col("i") < total)
    free = spelled.join(matched, ["qid", "i"], "left_anti").join(need, "qid")
    nth = Window.partitionBy("qid").orderBy("i")
    fill = (free.withColumn("n", F.row_number().over(nth)).filter("n <= need").join(numbered, "i")
            .select("qid", "document_id", F.lit(0.0).alias("score")))
    return pairs.unionByName(fill)


# --------------------------------------------------------------------------
# TF-IDF (R1-R3)
# --------------------------------------------------------------------------

def tfidf_query_weights(index: TfidfIndex, questions: DataFrame, qid: str = "qid",
                        question: str = "question", preprocess: bool = True):
    """Query vectors in the fitted vocabulary, L2-normalised: ``(qid, term, wq)``.
    Returns the frame and whether its measured size allows a broadcast."""
    terms_of = lambda c: tfidf_terms(c, index.tokenizer, index.ngram_max)
    qt = query_terms(questions, terms_of, qid, question, preprocess)
    qt, small = maybe_broadcast(qt, [F.octet_length("term")])
    w = qt.join(index.vocab.select("term", "idf"), "term").withColumn(
        "wq", F.col("qtf") * F.col("idf"))
    norm = Window.partitionBy("qid")
    return w.select("qid", "term", (F.col("wq") / F.sqrt(
        F.sum(F.col("wq") * F.col("wq")).over(norm))).alias("wq")), small


def tfidf_scores(index: TfidfIndex, questions: DataFrame, **kw) -> DataFrame:
    return _tfidf_sums(index, *tfidf_query_weights(index, questions, **kw))


def _tfidf_sums(index: TfidfIndex, qw: DataFrame, small: bool) -> DataFrame:
    return (_join_postings(index.weights, qw, small)
            .groupBy("qid", "dkey", "document_id")
            .agg(F.sum(F.col("wq") * F.col("w")).alias("score")))


def tfidf_topk(index: TfidfIndex, questions: DataFrame, k: int = 10, **kw) -> DataFrame:
    """R3 (R2 = one question): cosine similarity top-k."""
    qw, small = tfidf_query_weights(index, questions, **kw)
    if small and index.counts is not None and scan.fits((index.counts, "document_id")):
        # scored where the counts are read: the vectors need not be made
        s = scan.topk(index.counts, scan.numbered, scan.by_number(qw, index.vocab, "wq"), k, weight="wq", values=scan.over_norm)
    elif small and index.vectors is not None and scan.fits((index.vectors, "document_id")):
        s = scan.topk(index.vectors, "v", qw, k, weight="wq")
    else:
        s = _tfidf_sums(index, qw, small)
    return rank_topk(s, k).select("qid", "rank", "document_id", "score")


def oov_report(vocab: DataFrame, questions: DataFrame,
               terms_of: Callable[[Column], Column], qid: str = "qid",
               question: str = "question", preprocess: bool = True) -> DataFrame:
    """Per question, how many of its distinct terms are outside the
    vocabulary; ``all_oov`` marks questions that would score zero."""
    qt = query_terms(questions, terms_of, qid, question, preprocess)
    # the vocabulary is a lookup set; keep the question side as the streamed
    # side of a left join (broadcasting the right side when it is small is
    # AQE's runtime decision)
    known = qt.join(vocab.select("term").withColumn("_in", F.lit(1)), "term", "left")
    return (known.groupBy("qid")
                 .agg(F.count(F.lit(1)).alias("n_terms"),
                      F.sum(F.when(F.col("_in").isNull(), 1).otherwise(0)).alias("n_oov"))
                 .withColumn("all_oov", F.col("n_terms") == F.col("n_oov")))


def assert_not_all_oov(report: DataFrame) -> None:
    """Bulk strict mode: fail only when every question is out of vocabulary."""
    r = report.agg(F.count(F.lit(1)).alias("n"),
                   F.sum(F.col("all_oov").cast("int")).alias("m")).first()
    if r["n"] and r["n"] == r["m"]:
        raise ValueError("every query is outside the fitted vocabulary")


# --------------------------------------------------------------------------
# Dense (R6, R7) and IVF
# --------------------------------------------------------------------------

def _ids(column):
    """Ids as a numpy array that sorts as Spark sorts them: integers, or
    strings (code point order is UTF-8 byte order)."""
    import numpy as np
    a = np.asarray(column)
    return a.astype(str) if a.dtype == object else a


def _block_schema(passages: DataFrame, queries: DataFrame, doc: Column) -> str:
    """Columns of a scored block, with the id types of the inputs."""
    p = passages.select(F.col("pid"), doc.alias("document_id")).schema
    q = queries.select("qid").schema
    kinds = [q[0].dataType, p[0].dataType, p[1].dataType]
    for t in kinds:
        if t.simpleString() not in ("string", "bigint", "int", "smallint", "tinyint"):
            raise TypeError(f"ids must be integers or strings, not {t.simpleString()}")
    names = [t.simpleString() for t in kinds]
    return f"qid {names[0]}, pid {names[1]}, document_id {names[2]}, score double"


TILE_BYTES = 8 << 20   # scores of one tile (rows x questions x 8)


class _Running:
    """The best k passages (or distinct documents) so far of each question of
    a task: best score (rounded), then smallest document id, then smallest
    passage id. Holds at most k rows a question; ``kth`` is the key that a
    passage must reach (smaller is better, inf while there are fewer than k)."""

    def __init__(self, n: int, k: int, grouped: bool):
        import numpy as np
        self.k, self.grouped = k, grouped
        self.kth = np.full(n, np.inf)
        self.rows: list = [None] * n

    def offer(self, i: int, key, doc, pid) -> None:
        import numpy as np
        if self.rows[i] is not None:
            key, doc, pid = (np.concatenate(x) for x in zip(self.rows[i], (key, doc, pid)))
        order = np.lexsort((pid, doc, key))
        if self.grouped:
            _, first = np.unique(doc[order], return_index=True)
            order = order[np.sort(first)]
        order = order[:self.k]
        self.rows[i] = (key[order], doc[order], pid[order])
        if len(order) == self.k:
            self.kth[i] = key[order[-1]]

    def frame(self, qids, sign: float):
        import numpy as np
        import pandas as pd
        full = [i for i, r in enumerate(self.rows) if r is not None]
        if not full:
            return None
        key, doc, pid = (np.concatenate([self.rows[i][c] for i in full]) for c in range(3))
        return pd.DataFrame({"qid": np.repeat(qids[full], [len(self.rows[i][0]) for i in full]),
                             "pid": pid, "document_id": doc, "score": (sign * key + 0.0).astype("float64")})


def _scan(top: _Running, which, P, pid, doc, Q, metric: str, queries_per_tile: int) -> None:
    """Offer the passages ``P`` to the questions ``Q`` (``which``: their
    places in ``top``), tile by tile. A tile holds at most ``TILE_BYTES`` of
    scores. Before a tile is scored, questions that no passage of it can
    serve are left out by the norms: q.p <= |q| max|p|, and the distance of q and
    p is at least the distance of their norms."""
    import numpy as np
    sign = -1.0 if metric == "ip" else 1.0
    pn, qn = np.sqrt((P * P).sum(1)), np.sqrt((Q * Q).sum(1))
    slack = 10.0 ** -SCORE_DIGITS     # covers rounding to equal scores
    step = max(1, TILE_BYTES // (8 * max(1, min(len(Q), queries_per_tile))))
    for a in range(0, len(P), step):
        rows = slice(a, min(a + step, len(P)))
        low, high = pn[rows].min(), pn[rows].max()
        if metric == "ip":
            best = -qn * high
        else:
            best = np.maximum(0.0, np.maximum(low - qn, qn - high)) ** 2
        live = np.flatnonzero(best - slack * (1 + np.abs(best)) <= top.kth[which])
        for b in range(0, len(live), queries_per_tile):
            sel = live[b:b + queries_per_tile]
            S = (sign * Q[sel]) @ P[rows].T if metric == "ip" else Q[sel] @ P[rows].T
            if metric != "ip":  # squared L2, as an IVF-Flat L2 index reports
                S *= -2.0
                S += (qn[sel] ** 2)[:, None]
                S += (pn[rows] ** 2)[None, :]
            # smaller is better; only what can reach the k-th key is rounded
            kth = top.kth[which[sel]]
            wanted = S <= (kth + slack * (1 + np.abs(kth)))[:, None]
            for i in np.flatnonzero(wanted.any(axis=1)):
                cand = np.flatnonzero(wanted[i])
                key = S[i, cand]
                key = sign * np.round(sign * key if metric == "ip" else np.maximum(key, 0.0), SCORE_DIGITS)
                near = key <= kth[i]
                cand, key = cand[near], key[near]
                if not top.grouped and len(cand) > 4 * top.k:
                    keep = key <= np.partition(key, top.k - 1)[top.k - 1]  # ties kept
                    cand, key = cand[keep], key[keep]
                if len(cand):
                    top.offer(int(which[sel[i]]), key, doc[rows][cand], pid[rows][cand])


def _matrix(column):
    import numpy as np
    return np.stack(column.to_numpy()).astype(np.float64)


def _best_of_document(part: DataFrame) -> DataFrame:
    """A document's passages may sit in several batches: keep its best."""
    one = Window.partitionBy("qid", "document_id").orderBy(F.col("score").desc(), "pid")
    return part.withColumn("_b", F.row_number().over(one)).filter(F.col("_b") == 1).drop("_b")


def _final_topk(part: DataFrame, k: int, metric: str) -> DataFrame:
    ranked = rank_topk(part, k, score="score", tie="document_id", ascending=(metric != "ip"))
    return ranked.select("qid", "rank", "pid", "document_id", "score")


def _query_matrix(queries: DataFrame, extra: str | None = None):
    """The (measured, small) question matrix as one broadcast value."""
    import numpy as np
    cols = ["qid", "vec"] + ([extra] if extra else [])
    table = queries.select(*cols).toArrow().combine_chunks()
    qids = _ids(table.column("qid").to_pandas())
    flat = table.column("vec").combine_chunks().flatten() if len(table) else None
    Q = (np.asarray(flat, dtype=np.float64).reshape(len(table), -1) if len(table) else np.zeros((0, 1)))
    payload = (qids, Q, table.column(extra).to_pylist() if extra else None)
    return queries.sparkSession.sparkContext.broadcast(payload)


def _streamed_scorer(bc, k: int, metric: str, grouped: bool, chunk: int):
    """Scores a task's passages batch by batch against the broadcast
    questions and emits the best k of each question once, at the end. A task
    holds a batch of vectors, one tile of scores and k rows a question."""
    import numpy as np

    def run(batches):
        qids, Q, probes = bc.value
        by_cluster = None
        if probes is not None:
            by_cluster = {}
            for i, c in enumerate(probes):
                by_cluster.setdefault(int(c), []).append(i)
        # a question that probes several clusters stands once for each; its
        # lists are merged by the final ranking
        top = _Running(len(qids), k, grouped)
        for pdf in batches:
            if len(pdf) == 0 or len(qids) == 0:
                continue
            P = _matrix(pdf["vec"])
            pid, doc = _ids(pdf["pid"]), _ids(pdf["document_id"])
            if by_cluster is None:
                groups = [(slice(None), np.arange(len(qids)))]
            else:
                cl = pdf["cluster_id"].to_numpy()
                groups = [(np.flatnonzero(cl == c), np.array(by_cluster[int(c)]))
                          for c in np.unique(cl) if int(c) in by_cluster]
            for rows, which in groups:
                _scan(top, which, P[rows], pid[rows], doc[rows], Q[which], metric, chunk)
        out = top.frame(qids, -1.0 if metric == "ip" else 1.0)
        if out is not None:
            yield out
    return run


HELD_QUESTIONS = 16384   # questions whose best k a task holds while passages pass by
HELD_TILE = 512          # questions of one tile of scores


def _lists(batches):
    """Of a partition sorted by (cluster_id, sub, kind): each list's questions
    (one record batch or none), then its passages, a batch at a time."""
    import numpy as np
    import pyarrow as pa

    here, held, ready = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("cluster_id", "sub", "kind")])
        cuts = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if a == b:
                continue
            if (at := tuple(keys[:2, a])) != here:
                here, held, ready = at, [], None
            if keys[2, a] == 0:
                held.append(batch.slice(a, b - a))
            elif held:
                if ready is None:
                    ready = pa.Table.from_batches(held)
                yield at, ready, batch.slice(a, b - a)


def _arrow_matrix(column):
    import numpy as np
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _held_scorer(k: int, metric: str, grouped: bool):
    """Scores the passages of each list against its questions, which are held;
    a question's best k leave once, when its list ends."""
    import numpy as np

    def run(batches):
        import pyarrow as pa
        here = top = None

        def best():
            out = top.frame(qids, -1.0 if metric == "ip" else 1.0) if top is not None else None
            if out is not None:
                for a in range(0, len(out), 65536):
                    yield pa.RecordBatch.from_pandas(out.iloc[a:a + 65536], preserve_index=False)

        for at, questions, passages in _lists(batches):
            if at != here:
                yield from best()
                here, qids = at, _ids(questions.column("qid").to_pandas())
                Q, top = _arrow_matrix(questions.column("vec")), _Running(len(qids), k, grouped)
            _scan(top, np.arange(len(qids)), _arrow_matrix(passages.column("vec")), _ids(passages.column("pid").to_pandas()),
                  _ids(passages.column("document_id").to_pandas()), Q, metric, HELD_TILE)
        yield from best()
    return run


def held_lists(passages: DataFrame, probes: DataFrame, bounded: bool) -> DataFrame:
    """Rows ``cluster_id, sub, kind, qid, ...`` for ``mapInArrow``: the
    questions ``probes (qid, vec, cluster_id)`` of each cluster dealt to
    lists of at most ``HELD_QUESTIONS`` (fewer where that leaves cores without a
    list), ``kind`` 0, each followed by all ``passages`` of its cluster, ``kind``
    1. A list lies in one partition. A passage moves once for each list of its
    cluster, so a question meets all passages in one task, and nothing
    but its best k moves on. ``bounded``: the clusters are few enough for the driver."""
    cores = probes.sparkSession.sparkContext.defaultParallelism
    size = max(1, min(HELD_QUESTIONS, math.ceil(probes.count() / cores)))
    sizes = probes.groupBy("cluster_id").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("subs"))
    if bounded:     # numbered, so that every list gets a partition of its own
        rows, first = [], 0
        for r in sizes.orderBy("cluster_id").collect():
            rows.append((int(r["cluster_id"]), int(r["subs"]), first))
            first += int(r["subs"])
        lists, total = F.broadcast(probes.sparkSession.createDataFrame(rows, "cluster_id int, subs int, first int")), first
        part = F.col("first") + F.col("sub")
    else:
        lists, total = sizes, 4 * cores
        part = F.pmod(F.xxhash64("cluster_id", "sub"), F.lit(total)).cast("int")
    extra = [F.col(c) for c in passages.columns if c not in ("cluster_id", "vec")]
    none = [F.lit(None).cast(passages.schema[c].dataType).alias(c) for c in passages.columns if c not in ("cluster_id", "vec")]
    # a passage table may hold something else than vectors (codes)
    own = "vec" in passages.columns
    vec = probes.schema["vec"].dataType
    pv = F.col("vec").cast(vec) if own else F.lit(None).cast(vec)
    q = probes.join(lists, "cluster_id").withColumn("sub", F.pmod(F.xxhash64("qid"), F.col("subs")).cast("int")).select(
        part.alias("part"), F.col("cluster_id").cast("int").alias("cluster_id"), "sub", F.lit(0).alias("kind"), "qid", "vec", *none)
    p = passages.join(lists, "cluster_id").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).select(
        part.alias("part"), F.col("cluster_id").cast("int").alias("cluster_id"), "sub", F.lit(1).alias("kind"),
        F.lit(None).cast(probes.schema["qid"].dataType).alias("qid"), pv.alias("vec"), *extra)
    return (q.unionByName(p).repartitionById(max(1, total), F.col("part"))
            .sortWithinPartitions("cluster_id", "sub", "kind").drop("part"))


def _held_topk(passages: DataFrame, probes: DataFrame, k: int, metric: str, grouped: bool,
               schema: str, bounded: bool = True) -> DataFrame:
    return held_lists(passages, probes, bounded).mapInArrow(_held_scorer(k, metric, grouped), schema)


def _streams(passages: DataFrame, queries: DataFrame, k: int, copies: int = 1) -> bool:
    """Whether the questions are broadcast past which the passages stream: they
    have to fit, and the best k of every question from every task must be
    less than the passages that would move to held questions."""
    from quarry.plans.sizing import measured_bytes
    if not _fits(queries, copies=copies):
        return False
    n_q = queries.count() * copies
    lists = max(queries.sparkSession.sparkContext.defaultParallelism, math.ceil(n_q / HELD_QUESTIONS))
    tasks = passages.rdd.getNumPartitions()
    return tasks * n_q * k * TOPK_ROW_BYTES <= lists * measured_bytes(passages, [F.size("vec") * 4])


def _fits(queries: DataFrame, vec: str = "vec", copies: int = 1) -> bool:
    """Measured size of the question matrix (8 bytes per component), times
    the number of copies that will be broadcast (probes per question)."""
    from quarry.plans.sizing import broadcast_limit, measured_bytes
    return (measured_bytes(queries, [F.size(vec) * 8]) * copies
            <= broadcast_limit(queries.sparkSession))


def dense_topk(passages: DataFrame, queries: DataFrame, k: int = 10,
               group_col: str | None = None, rows_per_block: int = 50000,
               queries_per_block: int = 4096, stream: bool | None = None) -> DataFrame:
    """R6 exact inner-product top-k; with ``group_col`` (R7) the top k
    distinct groups (documents), each by its best passage.

    ``passages``: ``pid, vec [, document_id]``; ``queries``: ``qid, vec``.

    When the question matrix measures under the broadcast limit and is small
    beside the passages (thousands of questions against a huge corpus) it is
    broadcast and the passages stream through ``mapInPandas`` without any
    shuffle; every task keeps a running top k per question (of passages, or of
    documents by their best passage, both exact after the final top-k) and emits
    it once. Otherwise the questions are dealt to lists that tasks hold while
    all passages pass by (``held_lists``): the best k of a question come from one
    task. Scores are computed in tiles of ``TILE_BYTES``; a tile whose norms
    cannot reach a question's k-th score is not scored for it.
    ``queries_per_block`` bounds a tile of the streamed form. The block sizes no
    longer set how often vectors are copied; results do not depend on them.
    """
    doc = F.col(group_col) if group_col else F.col("pid")
    schema = _block_schema(passages, queries, doc)
    if stream is None:
        stream = _streams(passages, queries, k)
    p = passages.select("pid", doc.alias("document_id"), "vec")
    if stream:
        bc = _query_matrix(queries)
        part = p.mapInPandas(_streamed_scorer(bc, k, "ip", bool(group_col), queries_per_block),
                             schema)
        if group_col:
            part = _best_of_document(part)
        return _final_topk(part, k, "ip")
    one = F.lit(0).alias("cluster_id")
    part = _held_topk(p.select("*", one), queries.select("qid", "vec", one), k, "ip", bool(group_col), schema)
    return _final_topk(part, k, "ip")


def centroids_by_label(vectors: DataFrame, label: str = "label",
                       vec: str = "vec") -> DataFrame:
    """Deterministic coarse centroids: the mean vector of each label."""
    ex = vectors.select(F.col(label).alias("cluster_id"),
                        F.posexplode(vec).alias("i", "x"))
    return (ex.groupBy("cluster_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
              .groupBy("cluster_id")
              .agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("_c"))
              .select("cluster_id", F.transform("_c", lambda s: s["m"]).alias("centroid")))


def kmeans_centroids(vectors: DataFrame, num_clusters: int = 64, seed: int = 42,
                     vec: str = "vec", max_iter: int = 20) -> DataFrame:
    """I6 with learned centroids: Spark ML KMeans (L2), centroids as a table."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    data = vectors.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=num_clusters, seed=seed, maxIter=max_iter).fit(data)
    # the fitted centres are num_clusters x dim parameters of the model
    centers = [[float(x) for x in c] for c in model.clusterCenters()]
    spark = vectors.sparkSession
    return spark.createDataFrame([(i, c) for i, c in enumerate(centers)],
                                 "cluster_id int, centroid array<double>")


def _model_fits(centroids: DataFrame) -> bool:
    """Whether the centroid table measures under the broadcast limit."""
    from quarry.plans.sizing import broadcast_limit, measured_bytes
    return measured_bytes(centroids, [F.size("centroid") * 8]) <= broadcast_limit(centroids.sparkSession)


def _centroid_model(centroids: DataFrame):
    """The (measured, small) centroid matrix, sorted by id, shipped to tasks
    as one broadcast value (as Spark ML's KMeansModel does)."""
    import numpy as np
    rows = centroids.select("cluster_id", "centroid").orderBy("cluster_id").collect()
    ids = np.array([int(r["cluster_id"]) for r in rows], dtype=np.int64)
    C = np.array([list(r["centroid"]) for r in rows], dtype=np.float64)
    return centroids.sparkSession.sparkContext.broadcast((ids, C))


class _Nearest:
    """The nearest ``nprobe`` of the centroids offered so far to each vector:
    smallest squared L2 (rounded to 9 places), then smallest id. Centroids
    are offered in order of their ids; distances exist for one tile at a time."""

    def __init__(self, V, nprobe: int):
        import numpy as np
        self.V, self.norms = V, (V * V).sum(1)
        self.far = np.full((len(V), nprobe), np.inf)
        self.ids = np.zeros((len(V), nprobe), np.int64)
        self.seen = 0                    # columns in use: min(nprobe, seen)

    def offer(self, ids, C) -> None:
        import numpy as np
        cn = (C * C).sum(1)
        nprobe = self.far.shape[1]
        wide = max(nprobe, 4096)
        for c in range(0, len(ids), wide):
            own, part = ids[c:c + wide], C[c:c + wide]
            step = max(1, TILE_BYTES // (8 * len(own)))
            for a in range(0, len(self.V), step):
                r = slice(a, a + step)
                D = np.round(self.norms[r, None] + cn[None, c:c + wide] - 2.0 * (self.V[r] @ part.T), 9)
                np.copyto(D, np.inf, where=np.isnan(D))
                if nprobe == 1:                 # the first least one has the least id
                    j = D.argmin(axis=1)
                    d = D[np.arange(len(j)), j]
                    nearer = (d < self.far[r, 0]) | (self.seen == 0)
                    self.far[r, 0] = np.where(nearer, d, self.far[r, 0])
                    self.ids[r, 0] = np.where(nearer, own[j], self.ids[r, 0])
                    continue
                used = min(nprobe, self.seen)
                D = np.concatenate([self.far[r, :used], D], axis=1)
                who = np.concatenate([self.ids[r, :used], np.broadcast_to(own, (len(D), len(own)))], axis=1)
                # stable: earlier columns have the smaller ids
                order = np.argsort(D, axis=1, kind="stable")[:, :nprobe]
                self.far[r, :order.shape[1]] = np.take_along_axis(D, order, axis=1)
                self.ids[r, :order.shape[1]] = np.take_along_axis(who, order, axis=1)
            self.seen += len(own)

    def pairs(self):
        """(vector number, cluster id) of what was found, nearest first."""
        import numpy as np
        if len(self.V) and not self.seen:
            raise ValueError("there are no centroids")
        used = min(self.far.shape[1], self.seen)
        return np.repeat(np.arange(len(self.V)), used), self.ids[:, :used].reshape(-1)


def _nearest_fn(bc, vec: str, nprobe: int):
    import numpy as np

    def run(batches):
        ids, C = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            near = _Nearest(np.stack(pdf[vec].to_numpy()).astype(np.float64), nprobe)
            if len(ids):
                near.offer(ids, C)
            row, cluster = near.pairs()
            out = pdf.iloc[row].reset_index(drop=True)
            out["cluster_id"] = cluster.astype("int32")
            yield out
    return run


def _nearest_in_blocks(nprobe: int):
    """Over a partition sorted by (block, kind, id): a block's vectors are
    held, then its centroids pass by a batch at a time."""
    import numpy as np
    import pyarrow as pa

    def matrix(column):
        return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)

    def run(batches):
        block, rows, vectors, near = None, [], [], None

        def finished():
            if not rows:
                return
            held = pa.concat_arrays(rows)
            row, cluster = (near or _Nearest(np.concatenate(vectors), nprobe)).pairs()
            for a in range(0, len(row), 4096):
                yield pa.record_batch([held.take(pa.array(row[a:a + 4096])),
                                       pa.array(cluster[a:a + 4096], pa.int32())], names=["row", "cluster_id"])

        for batch in batches:
            number = batch.column("block").to_numpy()
            kind = batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(number)]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if number[a] != block:
                    yield from finished()
                    block, rows, vectors, near = number[a], [], [], None
                if kind[a] == 0:
                    rows.append(part.column("row"))
                    vectors.append(matrix(part.column("v")))
                elif vectors:
                    near = near or _Nearest(np.concatenate(vectors), nprobe)
                    near.offer(part.column("cluster_id").to_numpy().astype(np.int64), matrix(part.column("v")))
        yield from finished()
    return run


def _nearest(vectors: DataFrame, centroids: DataFrame, nprobe: int, vec: str,
             stream: bool | None, rows_per_block: int) -> DataFrame:
    """``vectors`` with ``cluster_id``, a row for each of the ``nprobe``
    nearest centroids."""
    if stream is None:
        stream = _model_fits(centroids)
    if stream:
        bc = _centroid_model(centroids)
        schema = StructType(vectors.schema.fields + [StructField("cluster_id", IntegerType())])
        return vectors.mapInPandas(_nearest_fn(bc, vec, nprobe), schema)
    blocks = max(1, math.ceil(vectors.count() / rows_per_block))
    # dealt at random, so that equal vectors fill no block alone, and written,
    # so that a task that is run again finds the same rows in its blocks
    dealt = materialize(vectors.select(
        F.floor(F.rand(7) * blocks).cast("int").alias("block"), F.lit(0).alias("kind"),
        F.lit(None).cast("int").alias("cluster_id"), F.col(vec).cast("array<double>").alias("v"),
        F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in vectors.columns]).alias("row")), "ivf-blocks")
    row = dealt.schema["row"].dataType
    model = centroids.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"),
        F.col("cluster_id").cast("int"), F.col("centroid").cast("array<double>").alias("v"),
        F.lit(None).cast(row).alias("row"))
    out = (dealt.unionByName(model).repartition(blocks, "block")
           .sortWithinPartitions("block", "kind", "cluster_id")
           .mapInArrow(_nearest_in_blocks(nprobe),
                       StructType([StructField("row", row), StructField("cluster_id", IntegerType())])))
    return out.select("row.*", "cluster_id")


def ivf_assign(vectors: DataFrame, centroids: DataFrame, vec: str = "vec",
               stream: bool | None = None, rows_per_block: int = 50000) -> DataFrame:
    """Every vector gets its nearest centroid (squared L2 rounded to 9
    places; ties: lower id).

    A centroid table under the broadcast limit is broadcast and the vectors
    stream past it without a shuffle. A larger one (say, a centroid per label
    of very many) is sent to blocks of ``rows_per_block`` vectors and streams
    past each: a task holds a block's rows, a batch of centroids and
    ``TILE_BYTES`` of distances; nothing passes through the driver. ``stream``
    chooses between the two, which give the same rows.
    """
    return _nearest(vectors, centroids, 1, vec, stream, rows_per_block)


def ivf_probes(queries: DataFrame, centroids: DataFrame, nprobe: int = 1, vec: str = "vec",
               stream: bool | None = None, rows_per_block: int = 50000) -> DataFrame:
    """Nearest ``nprobe`` clusters of each query: ``(qid, vec, cluster_id)``,
    one row per probed cluster. ``stream`` as in :func:`ivf_assign`."""
    return _nearest(queries.select("qid", vec), centroids, nprobe, vec, stream, rows_per_block)


def ivf_topk(passages: DataFrame, queries: DataFrame, centroids: DataFrame,
             k: int = 10, nprobe: int = 1, rows_per_block: int = 50000,
             queries_per_block: int = 4096, stream: bool | None = None) -> DataFrame:
    """Approximate top-k by squared L2 over the probed clusters only.

    ``passages`` must carry ``cluster_id`` (from :func:`ivf_assign`, or a
    table written partitioned by it). Passages of clusters nobody probes are
    dropped first (a semi-join on at most num_clusters ids; on a partitioned
    table a dynamic partition filter). Then, as in :func:`dense_topk`, a
    small question set is broadcast with its probe lists and the passages
    stream through ``mapInPandas``; a large one is held in lists of questions
    of a cluster, past which only that cluster's passages move.
    """
    small_model = _model_fits(centroids)
    if stream is None:
        stream = _streams(passages, queries, k, copies=nprobe)
    probes = ivf_probes(queries, centroids, nprobe, stream=small_model)
    # ids and sizes of clusters are bounded by the model
    bounded = F.broadcast if small_model else lambda df: df
    if not (small_model and stream):
        probes = materialize(probes, "ivf-probes")   # read several times below
    live = passages.join(bounded(probes.select("cluster_id").distinct()), "cluster_id", "left_semi")
    schema = _block_schema(passages, queries, F.col("pid"))
    p = live.select("pid", F.col("pid").alias("document_id"), "vec", "cluster_id")
    if stream:
        bc = _query_matrix(probes, extra="cluster_id")
        part = p.mapInPandas(_streamed_scorer(bc, k, "l2", False, queries_per_block), schema)
        return _final_topk(part, k, "l2")
    part = _held_topk(p, probes, k, "l2", False, schema, bounded=small_model)
    return _final_topk(part, k, "l2")


# --------------------------------------------------------------------------
# Result tables
# --------------------------------------------------------------------------

TOPK_ROW_BYTES = 64   # qid, rank, document_id, score + row overhead


def attach_documents(topk: DataFrame, docs: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Add title and raw text of each retrieved document.

    ``docs`` is the raw corpus ``(document_id, title, text)`` (document ids
    are unique there). ``max_rows`` is the proven bound of the top-k side
    (questions x k); when it fits the broadcast limit the top-k rows are
    broadcast and the corpus streams once without a shuffle. Without a bound
    the join is left to Spark (AQE broadcasts at run time when small); the
    top-k frame is never computed twice just to be measured.
    """
    from quarry.plans.sizing import broadcast_limit
    small = (max_rows is not None
             and max_rows * TOPK_ROW_BYTES <= broadcast_limit(topk.sparkSession))
    side = F.broadcast(topk) if small else topk
    return docs.select("document_id", "title", F.col("text").alias("context")).join(
        side, "document_id")


def retrieved_table(topk: DataFrame, docs: DataFrame, questions: DataFrame,
                    qid: str = "qid", question: str = "question",
                    k: int | None = None) -> DataFrame:
    """One row per question with ``title[], context[], document_id[]`` in
    rank order (and the question). Ground-truth columns of the question table
    (``context``, ``answers``, ``document_id``) are carried as
    ``original_*`` when present."""
    bound = questions.count() * k if k else None     # top-k rows <= questions x k
    long = attach_documents(topk, docs, bound)
    nested = (long.groupBy("qid")
                  .agg(F.sort_array(F.collect_list(F.struct(
                      "rank", "title", "context", "document_id"))).alias("_r"))
                  .select("qid",
                          F.col("_r.title").alias("title"),
                          F.col("_r.context").alias("context"),
                          F.col("_r.document_id").alias("document_id")))
    cols = [F.col(qid).alias("qid"), F.col(question).alias("question")]
    if "context" in questions.columns and "answers" in questions.columns:
        cols += [F.col("context").alias("original_context"),
                 F.col("answers")]
        if "document_id" in questions.columns:
            cols.append(F.col("document_id").alias("original_document_id"))
    return questions.select(*cols).join(nested, "qid", "left")


METHODS = ("bm25", "tfidf", "dpr", "faiss")


def retrieve(questions: DataFrame, docs: DataFrame | None = None, method: str = "bm25",
             k: int = 10, passages: DataFrame | None = None,
             query_vectors: DataFrame | None = None, centroids: DataFrame | None = None,
             nprobe: int = 1, index=None, **kw) -> DataFrame:
    """One interface over the four methods; returns the long top-k.

    All but ``dpr`` take ``questions (qid, question)`` and either prepared
    ``docs`` (``prepare_corpus``) or a built ``index``, such as the stored ones of
    S4, and then build nothing: ``bm25`` a ``Bm25Index`` or an
    ``impacts.ImpactIndex``, ``tfidf`` a ``TfidfIndex``, ``faiss`` a
    ``sparse_ivf.SparseIvf`` (TF-IDF vectors, as the source has them; learned
    centroids, ``nprobe`` lists).

    Vectors computed outside (encoders are not part of this library) come as
    ``passages (pid, vec, document_id)`` and ``query_vectors (qid, vec)``:
    ``dpr`` returns the top k distinct documents (R7), ``faiss`` probes
    ``nprobe`` clusters of them (R8; ``index`` may be a
    ``quantize.CodedIndex``). ``kw`` goes to what builds the index.
    """
    from quarry.operators import impacts, quantize, sparse_ivf
    from quarry.operators.index import build_bm25, build_tfidf
    if method == "bm25":
        if isinstance(index, impacts.ImpactIndex):
            return impacts.topk(index, questions, k)
        return bm25_topk(index or build_bm25(docs, **kw), questions, k)
    if method == "tfidf":
        return tfidf_topk(index or build_tfidf(docs, **kw), questions, k)
    if method == "dpr":
        return dense_topk(passages, query_vectors, k, group_col="document_id", **kw)
    if method == "faiss":
        if isinstance(index, quantize.CodedIndex):
            return quantize.coded_topk(index, query_vectors, k, nprobe)
        if passages is None:
            if index is None:
                tfidf = build_tfidf(docs)
                index = sparse_ivf.build_lists(tfidf, sparse_ivf.kmeans(tfidf, **kw))
            return sparse_ivf.topk(index, questions, k, nprobe)
        cents = centroids if centroids is not None else kmeans_centroids(passages, **kw)
        return ivf_topk(ivf_assign(passages, cents), query_vectors, cents, k, nprobe)
    raise ValueError(f"unknown method {method!r}; expected one of {METHODS}")


def retrieve_one(spark, question: str, docs: DataFrame, raw_corpus: DataFrame,
                 method: str = "bm25", k: int = 10) -> DataFrame:
    """R10 (and R2, R4): one question string -> its top-k (rank, score,
    document_id, title, context) through the same bulk operator."""
    q = spark.createDataFrame([(0, question)], "qid long, question string")
    top = retrieve(q, docs, method, k)
    return attach_documents(top, raw_corpus, max_rows=k).select(
        "rank", "score", "document_id", "title", "context")
