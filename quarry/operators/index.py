"""Index building: BM25 and TF-IDF postings, corpus statistics.

Corpus preparation (P6, P8, J1) produces rows hash-partitioned by the content
key ``dkey``. A document's distinct terms with counts are computed and stored in
its row, so that scores are known where the row is read (:mod:`.scan`); postings are
these rows exploded. Term statistics (document frequency, collection frequency)
are one shuffle of the postings by ``term`` with map-side partial aggregation,
so a term present in every document is pre-counted per task before it moves.

Building an index is an action: the rows are written to the shared folder
in one pass over the corpus, and the vocabulary-sized term statistics and the
corpus scalars (N, average length, mean idf) come from that table; the driver
receives numbers only.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import heavy, scan
from quarry.operators.dedup import content_key
from quarry.operators.heavy import KEPT_PER_TERM
from quarry.plans.sizing import maybe_broadcast
from quarry.session import BATCH_BYTES, materialize

Tokenizer = Callable[[Column], Column]


def default_tokenizer(c: Column) -> Column:
    """T2 default: T1 on already-normalised text."""
    return T.whitespace_tokens(c, normalized=True)


# --------------------------------------------------------------------------
# Corpus preparation: P6 -> P8 -> J1
# --------------------------------------------------------------------------

def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that has fewer input splits than the cluster has
    cores (a few large files or row groups) before per-row heavy work. Large
    inputs already have many splits and pass through unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < cores else df


def prepare_corpus(corpus: DataFrame, no_other_languages: bool = False,
                   quote_normalize: bool = True, keep_text: bool = False) -> DataFrame:
    """Corpus ``(document_id, title, text)`` -> deduplicated rows
    ``dkey, document_id, title, ptext [, text]``.

    ``ptext = title + ' ' + P6(text)``; duplicates on ptext keep the smallest
    document_id. The cleaning runs once, before the shuffle; the shuffle
    carries ptext (and the raw text only when ``keep_text``: retrieval
    output looks the raw text up by document_id instead, see
    ``retrieve.attach_documents``).
    """
    base = spread(corpus.select("document_id", "title", "text"))
    # a NULL text counts as empty (otherwise every such document would share
    # one NULL key)
    pt = T.title_prefixed(F.col("title"), T.preprocess(
        F.coalesce(F.col("text"), F.lit("")), no_other_languages, quote_normalize))
    keyed = base.select("document_id", "title", "text", pt.alias("ptext"))
    keyed = keyed.withColumn("dkey", content_key(F.col("ptext")))
    fields = ["document_id", "title", "ptext"] + (["text"] if keep_text else [])
    packed = F.struct(*fields)
    return (keyed.groupBy("dkey")
                 .agg(F.min_by(packed, F.col("document_id")).alias("_r"))
                 .select("dkey", *[F.col("_r." + f).alias(f) for f in fields]))


# --------------------------------------------------------------------------
# BM25 (I4)
# --------------------------------------------------------------------------

TERM_SLICE = 1 << 20     # tokens that are counted at once, unless one document has more


TEXT_SLICE = 8 << 20     # bytes of text that are split at once, unless one document has more


def _split(texts: pa.Array) -> pa.Array:
    """T1 of normalised texts: what stands between single spaces."""
    lists = pc.split_pattern(texts.cast(pa.string()), " ")
    flat = lists.flatten()
    kept = pc.not_equal(flat, "")
    if not pc.all(kept).as_py():
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lists)), size)[kept.to_numpy(zero_copy_only=False)]
        lists = pa.ListArray.from_arrays(_row_ends(row, len(lists)), flat.filter(kept))
    return lists


def _slices(column: pa.Array):
    """The token lists of an Arrow column of such lists or of normalised texts, some
    rows at a time."""
    texts = not pa.types.is_list(column.type) and not pa.types.is_large_list(column.type)
    size = pc.binary_length(column) if texts else pc.list_value_length(column)
    size = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + (TEXT_SLICE if texts else TERM_SLICE), "right")))
        yield _split(column.slice(at, end - at)) if texts else column.slice(at, end - at)
        at = end


def _numbered_tokens(lists: pa.Array):
    """Of an Arrow list of tokens: row and number of each token, the distinct tokens."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().cast(pa.string()).dictionary_encode()
    return (np.repeat(np.arange(len(lists)), size), words.indices.to_numpy(zero_copy_only=False).astype(np.int64),
            words.dictionary)


# A term's hash is a polynomial in a value of each of its bytes, modulo 2**64: an n-gram's
# follows from its (n-1)-gram's and its last token's, and is that of the joined string.
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)
HASH_OF_BYTE = np.random.default_rng(50_000).integers(1, 1 << 63, 256, dtype=np.uint64)


def _word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each string, and what the hash of a text before it is multiplied with."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    size, total = np.diff(ends), int(ends[-1] - ends[0])
    raw = np.frombuffer(words.buffers()[2], np.uint8)[ends[0]:ends[-1]] if total else np.zeros(0, np.uint8)
    power = np.full(int(size.max(initial=0)) + 1, HASH_BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    after = np.repeat(ends[1:] - ends[0], size) - 1 - np.arange(total)     # bytes that follow in the word
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(HASH_OF_BYTE[raw] * power[after], dtype=np.uint64)])
    return sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]], power[size]


def _ngram_hashes(row: np.ndarray, word: np.ndarray, words: pa.Array, grams: int):
    """For n = 1..``grams`` the tokens at which an n-gram of one row begins, and its hash."""
    own, shift = _word_hashes(words)
    at, h = np.arange(len(word)), own[word]
    yield at, h
    for n in range(2, grams + 1):
        end = np.minimum(at + n - 1, len(row) - 1)
        whole = np.flatnonzero((row[end] == row[at]) & (end == at + n - 1))
        at, last = at[whole], word[end[whole]]
        h = (h[whole] * HASH_BASE + HASH_OF_BYTE[32]) * shift[last] + own[last]
        yield at, h


class Wanted:
    """A set of hashes."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.keys >> np.uint64(42)] = True

    def among(self, h: np.ndarray) -> np.ndarray:
        """The places of ``h`` whose hash is in the set."""
        maybe = np.flatnonzero(self.bits[h >> np.uint64(42)])
        near = np.minimum(np.searchsorted(self.keys, h[maybe]), max(0, len(self.keys) - 1))
        return maybe[self.keys[near] == h[maybe]] if len(self.keys) else maybe


def _row_terms(lists: pa.Array, grams: int, wanted: Wanted | None = None):
    """``row, term, count, names``: the distinct 1..``grams``-grams of each row
    with their counts, in order of rows; a term is its place in ``names``. With
    ``wanted`` only those whose hash is in it. Tokens are numbered, an n-gram
    is the number of its (n-1)-gram with its last token's, and (row, number)
    pairs are sorted and counted."""
    row, word, words = _numbered_tokens(lists)
    width = max(1, len(words))
    rows, terms, every, base = [], [], [], 0
    for n, (at, h) in enumerate(_ngram_hashes(row, word, words, grams), 1):
        if wanted is not None:
            at = at[wanted.among(h)]
        names, number = words, word[at]
        for i in range(1, n):
            pair, number = np.unique(number * width + word[at + i], return_inverse=True)
            left, right = names.take(pa.array(pair // width)), words.take(pa.array(pair % width))
            names = pc.binary_join_element_wise(left, right, " ")
        rows.append(row[at])
        terms.append(number + base)
        every.append(names)
        base += len(names)
    row, term, names = np.concatenate(rows), np.concatenate(terms), pa.concat_arrays(every)
    if grams > 1 and pc.any(pc.match_substring(words, " ")).as_py():
        same = names.dictionary_encode()     # a token may equal an n-gram of others
        names, term = same.dictionary, same.indices.to_numpy(zero_copy_only=False).astype(np.int64)[term]
    key, count = np.unique(row * max(1, len(names)) + term, return_counts=True)
    return key // max(1, len(names)), key % max(1, len(names)), count, names


def _row_ends(rows: np.ndarray, n: int) -> pa.Array:
    """List offsets of ``n`` rows, whose elements have the (sorted) row numbers ``rows``."""
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32))


def _count_terms(grams: int):
    """Of an Arrow list of tokens a row: its distinct 1..``grams``-grams with
    their counts."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))

    def counted(lists):
        rows, terms, counts, names = _row_terms(lists, grams)
        pairs = pa.StructArray.from_arrays(
            [names.take(pa.array(terms)), pa.array(counts.astype(np.int32))], ["term", "tf"])
        return pa.ListArray.from_arrays(_row_ends(rows, len(lists)), pairs).cast(kind)

    def run(lists: pa.Array) -> pa.Array:
        parts = [counted(part) for part in _slices(lists)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)
    return run


def with_term_counts(df: DataFrame, toks: str, out: str = "tc", grams: int = 1) -> DataFrame:
    """Adds the distinct tokens (1..``grams``-grams) of each row with their
    counts as ``array<struct<term, tf>>``, counted in numpy a batch of rows
    at a time. Tokens are not null. ``toks`` may be the text of :func:`document_tokens`."""
    count = F.arrow_udf(_count_terms(grams), "array<struct<term:string,tf:int>>")
    return df.withColumn(out, count(F.col(toks)))


@dataclass
class Bm25Index:
    postings: DataFrame      # dkey, document_id, dl, term, tf
    terms: DataFrame         # term, df, idf
    n_docs: int
    avgdl: float
    k1: float = 1.5
    b: float = 0.75
    tokenizer: Tokenizer = default_tokenizer
    documents: DataFrame | None = None   # dkey, document_id, dl, tc: the postings, a row a document


def bm25_documents(docs: DataFrame, tokenizer: Tokenizer = default_tokenizer) -> DataFrame:
    """Each prepared document with its number of tokens ``dl`` and its
    distinct terms with counts ``tc``; also those without any."""
    toks = docs.select("dkey", "document_id", tokenizer(F.col("ptext")).alias("toks"))
    toks = toks.select("dkey", "document_id", F.size("toks").alias("dl"), "toks")
    # term counts inside each row: no hash aggregate
    return with_term_counts(toks, "toks").drop("toks")


def document_postings(index: Bm25Index) -> DataFrame:
    """``dkey, document_id, dl, tc`` of an index's documents."""
    if index.documents is not None:
        return index.documents
    return index.postings.groupBy("dkey", "document_id").agg(
        F.first("dl").alias("dl"), F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"))).alias("tc"))


def build_bm25(docs: DataFrame, tokenizer: Tokenizer = default_tokenizer,
               k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> Bm25Index:
    """I4: Okapi BM25 statistics over prepared docs (``dkey, document_id, ptext``).

    idf = ln(N - df + 0.5) - ln(df + 0.5); a negative idf is replaced by
    ``epsilon * mean(idf)`` (mean over all corpus terms, negatives included).
    Empty documents count in N and in the average length.

    Building is an action that reads the corpus once: the documents' terms are
    written to the shared folder, and the per-term statistics (one row per
    distinct term), N, the average length and the idf floor come from that table.
    """
    return bm25_from_documents(materialize(bm25_documents(docs, tokenizer), "bm25-documents", BATCH_BYTES), tokenizer, k1, b, epsilon)


def bm25_from_documents(documents: DataFrame, tokenizer: Tokenizer = default_tokenizer,
                        k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> Bm25Index:
    """The index over stored :func:`bm25_documents`."""
    postings = term_rows(documents, "dl")
    corpus = documents.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("len")).first()
    n_docs = int(corpus["n"])
    avgdl = (corpus["len"] / n_docs) if n_docs else 0.0
    per_term = materialize(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "bm25-terms")
    raw = per_term.select(
        "term", "df", (F.log(F.lit(float(n_docs)) - F.col("df") + 0.5)
                       - F.log(F.col("df") + 0.5)).alias("idf_raw"))
    mean_idf = raw.agg(F.avg("idf_raw")).first()[0] or 0.0
    terms = raw.select("term", "df", F.when(F.col("idf_raw") < 0, F.lit(epsilon * mean_idf))
                       .otherwise(F.col("idf_raw")).alias("idf"))
    return Bm25Index(postings, terms, n_docs, avgdl, k1, b, tokenizer, documents)


# --------------------------------------------------------------------------
# TF-IDF (I1-I3)
# --------------------------------------------------------------------------

@dataclass
class TfidfIndex:
    weights: DataFrame       # dkey, document_id, term, w   (L2-normalised)
    vocab: DataFrame         # term, cf, df, idf            (<= max_features rows)
    n_docs: int
    ngram_max: int = 2
    tokenizer: Tokenizer = default_tokenizer
    vectors: DataFrame | None = None     # dkey, document_id, v: the weights, a row a document
    counts: DataFrame | None = None      # what the vectors are made of (:func:`numbered_counts`)


def tfidf_terms(c: Column, tokenizer: Tokenizer = default_tokenizer,
                ngram_max: int = 2) -> Column:
    """Lower-case, tokenize, 1..n word n-grams (for short texts such as
    questions; corpus rows materialise the token column first)."""
    return T.word_ngrams(tokenizer(F.lower(c)), ngram_max)


def document_terms(docs: DataFrame, tokenizer: Tokenizer = default_tokenizer, ngram_max: int = 2) -> DataFrame:
    """Lower-cased 1..n-grams of each prepared document with their counts, a row
    a document (``dkey, document_id, tc``): keys are not repeated for every
    term. See :func:`term_rows`."""
    return with_term_counts(document_tokens(docs, tokenizer), "toks", grams=ngram_max).drop("toks")


def term_rows(counted: DataFrame, *more: str) -> DataFrame:
    """Rows ``dkey, document_id, more..., term, tf`` of stored :func:`document_terms`
    or :func:`bm25_documents`."""
    return counted.select("dkey", "document_id", *more, F.explode("tc").alias("p")).select(
        "dkey", "document_id", *more, F.col("p.term").alias("term"), F.col("p.tf").cast("long").alias("tf"))


def weight_rows(vectors: DataFrame, *more: str) -> DataFrame:
    """Rows ``dkey, document_id, more..., term, w`` of vectors a row a document."""
    return vectors.select("dkey", "document_id", *more, F.explode("v").alias("p")).select(
        "dkey", "document_id", *more, F.col("p.term").alias("term"), F.col("p.w").alias("w"))


def document_vectors(index: TfidfIndex) -> DataFrame:
    """``dkey, document_id, v`` of every document with a term of the vocabulary."""
    if index.vectors is not None:
        return index.vectors
    return index.weights.groupBy("dkey", "document_id").agg(F.collect_list(F.struct("term", "w")).alias("v"))


def document_tokens(docs: DataFrame, tokenizer: Tokenizer = default_tokenizer) -> DataFrame:
    """``dkey, document_id, toks``: the lower-cased tokens of each prepared document;
    those of the default tokenizer as the text, which is split where they are counted."""
    toks = F.lower(F.col("ptext"))
    return docs.select("dkey", "document_id", (toks if tokenizer is default_tokenizer else tokenizer(toks)).alias("toks"))


def heaviest_ngrams(tokens: DataFrame, k: int, grams: int) -> DataFrame:
    """``heavy.top_terms`` of the 1..``grams``-grams of rows ``toks``: the ``k``
    terms of largest count as ``term, cf, df``. ``tokens`` is read up to four
    times. Summaries are made of hashes alone; only the n-grams that they leave
    become strings, and are counted a batch of rows at a time."""
    tokens = tokens.select("toks")

    def hashed(batches):
        for batch in batches:
            for part in _slices(batch.column(0)):
                h = np.concatenate([h for _, h in _ngram_hashes(*_numbered_tokens(part), grams)])
                h, n = np.unique(h.view(np.int64), return_counts=True)
                yield pa.record_batch({"h": h, "n": n.astype(np.int64)})

    def exact(keys):
        bc = None if keys is None else tokens.sparkSession.sparkContext.broadcast(
            keys.toArrow().column("h").to_numpy().view(np.uint64))

        def run(batches):
            wanted = None if bc is None else Wanted(bc.value)
            for batch in batches:
                for part in _slices(batch.column(0)):
                    _, term, tf, names = _row_terms(part, grams, wanted)
                    df = np.bincount(term, minlength=len(names))
                    cf = np.bincount(term, tf, minlength=len(names)).astype(np.int64)
                    met = np.flatnonzero(df)
                    yield pa.record_batch({"term": names.take(pa.array(met)), "cf": cf[met], "df": df[met].astype(np.int64)})

        return (tokens.mapInArrow(run, "term string, cf long, df long").groupBy("term")
                .agg(F.sum("cf").alias("cf"), F.sum("df").alias("df")).orderBy(F.desc("cf"), F.asc("term")).limit(k))

    summaries = heavy.summaries(KEPT_PER_TERM * k)
    bounds = tokens.mapInArrow(lambda batches: summaries(hashed(batches)), "h long, n long")
    return heavy.settled(bounds.groupBy("h").agg(F.sum("n").alias("n")), exact, k)


def numbered_counts(tokens: DataFrame, vocab: DataFrame, grams: int) -> DataFrame:
    """``dkey, document_id, tn, tf, norm`` of every document with a term of the
    (small) vocabulary: the numbers of its terms in order, their counts, and
    the L2 norm of tf * idf."""
    rows = vocab.select("term", "idf", "number").toArrow().combine_chunks().sort_by("number")
    bc = tokens.sparkSession.sparkContext.broadcast(
        (rows.column("term").combine_chunks(), rows.column("idf").to_numpy()))

    def run(batches):
        known, idf = bc.value
        wanted = Wanted(_word_hashes(known)[0])
        for batch in batches:
            at = 0
            for part in _slices(batch.column("toks")):
                row, term, tf, names = _row_terms(part, grams, wanted)
                number = pc.fill_null(pc.index_in(names, value_set=known), -1).to_numpy(zero_copy_only=False)[term]
                order = np.flatnonzero(number >= 0)      # another term may have the hash of a known one
                order = order[np.lexsort((number[order], row[order]))]
                row, number, tf = row[order], number[order], tf[order]
                w = tf * idf[number]
                ends = _row_ends(row, len(part))
                yield pa.record_batch(
                    [batch.column("dkey").slice(at, len(part)), batch.column("document_id").slice(at, len(part)),
                     pa.ListArray.from_arrays(ends, pa.array(number.astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32))),
                     pa.array(np.sqrt(np.bincount(row, w * w, minlength=len(part))))],
                    names=["dkey", "document_id", "tn", "tf", "norm"])
                at += len(part)

    kind = tokens.schema["document_id"].dataType.simpleString()
    return tokens.select("dkey", "document_id", "toks").mapInArrow(
        run, f"dkey string, document_id {kind}, tn array<int>, tf array<int>, norm double").filter(F.size("tn") > 0)


def number_rows(counts: DataFrame, vocab: DataFrame, *more: str) -> DataFrame:
    """Rows ``dkey, document_id, more..., term, w`` of :func:`numbered_counts`."""
    p = F.explode(F.arrays_zip("tn", "tf")).alias("p")
    known = F.broadcast(vocab.select("number", "term", "idf"))     # small, or there are no numbers
    rows = counts.select("dkey", "document_id", *more, "norm", p).select(
        "dkey", "document_id", *more, "norm", F.col("p.tn").alias("number"), F.col("p.tf").alias("tf"))
    return rows.join(known, "number").select(
        "dkey", "document_id", *more, "term", (F.col("tf") * F.col("idf") / F.col("norm")).alias("w"))


def build_tfidf(docs: DataFrame, tokenizer: Tokenizer = default_tokenizer,
                ngram_max: int = 2, max_features: int = 50000, stored: bool = False) -> TfidfIndex:
    """I2 + I3: vocabulary = the ``max_features`` terms of highest corpus
    frequency (ties: term ascending; :func:`heaviest_ngrams`); weight =
    tf * (ln((1+N)/(1+df)) + 1), L2-normalised per document.

    Building is an action that reads the corpus once: the prepared documents
    are written to the shared folder (unless they are a ``stored`` table). The
    vocabulary (at most ``max_features`` rows) and the document count come from
    that table; the vocabulary is measured before it is broadcast. Then a
    document's terms are counted and weighed in its row, as numbers of the
    vocabulary, and written: its weights need no shuffle for their norm.
    """
    docs = docs.select("dkey", "document_id", "ptext")
    docs = docs if stored else materialize(docs, "tfidf-documents")
    n_docs = docs.count()
    tokens = document_tokens(docs, tokenizer)
    top = heaviest_ngrams(tokens, max_features, ngram_max)
    vocab = top.select("term", "cf", "df",
                       (F.log(F.lit(n_docs + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    side, small = maybe_broadcast(vocab.select("term", "idf"), [F.octet_length("term")])
    if small:
        heaviest = Window.orderBy(F.desc("cf"), F.asc("term"))      # max_features rows, measured small
        vocab = materialize(vocab.withColumn("number", F.row_number().over(heaviest) - 1), "tfidf-vocab")
        counts = materialize(numbered_counts(tokens, vocab, ngram_max), "tfidf-counts")
        return tfidf_from_counts(counts, vocab, n_docs, ngram_max, tokenizer)
    w = term_rows(materialize(document_terms(docs, tokenizer, ngram_max), "tfidf-counts")).join(side, "term")
    w = w.withColumn("w", F.col("tf") * F.col("idf"))
    per_doc = Window.partitionBy("dkey", "document_id")
    w = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(per_doc)))
    return TfidfIndex(w.select("dkey", "document_id", "term", "w"), vocab, n_docs, ngram_max, tokenizer)


def tfidf_from_counts(counts: DataFrame, vocab: DataFrame, n_docs: int, ngram_max: int,
                      tokenizer: Tokenizer = default_tokenizer) -> TfidfIndex:
    """The index over stored :func:`numbered_counts` and their vocabulary."""
    return TfidfIndex(number_rows(counts, vocab), vocab, n_docs, ngram_max, tokenizer,
                      scan.weigh(counts, vocab), counts)


# --------------------------------------------------------------------------
# Corpus statistics
# --------------------------------------------------------------------------

def corpus_stats(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """Corpus size and matrix shape (documents x distinct terms, nnz)."""
    d = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    p = postings.agg(F.count_distinct("term").alias("n_terms"),
                     F.count(F.lit(1)).alias("n_postings"))
    return d.select("n_docs", p.select("n_terms").scalar().alias("n_terms"),
                    p.select("n_postings").scalar().alias("n_postings"))
