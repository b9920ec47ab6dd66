"""TF-IDF counts by term number: hashes of n-grams, the vocabulary, and what is stored and moved."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import index as I
from quarry.operators import retrieve as R
from quarry.sources import io


def _grams(tokens, n_max):
    return [" ".join(tokens[i:i + n]) for n in range(1, n_max + 1) for i in range(len(tokens) - n + 1)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(12)
    words = ["é", "가나", "x" * 300] + [f"w{i}" for i in range(60)]
    rows = [(d, f"s{d % 3}", " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randrange(0, 60))))
            for d in range(150)]
    return spark.createDataFrame(rows, "document_id long, title string, text string").repartition(3)


def test_an_ngram_has_the_hash_of_its_string():
    tokens = [["a", "b", "", "é가", "a b"], [], ["z" * 5000, "a"], ["q"]]
    row, word, words = I._numbered_tokens(pa.array(tokens))
    flat = [t for r in tokens for t in r]
    for n, (at, h) in enumerate(I._ngram_hashes(row, word, words, 3), 1):
        strings = [" ".join(flat[i:i + n]) for i in at]
        assert sorted(strings) == sorted(" ".join(r[i:i + n]) for r in tokens for i in range(len(r) - n + 1))
        assert (I._word_hashes(pa.array(strings, pa.string()))[0] == h).all()
    assert len(I._word_hashes(pa.array([], pa.string()))[0]) == 0


@pytest.mark.parametrize("words", [["a", "b", "é", "가나"], ["a", "a b", "b", "b a"]])
@pytest.mark.parametrize("k,kept", [(7, 1), (7, 100), (500, 32)])
def test_heaviest_ngrams_equal_a_plain_count(spark, words, k, kept, monkeypatch):
    monkeypatch.setattr(I, "KEPT_PER_TERM", kept)
    rng = random.Random(k)
    rows = [[rng.choice(words) for _ in range(rng.randrange(0, 30))] for _ in range(50)]
    cf = Counter(g for r in rows for g in _grams(r, 2))
    df = Counter(g for r in rows for g in set(_grams(r, 2)))
    want = sorted((t, cf[t], df[t]) for t in sorted(cf, key=lambda t: (-cf[t], t))[:k])
    tokens = spark.createDataFrame([(r,) for r in rows], "toks array<string>").repartition(3)
    assert sorted(map(tuple, I.heaviest_ngrams(tokens, k, 2).collect())) == want


def test_terms_that_share_a_hash_are_told_apart(spark, corpus, monkeypatch):
    docs = I.prepare_corpus(corpus)
    get = lambda i: {(r.document_id, r.term): round(r.w, 9) for r in i.weights.collect()}
    want = get(I.build_tfidf(docs, max_features=40))

    class All:                     # as if every n-gram had the hash of a wanted one
        def __init__(self, keys):
            pass

        def among(self, h):
            return np.arange(len(h))

    monkeypatch.setattr(I, "Wanted", All)
    assert get(I.build_tfidf(docs, max_features=40)) == want


def test_weights_are_those_of_the_join(spark, corpus):
    docs = I.prepare_corpus(corpus)
    get = lambda i: {(r.document_id, r.term): round(r.w, 9) for r in i.weights.collect()}
    index = I.build_tfidf(docs, max_features=50)
    spark.conf.set("quarry.broadcast.maxBytes", "1")
    try:
        large = I.build_tfidf(docs, max_features=50)
    finally:
        spark.conf.unset("quarry.broadcast.maxBytes")
    assert large.counts is None and get(index) == get(large)
    assert {(r.document_id, p.term): round(p.w, 9) for r in index.vectors.collect() for p in r.v} == get(index)


def test_counts_are_numbers_and_strings_are_not_written(spark, corpus):
    """A row holds two small numbers a term; before: the term's string with its count, and with its weight."""
    index = I.build_tfidf(I.prepare_corpus(corpus), max_features=50)
    assert index.counts.dtypes[2:] == [("tn", "array<int>"), ("tf", "array<int>"), ("norm", "double")]
    # a norm needs neither strings nor a Python step
    plan = index.weights.groupBy("document_id").agg(F.sum(F.col("w") * F.col("w")))._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan


def test_stored_lists_hold_counts_and_answer_as_before(spark, corpus, tmp_path):
    """Stored twice (index and lists), the vectors moved as rows of strings with weights."""
    kw = {"root": str(tmp_path), "version": "1", "num_clusters": 3, "iterations": 2, "top_terms": 20, "max_features": 60}
    qs = spark.createDataFrame([(0, "w1 w2 w0"), (1, "가나 w5"), (2, "nothing here")], "qid long, question string")
    built = io.tfidf_ivf_persistent(spark, corpus, **kw)
    again = io.tfidf_ivf_persistent(spark, corpus, **kw)
    want = [tuple(r) for r in R.tfidf_topk(I.build_tfidf(I.prepare_corpus(corpus), max_features=60), qs, k=200).collect()]
    for ivf in (built, again):
        assert "array<struct" not in str(ivf.documents.dtypes) + str(ivf.tfidf.counts.dtypes)
        got = [tuple(r) for r in R.retrieve(qs, method="faiss", k=200, nprobe=3, index=ivf).collect()]
        assert {(q, d): 2 - s for q, _, d, s in got} == pytest.approx({(q, d): 2 * s for q, _, d, s in want}, abs=4e-6)
        assert ivf.lists.count() == ivf.tfidf.weights.count()


def test_runs_of_whitespace_as_python_sees_them(spark):
    """The pattern that passes over lone spaces changes what the plain class changes."""
    import itertools
    signs = [" ", "\t", "\x1c", "\xa0", " ", "a", "~", "é"]
    rows = [("".join(x),) for n in range(6) for x in itertools.product(signs, repeat=n)]
    got = spark.createDataFrame(rows, "s string").select("s", T.collapse_ws("s").alias("t")).collect()
    assert len(got) == len(rows) and all(r.t == " ".join(r.s.split()) for r in got)


def test_texts_are_split_where_they_are_counted(spark, corpus):
    """The JVM makes no token strings; before: they were split there and passed one by one."""
    tokens = I.document_tokens(I.prepare_corpus(corpus))
    assert tokens.schema["toks"].dataType.simpleString() == "string"
    texts = ["", " a  b ", "é", None, "a " * 50, "b"]
    want = [[t for t in (x or "").split(" ") if t] for x in texts]
    for size in (1, 10, 1000):
        mp = pytest.MonkeyPatch()
        mp.setattr(I, "TEXT_SLICE", size)
        got = [r or [] for part in I._slices(pa.array(texts).slice(0)) for r in part.to_pylist()]
        mp.undo()
        assert got == want
