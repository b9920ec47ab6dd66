"""Audits and guards: too-long questions, separator checks, alignment,
strict OOV mode, dedup counts, corpus statistics."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import decode as N
from quarry.operators import dedup as D
from quarry.operators import features as C
from quarry.operators import index as I
from quarry.operators import retrieve as R


def test_too_long_questions(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, " ".join(["q"] * 20))], "id long, question string")
    assert [r.id for r in C.too_long_questions(df, max_seq_length=24, doc_stride=4).collect()] == [2]
    ctx = df.withColumn("context", F.lit("x y z"))
    # no row is lost: it has a status, or the query fails
    w = C.reader_windows(ctx, max_seq_length=24, doc_stride=4, status="status").collect()
    assert {(r.example_id, r.status) for r in w} == {(1, "ok"), (2, "question_too_long")}
    assert [r.input_ids for r in w if r.example_id == 2] == [None]
    with pytest.raises(Exception, match="question too long"):
        C.reader_windows(ctx, max_seq_length=24, doc_stride=4).collect()


def test_separator_text_in_a_context_is_a_word(spark):
    df = spark.createDataFrame([(1, "t [SEP] what", "a [SEP] b [CLS] c")], "id long, question string, context string")
    w = C.reader_windows(df, max_seq_length=24, doc_stride=4)
    assert [sum(i == C.SEP_ID for i in r.input_ids) for r in w.collect()] == [3]
    assert len(C.merge_title_segment(w).first().input_ids) == len(w.first().input_ids) - 1


def test_rows_without_a_title_segment_stay(spark):
    df = spark.createDataFrame([(1, [2, 10, 3, 11, 3, 12, 3], 4), (2, [2, 10, 3, 12, 3], 3), (3, None, 0)],
                               "id long, input_ids array<int>, start_positions int")
    df = df.withColumns({"token_type_ids": F.transform("input_ids", lambda v: F.lit(0)),
                         "attention_mask": F.transform("input_ids", lambda v: F.lit(1)),
                         "end_positions": F.col("start_positions")})
    m = {r.id: r for r in C.merge_title_segment(df, status="status").collect()}
    assert {k: r.status for k, r in m.items()} == {1: "ok", 2: "no_title_segment", 3: "no_title_segment"}
    assert m[1].input_ids == [2, 10, 3, 11, 12, 3] and m[1].start_positions == 3
    assert m[2].input_ids == [2, 10, 3, 12, 3] and m[2].start_positions == 3
    with pytest.raises(Exception, match="three separators"):
        C.merge_title_segment(df).collect()


def test_bad_title_segments(spark):
    df = spark.createDataFrame([([2, 10, 3, 11, 3, 12, 3],), ([2, 10, 3, 12, 3],)], "input_ids array<int>")
    assert C.bad_title_segments(df).count() == 1


def test_check_features(spark):
    f = spark.createDataFrame([([None, {"s": 0, "e": 1}], [0.0, 1.0], [0.0, 1.0]),
                               ([None], [0.0, 1.0], [0.0])],
                              "offsets array<struct<s:int,e:int>>, start_logits array<double>, end_logits array<double>")
    assert N.check_features(f).count() == 1


def test_strict_oov(spark):
    corpus = spark.createDataFrame([(1, "t", "alpha beta")], "document_id long, title string, text string")
    idx = I.build_tfidf(I.prepare_corpus(corpus))
    qs = spark.createDataFrame([(1, "zzz"), (2, "yyy")], "qid long, question string")
    rep = R.oov_report(idx.vocab, qs, lambda c: I.tfidf_terms(c))
    with pytest.raises(ValueError):
        R.assert_not_all_oov(rep)
    qs2 = spark.createDataFrame([(1, "zzz"), (2, "alpha")], "qid long, question string")
    R.assert_not_all_oov(R.oov_report(idx.vocab, qs2, lambda c: I.tfidf_terms(c)))


def test_dedup_counts_and_corpus_stats(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "document_id long, clean string")
    r = D.dedup_counts(df, "clean").first()
    assert (r.n_before, r.n_after) == (3, 2)
    corpus = spark.createDataFrame([(1, "t", "a b a"), (2, "t", "a b a"), (3, "u", "c")],
                                   "document_id long, title string, text string")
    docs = I.prepare_corpus(corpus)
    idx = I.build_bm25(docs)
    st = I.corpus_stats(docs, idx.postings).first()
    # ptext = title + text: "t a b a", "u c"
    assert (st.n_docs, st.n_terms, st.n_postings) == (2, 5, 5)
    assert idx.n_docs == 2 and idx.avgdl == pytest.approx((4 + 2) / 2)
