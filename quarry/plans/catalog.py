"""Registered queries: one per implemented SURVEY §2 operator.

Each entry is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables (or
fixtures Spark derives from them). The matching DuckDB SQL is in
``quarry.plans.oracle_queries``. Every computed column is aliased to the same
name on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import dedup as D
from quarry.operators import evaluate as E
from quarry.operators import index as I
from quarry.operators import retrieve as R
from quarry.plans import fixtures as fx

QUERIES: dict = {}


def register(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _docs(spark, sf):
    return fx.table(spark, sf, "documents")


# ---------------------------------------------------------------- text (P, T)

@register("p6_preprocess")
def q_p6(spark, sf) -> DataFrame:
    d = _docs(spark, sf)
    return d.select("doc_id", T.preprocess(F.col("text")).alias("text_pp"))


@register("p2_allowlist_preprocess")
def q_p2(spark, sf) -> DataFrame:
    d = _docs(spark, sf)
    return d.select("doc_id", T.preprocess(F.col("text"), no_other_languages=True)
                    .alias("text_pp"))


@register("p7_eda_clean")
def q_p7(spark, sf) -> DataFrame:
    d = _docs(spark, sf)
    return d.select("doc_id", T.eda_clean(F.col("text")).alias("text_clean"))


@register("p11_normalize_answer")
def q_p11(spark, sf) -> DataFrame:
    b = fx.table(spark, sf, "benchmark")
    return b.select("item_id", T.normalize_answer(F.col("text")).alias("norm"))


@register("t1_whitespace_tokens")
def q_t1(spark, sf) -> DataFrame:
    d = _docs(spark, sf)
    t = T.whitespace_tokens(F.col("text"))
    return d.select("doc_id", F.size(t).alias("n_tokens"),
                    F.try_element_at(t, F.lit(1)).alias("first_token"),
                    F.try_element_at(t, F.lit(-1)).alias("last_token"))


# ---------------------------------------------------------------- dedup (J)

@register("j1_dedup_keep_first")
def q_j1(spark, sf) -> DataFrame:
    docs = I.prepare_corpus(fx.corpus(spark, sf))
    return docs.select("document_id", "title", F.length("ptext").alias("ptext_len"))


@register("j2_dedup_counts")
def q_j2(spark, sf) -> DataFrame:
    d = _docs(spark, sf).select(T.preprocess(F.col("text")).alias("clean"))
    return D.dedup_counts(d, "clean")


# ---------------------------------------------------------------- BM25

@register("i4_bm25_terms")
def q_i4(spark, sf) -> DataFrame:
    idx = I.build_bm25(I.prepare_corpus(fx.corpus(spark, sf)))
    return idx.terms.select("term", "df", F.round("idf", 6).alias("idf"))


@register("r5_bm25_topk")
def q_r5(spark, sf) -> DataFrame:
    idx = I.build_bm25(I.prepare_corpus(fx.corpus(spark, sf)))
    return R.bm25_topk(idx, fx.questions(spark, sf), k=10)


@register("e6_topk_accuracy_bm25")
def q_e6(spark, sf) -> DataFrame:
    idx = I.build_bm25(I.prepare_corpus(fx.corpus(spark, sf)))
    qs = fx.questions(spark, sf)
    ranked = R.bm25_topk(idx, qs, k=100)
    return E.topk_accuracy(ranked, fx.gold(spark, sf), qs, ks=(10, 20, 50, 100))


@register("i7_corpus_stats")
def q_i7(spark, sf) -> DataFrame:
    docs = I.prepare_corpus(fx.corpus(spark, sf))
    idx = I.build_bm25(docs)
    return I.corpus_stats(docs, idx.postings)


# ---------------------------------------------------------------- TF-IDF

def _tfidf(spark, sf):
    return I.build_tfidf(I.prepare_corpus(fx.corpus(spark, sf)))


@register("i2_tfidf_vocab")
def q_i2(spark, sf) -> DataFrame:
    v = _tfidf(spark, sf).vocab
    return v.select("term", "cf", "df", F.round("idf", 6).alias("idf"))


@register("i2_heaviest_terms")
def q_i2h(spark, sf) -> DataFrame:
    """I2 for a vocabulary of 300 terms: heaviest 1-2-grams by mergeable
    summaries of each task and an exact recount of what they leave."""
    from quarry.operators import heavy as H
    from quarry.session import materialize
    counted = materialize(I.document_terms(I.prepare_corpus(fx.corpus(spark, sf))), "term-counts")
    return H.top_terms(I.term_rows(counted), 300)


@register("i3_tfidf_doc_norms")
def q_i3(spark, sf) -> DataFrame:
    w = _tfidf(spark, sf).weights
    return w.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.round(F.sum(F.col("w") * F.col("w")), 6).alias("norm2"),
        F.round(F.max("w"), 6).alias("max_w"))


@register("r3_tfidf_topk")
def q_r3(spark, sf) -> DataFrame:
    return R.tfidf_topk(_tfidf(spark, sf), fx.questions(spark, sf), k=10)


@register("r1_oov_report")
def q_r1(spark, sf) -> DataFrame:
    idx = _tfidf(spark, sf)
    # questions plus their reversed-token variants (a realistic OOV mix)
    qs = fx.questions(spark, sf)
    rev = qs.select((F.col("qid") + 1000000).alias("qid"), F.reverse(F.col("question")).alias("question"))
    terms_of = lambda c: I.tfidf_terms(c, idx.tokenizer, idx.ngram_max)
    return R.oov_report(idx.vocab, qs.unionByName(rev), terms_of)


# ---------------------------------------------------------------- passages

def _clean_docs(spark, sf):
    """wiki->passage job: clean text (P6), exact dedup on it, keep first."""
    c = fx.corpus(spark, sf).withColumn("clean", T.preprocess(F.col("text")))
    kept = D.dedup_keep_first(c.select("document_id", "title", "clean"), "clean", "document_id")
    return kept.withColumn("toks", T.whitespace_tokens(F.col("clean"), normalized=True))


@register("c1_passages")
def q_c1(spark, sf) -> DataFrame:
    from quarry.operators import chunk as C
    p = C.passages(_clean_docs(spark, sf), "toks", 150, 50)
    return p.select("document_id", "window_index", F.length("text").alias("n_chars"),
                    F.size(F.split("text", " ")).alias("n_tokens"), F.sha2("text", 256).alias("h"))


@register("c2_passage_ids")
def q_c2(spark, sf) -> DataFrame:
    from quarry.operators import chunk as C
    p = C.numbered_passages(_clean_docs(spark, sf), T.whitespace_tokens("clean", normalized=True), 150, 50)
    return p.select("passage_id", "document_id", "title", "window_index",
                    F.sha2("text", 256).alias("h"))


# ---------------------------------------------------------------- evaluation

def _qa_pred(spark, sf):
    return fx.qa(spark, sf).join(fx.predictions(spark, sf), "id")


@register("e1_exact_match")
def q_e1(spark, sf) -> DataFrame:
    j = _qa_pred(spark, sf)
    em = F.array_max(F.transform("answers.text",
                                 lambda g: E.exact_match(F.col("prediction_text"), g)))
    return j.select("id", em.alias("em"))


@register("e2_char_f1")
def q_e2(spark, sf) -> DataFrame:
    j = _qa_pred(spark, sf)
    return j.select("id", F.round(E.max_over_truths(E.char_f1, F.col("prediction_text"),
                                                    F.col("answers.text")), 6).alias("f1"))


@register("e4_dataset_scores")
def q_e4(spark, sf) -> DataFrame:
    truth = fx.qa(spark, sf).select("id", F.col("answers.text").alias("answers"))
    return E.dataset_scores(truth, fx.predictions(spark, sf))


@register("e5_squad_scores")
def q_e5(spark, sf) -> DataFrame:
    truth = fx.qa(spark, sf).select("id", F.col("answers.text").alias("answers"))
    return E.squad_scores(truth, fx.predictions(spark, sf))


@register("j10_unanswered")
def q_j10(spark, sf) -> DataFrame:
    return E.unanswered(fx.qa(spark, sf), fx.predictions(spark, sf))


@register("e7_eval_table")
def q_e7(spark, sf) -> DataFrame:
    j = _qa_pred(spark, sf)
    return j.select("id", "prediction_text", "prediction_start",
                    F.element_at("answers.answer_start", 1).alias("answer_start"),
                    F.element_at("answers.text", 1).alias("answer_text"),
                    "context", "question")


@register("e8_pred_table")
def q_e8(spark, sf) -> DataFrame:
    j = _qa_pred(spark, sf)
    return j.select("id", "prediction_text", "prediction_start", "question", "context")


@register("e9_strict_match")
def q_e9(spark, sf) -> DataFrame:
    j = _qa_pred(spark, sf)
    return j.select("id", E.strict_match(
        F.col("prediction_text"), F.col("prediction_start"),
        F.element_at("answers.text", 1), F.element_at("answers.answer_start", 1)).alias("strict"))


@register("p9_question_decoration")
def q_p9(spark, sf) -> DataFrame:
    q = fx.qa(spark, sf)
    return q.select("id", T.decorate_question(F.col("question"), F.col("title")).alias("question"))


@register("p14_first_answer")
def q_p14(spark, sf) -> DataFrame:
    q = fx.qa(spark, sf)
    return q.select("id", F.get(F.col("answers.text"), 0).alias("answer_text"),
                    F.get(F.col("answers.answer_start"), 0).alias("answer_start"))


# ---------------------------------------------------------------- dense, IVF

@register("r6_dense_topk")
def q_r6(spark, sf) -> DataFrame:
    q, p = fx.vectors(spark, sf)
    return R.dense_topk(p, q, k=10, rows_per_block=128, queries_per_block=8).select(
        "qid", "rank", "pid", "score")


@register("r7_dense_doc_topk")
def q_r7(spark, sf) -> DataFrame:
    q, p = fx.vectors(spark, sf)
    return R.dense_topk(p, q, k=10, group_col="document_id", rows_per_block=128,
                        queries_per_block=8)


@register("i6_ivf_assign")
def q_i6(spark, sf) -> DataFrame:
    q, p = fx.vectors(spark, sf)
    cents = R.centroids_by_label(p)
    return R.ivf_assign(p, cents).select("pid", "cluster_id")


@register("i6_ivf_assign_blocks")
def q_i6b(spark, sf) -> DataFrame:
    """I6 as for a centroid table too large to broadcast: centroids stream
    past blocks of vectors."""
    _, p = fx.vectors(spark, sf)
    return R.ivf_assign(p, R.centroids_by_label(p), stream=False, rows_per_block=200).select("pid", "cluster_id")


@register("r8_ivf_topk")
def q_r8(spark, sf) -> DataFrame:
    q, p = fx.vectors(spark, sf)
    cents = R.centroids_by_label(p)
    return R.ivf_topk(R.ivf_assign(p, cents), q, cents, k=10, nprobe=1,
                      rows_per_block=64).select("qid", "rank", "pid", "score")


@register("i5_vector_table_stats")
def q_i5(spark, sf) -> DataFrame:
    q, p = fx.vectors(spark, sf)
    return p.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_vectors"),
                                        F.max(F.size("vec")).alias("dim"))


@register("e18_inbatch_contrastive")
def q_e18(spark, sf) -> DataFrame:
    return E.inbatch_contrastive(fx.pairs(spark, sf))


# ---------------------------------------------------------------- decoding

def _decoded(spark, sf, v2=False):
    from quarry.operators import decode as N
    return N.nbest(fx.reader_features(spark, sf), fx.qa(spark, sf), n_best=10,
                   max_answer_length=30, version_2_with_negative=v2, answers="answers")


@register("n13_nbest")
def q_n13(spark, sf) -> DataFrame:
    from quarry.operators import decode as N
    return N.nbest_long(_decoded(spark, sf))


@register("n10_best_answer")
def q_n10(spark, sf) -> DataFrame:
    return _decoded(spark, sf).select("example_id", "prediction_text", "prediction_start", "label")


@register("n11_best_answer_negative")
def q_n11(spark, sf) -> DataFrame:
    return _decoded(spark, sf, v2=True).select("example_id", "prediction_text",
                                                "prediction_start", "score_diff")


@register("n12_nbest_negative")
def q_n12(spark, sf) -> DataFrame:
    from quarry.operators import decode as N
    return N.nbest_long(_decoded(spark, sf, v2=True))


@register("n1_feature_alignment")
def q_n1(spark, sf) -> DataFrame:
    from quarry.operators import decode as N
    f = fx.reader_features(spark, sf)
    return f.agg(F.count(F.lit(1)).alias("n_features"),
                 N.check_features(f).select(F.count(F.lit(1))).scalar().alias("n_misaligned"))


@register("n2_top_positions")
def q_n2(spark, sf) -> DataFrame:
    from quarry.operators import decode as N
    f = fx.reader_features(spark, sf)
    return f.select("example_id", "window_index",
                    N.top_positions(F.col("start_logits"), 10).alias("top_start"),
                    N.top_positions(F.col("end_logits"), 10).alias("top_end"))


@register("e19_span_loss")
def q_e19(spark, sf) -> DataFrame:
    """Mean start/end cross entropy of the logits fixture against the C6
    labels of the same windows (positions clamped to [0, L], L ignored)."""
    from quarry.operators import features as C
    f = fx.reader_features(spark, sf)
    lab = C.span_labels_from_offsets(f, fx.qa(spark, sf))
    s_ce, e_ce = E.span_loss(F.col("start_logits"), F.col("end_logits"),
                             F.col("start_positions"), F.col("end_positions"))
    return lab.select("example_id", "window_index", F.round((s_ce + e_ce) / 2, 6).alias("loss"))


# ---------------------------------------------------------------- features

def _windows(spark, sf, decorate=False):
    from quarry.operators import features as C
    q = fx.qa(spark, sf)
    if decorate:
        q = q.withColumn("question", T.decorate_question(F.col("question"), F.col("title")))
    return C.reader_windows(q, max_seq_length=48, doc_stride=8)


@register("c3_reader_windows")
def q_c3(spark, sf) -> DataFrame:
    w = _windows(spark, sf)
    return w.select("example_id", "window_index", "input_ids", "token_type_ids", "attention_mask",
                    F.transform("offset_mapping", lambda o: o["s"]).alias("offset_start"),
                    F.transform("offset_mapping", lambda o: o["e"]).alias("offset_end"))


@register("c6_span_labels")
def q_c6(spark, sf) -> DataFrame:
    from quarry.operators import features as C
    f = C.with_span_labels(_windows(spark, sf), fx.qa(spark, sf))
    return f.select("example_id", "window_index", "start_positions", "end_positions",
                    C.answerability("start_positions").alias("answerable"))


@register("c7_title_segments")
def q_c7(spark, sf) -> DataFrame:
    from quarry.operators import features as C
    f = C.with_span_labels(_windows(spark, sf, decorate=True), fx.qa(spark, sf))
    m = C.merge_title_segment(f)
    return m.select("example_id", "window_index", "input_ids", "token_type_ids",
                    "start_positions", "end_positions")


@register("c8_answer_centred")
def q_c8(spark, sf) -> DataFrame:
    from quarry.operators import features as C
    a = C.answer_centred(fx.qa(spark, sf), max_passage_length=16)
    return a.select("id", "window_start", "p_input_ids", "p_attention_mask")


@register("c10_batch_padding")
def q_c10(spark, sf) -> DataFrame:
    from quarry.operators import features as C
    b = C.batch_pad(fx.mlm_rows(spark, sf), "row_id", batch_size=8, pad_to_multiple_of=8)
    return b.select("row_id", "row_index", "batch_id", F.size("input_ids").alias("padded_len"),
                    F.element_at("input_ids", -1).alias("last_id"))


@register("c11_mlm_mask")
def q_c11(spark, sf) -> DataFrame:
    from quarry.operators import features as C
    return C.mlm_mask(fx.mlm_rows(spark, sf)).select("row_id", "input_ids", "labels")


@register("c13_span_mask")
def q_c13(spark, sf) -> DataFrame:
    from quarry.operators import features as C
    m = C.mlm_mask(fx.mlm_rows(spark, sf), ner="ner_map", span_masking=True, mlm_probability=0.3)
    return m.select("row_id", "input_ids", "labels")


@register("c14_causal_labels")
def q_c14(spark, sf) -> DataFrame:
    from quarry.operators import features as C
    b = C.batch_pad(fx.mlm_rows(spark, sf), "row_id", batch_size=8)
    return b.select("row_id", C.causal_labels(F.col("input_ids")).alias("labels"))


# ---------------------------------------------------------------- profiles

@register("p15_substring_search")
def q_p15(spark, sf) -> DataFrame:
    from quarry.operators import profile as P
    return P.substring_search(_docs(spark, sf), "ion d").select("doc_id")


@register("p16_length_outliers")
def q_p16(spark, sf) -> DataFrame:
    from quarry.operators import profile as P
    return P.length_outliers(_docs(spark, sf), 20000).select(
        "doc_id", F.length("text").alias("n_chars"))


def _overlap(spark, sf):
    from quarry.operators import profile as P
    p = fx.overlap_pairs(spark, sf)
    x = p.select("conv_id", "turn", "question", "context",
                 T.whitespace_tokens("question").alias("qt"), T.whitespace_tokens("context").alias("ct"))
    shared, ratio = P.token_overlap(F.col("qt"), F.col("ct"))
    return x.select("conv_id", "turn", "question", "context", F.size("qt").alias("n_q_tokens"),
                    F.size(shared).alias("n_shared"), F.round(ratio, 6).alias("ratio"),
                    F.array_join(shared, " ").alias("shared"))


@register("e13_token_overlap")
def q_e13(spark, sf) -> DataFrame:
    return _overlap(spark, sf).select("conv_id", "turn", "n_q_tokens", "n_shared", "ratio", "shared")


@register("r13_overlap_lowest")
def q_r13a(spark, sf) -> DataFrame:
    from quarry.operators import profile as P
    o = _overlap(spark, sf)
    return P.top_n(o, 10, F.col("ratio").asc(), "conv_id", "turn").select("conv_id", "turn", "ratio")


@register("r13_overlap_highest")
def q_r13b(spark, sf) -> DataFrame:
    from quarry.operators import profile as P
    o = _overlap(spark, sf)
    return P.top_n(o, 10, F.col("ratio").desc(), "conv_id", "turn").select("conv_id", "turn", "ratio")


@register("r13_longest_documents")
def q_r13c(spark, sf) -> DataFrame:
    from quarry.operators import profile as P
    d = _docs(spark, sf).select("doc_id", F.length("text").alias("n_chars"))
    return P.top_n(d, 100, F.col("n_chars").desc(), "doc_id")


@register("s9_overlap_report")
def q_s9(spark, sf) -> DataFrame:
    from quarry.operators import report as RP
    o = _overlap(spark, sf)
    return o.select("conv_id", "turn", RP.overlap_report(
        F.col("conv_id"), F.col("context"), F.col("question"), F.lit(""), F.col("shared"),
        F.col("ratio")).alias("report"))


@register("e14_length_histogram")
def q_e14(spark, sf) -> DataFrame:
    from quarry.operators import profile as P
    return P.length_histogram(_docs(spark, sf))


@register("e14_length_summary")
def q_e14s(spark, sf) -> DataFrame:
    from quarry.operators import profile as P
    return P.length_summary(_docs(spark, sf))


@register("e15_joined_length")
def q_e15(spark, sf) -> DataFrame:
    from quarry.operators import profile as P
    return P.joined_length(_docs(spark, sf))


@register("e16_special_chars")
def q_e16(spark, sf) -> DataFrame:
    from quarry.operators import profile as P
    return P.special_chars(_docs(spark, sf))


@register("j12_special_chars_in_answers")
def q_j12(spark, sf) -> DataFrame:
    from quarry.operators import profile as P
    chars = P.special_chars(_docs(spark, sf))
    ans = fx.qa(spark, sf).select(F.element_at("answers.text", 1).alias("answer_text"))
    return P.special_chars_in_answers(chars, ans)


@register("e17_micro_f1")
def q_e17(spark, sf) -> DataFrame:
    from quarry.operators import profile as P
    return P.micro_f1(fx.table(spark, sf, "labels"), "toxic", "quality")


# ---------------------------------------------------------------- reports

def _eval_rows(spark, sf):
    j = _qa_pred(spark, sf)
    return j.select("id", "question", "context", "prediction_text", "prediction_start",
                    F.element_at("answers.text", 1).alias("answer_text"),
                    F.element_at("answers.answer_start", 1).alias("answer_start"))


@register("e10_highlight_eval")
def q_e10(spark, sf) -> DataFrame:
    from quarry.operators import report as RP
    r = _eval_rows(spark, sf)
    return r.select("id", RP.highlight_eval("context", "prediction_start", "prediction_text",
                                            "answer_start", "answer_text").alias("html"))


@register("e11_highlight_pred")
def q_e11(spark, sf) -> DataFrame:
    from quarry.operators import report as RP
    r = _eval_rows(spark, sf)
    return r.select("id", RP.highlight_pred("context", "prediction_start", "prediction_text").alias("html"))


@register("e12_eval_paragraphs")
def q_e12(spark, sf) -> DataFrame:
    from quarry.operators import report as RP
    r = _eval_rows(spark, sf)
    m = E.strict_match(F.col("prediction_text"), F.col("prediction_start"),
                       F.col("answer_text"), F.col("answer_start"))
    para = RP.highlight_eval("context", "prediction_start", "prediction_text",
                             "answer_start", "answer_text")
    return r.select("id", RP.eval_paragraph(F.col("id"), F.col("question"), m, para).alias("fragment"))


@register("e12_pred_paragraphs")
def q_e12p(spark, sf) -> DataFrame:
    from quarry.operators import report as RP
    r = _eval_rows(spark, sf)
    para = RP.highlight_pred("context", "prediction_start", "prediction_text")
    return r.select("id", RP.pred_paragraph(F.col("id"), F.col("question"), para).alias("fragment"))


# ---------------------------------------------------------------- more text, tokens, joins

@register("p8_title_prefix")
def q_p8(spark, sf) -> DataFrame:
    c = fx.corpus(spark, sf)
    return c.select("document_id", T.title_prefixed(F.col("title"), T.preprocess(F.col("text")))
                    .alias("ptext"))


@register("p10_title_text_join")
def q_p10(spark, sf) -> DataFrame:
    t = fx.titles(spark, sf)
    return t.select("page_id", "title", T.title_text_join(F.col("title"), F.col("text")).alias("passage"))


@register("p13_column_resolution")
def q_p13(spark, sf) -> DataFrame:
    from quarry.operators.columns import resolve_columns
    b = fx.table(spark, sf, "benchmark")
    return resolve_columns(b, ["item_id", "question"])


@register("p17_drop_token_type_ids")
def q_p17(spark, sf) -> DataFrame:
    from quarry.operators.columns import drop_if_present
    w = drop_if_present(_windows(spark, sf), "token_type_ids", "offset_mapping")
    return w.select("example_id", "window_index", "input_ids", "attention_mask")


@register("t3_token_offsets")
def q_t3(spark, sf) -> DataFrame:
    d = _docs(spark, sf).select("doc_id", T.token_offsets(F.col("text")).alias("o"))
    return d.select("doc_id", F.size("o").alias("n_tokens"),
                    F.transform("o", lambda x: x["s"]).alias("starts"),
                    F.transform("o", lambda x: x["e"]).alias("ends"))


@register("t4_join_tokens")
def q_t4(spark, sf) -> DataFrame:
    d = _docs(spark, sf)
    return d.select("doc_id", T.join_tokens(T.whitespace_tokens(F.col("text"))).alias("joined"))


@register("i1_word_ngrams")
def q_i1(spark, sf) -> DataFrame:
    d = _docs(spark, sf).select("doc_id", T.whitespace_tokens(F.lower("text")).alias("t"))
    g = d.select("doc_id", T.word_ngrams(F.col("t"), 2).alias("g"), F.size("t").alias("n"))
    # a text without tokens has no n-grams, a null text neither
    return g.select("doc_id", F.coalesce(F.size("g"), F.lit(0)).alias("n_grams"),
                    F.try_element_at("g", F.col("n") + 1).alias("first_bigram"),
                    F.try_element_at("g", F.lit(-1)).alias("last_gram"))


@register("j3_union_splits")
def q_j3(spark, sf) -> DataFrame:
    q = fx.qa(spark, sf)
    train = q.filter(F.pmod("id", F.lit(2)) == 0).withColumn("split", F.lit("train"))
    val = q.filter(F.pmod("id", F.lit(2)) == 1).withColumn("split", F.lit("validation"))
    return train.unionByName(val).select("id", "split", "question")


def _bm25_top(spark, sf, k):
    raw = fx.corpus(spark, sf)
    docs = I.prepare_corpus(raw)
    return raw, R.bm25_topk(I.build_bm25(docs), fx.questions(spark, sf), k=k)


@register("j7_document_lookup")
def q_j7(spark, sf) -> DataFrame:
    docs, top = _bm25_top(spark, sf, 3)
    j = R.attach_documents(top, docs, max_rows=fx.questions(spark, sf).count() * 3)
    return j.select("qid", "rank", "document_id", "title", F.length("context").alias("n_chars"))


@register("r9_retrieved_table")
def q_r9(spark, sf) -> DataFrame:
    docs, top = _bm25_top(spark, sf, 3)
    t = R.retrieved_table(top, docs, fx.questions(spark, sf), k=3)
    return t.select("qid", "question", "title", "document_id",
                    F.transform("context", lambda c: F.length(c)).alias("context_chars"))


@register("c4_multi_context")
def q_c4(spark, sf) -> DataFrame:
    from quarry.operators import features as C
    docs, top = _bm25_top(spark, sf, 3)
    t = R.retrieved_table(top, docs, fx.questions(spark, sf), k=3)
    # Reader input in predict mode (id, question, title[], context[])
    reader_in = t.select(F.col("qid").alias("id"), "question", "title", "context")
    f = C.multi_context(reader_in)
    return f.select("id", "context_index", "title", F.length("context").alias("n_chars"))


@register("j8_passage_document_audit")
def q_j8(spark, sf) -> DataFrame:
    """Passages are built from text-deduplicated documents, the retriever
    corpus from title+text-deduplicated ones: passage documents missing from
    the retriever corpus (the reference raises on them)."""
    from quarry.operators import chunk as C
    p = C.passages(_clean_docs(spark, sf), "toks", 150, 50).select("document_id").distinct()
    docs = I.prepare_corpus(fx.corpus(spark, sf)).select("document_id")
    return p.join(docs, "document_id", "left_anti")


@register("j9_features_per_example")
def q_j9(spark, sf) -> DataFrame:
    w = _windows(spark, sf)
    return w.groupBy("example_id").agg(F.count(F.lit(1)).alias("n_windows"),
                                       F.max("window_index").alias("last_window"))


@register("c9_pad_truncate")
def q_c9(spark, sf) -> DataFrame:
    from quarry.operators import features as C
    m = fx.mlm_rows(spark, sf)
    return m.select("row_id", C.pad_to_length(F.col("input_ids"), 64).alias("input_ids"))


# ---------------------------------------------------------------- sources and sinks

@register("s1_corpus_jsonl_roundtrip")
def q_s1(spark, sf) -> DataFrame:
    from quarry.sources import io
    path = io.scratch_path(spark, "corpus.jsonl")
    fx.corpus(spark, sf).write.json(path)
    c = io.read_corpus_jsonl(spark, path)
    return c.select("document_id", "title", F.length("text").alias("n_chars"))


@register("s2_qa_split_scan")
def q_s2(spark, sf) -> DataFrame:
    from quarry.sources import io
    path = io.scratch_path(spark, "qa")
    q = fx.qa(spark, sf).withColumn("split", F.when(F.pmod("id", F.lit(2)) == 0, "train")
                                    .otherwise("validation"))
    io.write_qa(q, path)
    v = io.read_qa_split(spark, path, "validation")
    return v.select("id", "question", F.element_at("answers.text", 1).alias("answer_text"))


@register("s3_passages_roundtrip")
def q_s3(spark, sf) -> DataFrame:
    from quarry.operators import chunk as C
    from quarry.sources import io
    path = io.scratch_path(spark, "passages")
    io.write_passages(C.numbered_passages(_clean_docs(spark, sf), "toks", 150, 50), path)
    p = io.read_passages(spark, path)
    return p.select("passage_id", "document_id", "title", "window_index", F.sha2("text", 256).alias("h"))


@register("s4_bm25_persistent_topk")
def q_s4(spark, sf) -> DataFrame:
    from quarry.sources import io
    src = fx.corpus(spark, sf)
    root = io.scratch_path(spark, "indexes")
    idx, _ = io.bm25_persistent(spark, src, root=root)
    return R.bm25_topk(idx, fx.questions(spark, sf), k=10)


@register("s5_predictions_json")
def q_s5(spark, sf) -> DataFrame:
    from quarry.sources import io
    out = io.scratch_path(spark, "out")
    paths = io.write_predictions(_decoded(spark, sf), out, prefix="val")
    return spark.read.schema("example_id long, prediction_text string, prediction_start int").json(
        paths["predictions"])


@register("s7_result_csv_roundtrip")
def q_s7(spark, sf) -> DataFrame:
    from quarry.sources import io
    path = io.scratch_path(spark, "result.csv")
    e7 = QUERIES["e7_eval_table"](spark, sf)
    io.write_csv(e7, path)
    return io.read_csv(spark, path, schema=e7.schema)


@register("s8_metrics_table")
def q_s8(spark, sf) -> DataFrame:
    from quarry.sources import io
    m = QUERIES["e4_dataset_scores"](spark, sf).select("em", "f1", "n_total", "n_unanswered")
    return io.metrics_table(m)


@register("p1_p5_cleaning_steps")
def q_p1_p5(spark, sf) -> DataFrame:
    d = _docs(spark, sf)
    p1 = T.unescape_newlines(F.col("text"))
    return d.select("doc_id", p1.alias("p1"), T.unify_quotes(p1).alias("p3"),
                    T.drop_empty_brackets(p1).alias("p4"), T.collapse_ws(F.col("text")).alias("p5"))


@register("p12_projection_by_mode")
def q_p12(spark, sf) -> DataFrame:
    from quarry.operators.columns import by_mode
    e = by_mode(fx.qa(spark, sf), "eval")
    return e.select("id", "question", "title", "context", F.col("answers.text").alias("answer_texts"))


@register("s4_tfidf_persistent_topk")
def q_s4t(spark, sf) -> DataFrame:
    from quarry.sources import io
    src = fx.corpus(spark, sf)
    idx = io.tfidf_persistent(spark, src, root=io.scratch_path(spark, "ix"))
    return R.tfidf_topk(idx, fx.questions(spark, sf), k=10)


@register("s4_ivf_persistent_topk")
def q_s4i(spark, sf) -> DataFrame:
    from quarry.sources import io
    q, p = fx.vectors(spark, sf)
    vecs, cents = io.ivf_persistent(spark, p, R.centroids_by_label(p),
                                    root=io.scratch_path(spark, "ix"))
    return R.ivf_topk(vecs, q, cents, k=10, nprobe=1, rows_per_block=64).select(
        "qid", "rank", "pid", "score")


@register("e4_scores_json")
def q_e4j(spark, sf) -> DataFrame:
    return E.scores_json(QUERIES["e4_dataset_scores"](spark, sf))


@register("e6_topk_accuracy_by_context")
def q_e6c(spark, sf) -> DataFrame:
    """E6 as the source scores it: original context = the text of the
    question's smallest containing document (none -> never answered)."""
    raw = fx.corpus(spark, sf)
    idx = I.build_bm25(I.prepare_corpus(raw))
    qs = fx.questions(spark, sf)
    ranked = R.bm25_topk(idx, qs, k=100)
    orig = (fx.gold(spark, sf).groupBy("qid").agg(F.min("document_id").alias("document_id"))
            .join(raw.select("document_id", "text"), "document_id")
            .select("qid", F.col("text").alias("context")))
    with_ctx = qs.join(orig, "qid", "left")
    return E.topk_accuracy_by_context(ranked, raw, with_ctx, ks=(10, 20, 50, 100))


@register("i6_kmeans_ivf_assign")
def q_i6k(spark, sf) -> DataFrame:
    """I6 with learned centroids (Spark ML KMeans, 10 clusters, fixed seed).
    Iterative, so no SQL oracle: the driver checks rows only; the recall of
    full probing against exact search is a unit test."""
    q, p = fx.vectors(spark, sf)
    cents = R.kmeans_centroids(p, num_clusters=10, seed=42)
    return R.ivf_assign(p, cents).select("pid", "cluster_id")


# ------------------------------------------- rows that had no query of their own

@register("t2_letter_tokenizer_terms")
def q_t2(spark, sf) -> DataFrame:
    """The BM25 statistics under another tokenizer (runs of letters)."""
    letters = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    idx = I.build_bm25(I.prepare_corpus(fx.corpus(spark, sf)), tokenizer=letters)
    return idx.terms.select("term", "df", F.round("idf", 6).alias("idf"))


def _first_question(spark, sf) -> str:
    """The text of the smallest benchmark item: one question for R2, R4, R10."""
    return fx.questions(spark, sf).orderBy("qid").limit(1).first()["question"]


def _one(spark, sf, method: str) -> DataFrame:
    raw = fx.corpus(spark, sf)
    top = R.retrieve_one(spark, _first_question(spark, sf), I.prepare_corpus(raw), raw, method, k=10)
    return top.select("rank", "document_id", "score", "title", "context")


@register("r4_r10_bm25_one_question")
def q_r4(spark, sf) -> DataFrame:
    return _one(spark, sf, "bm25")


@register("r2_r10_tfidf_one_question")
def q_r2(spark, sf) -> DataFrame:
    return _one(spark, sf, "tfidf")


@register("r11_method_dispatch")
def q_r11(spark, sf) -> DataFrame:
    """The four methods through one function, as one table."""
    q, p = fx.vectors(spark, sf)
    docs = I.prepare_corpus(fx.corpus(spark, sf))
    qs = fx.questions(spark, sf)
    out = None
    for method in R.METHODS:
        top = R.retrieve(qs, docs, method, k=10, passages=p, query_vectors=q,
                         centroids=R.centroids_by_label(p))
        top = top.select(F.lit(method).alias("method"), "qid", "rank", "document_id", "score")
        out = top if out is None else out.unionByName(top)
    return out


@register("r5_bm25_padded_negative")
def q_r5n(spark, sf) -> DataFrame:
    """R5 over the vowels of the texts: terms that are in more than half of the
    documents, so that scores are negative, padded to k with score-0 documents."""
    docs, qs = fx.common_terms(spark, sf)
    return R.bm25_topk(I.build_bm25(docs), qs, k=10, pad_zero=True, docs=docs)


@register("r9_retrieved_with_truth")
def q_r9t(spark, sf) -> DataFrame:
    raw, top = _bm25_top(spark, sf, 3)
    qs = fx.qa(spark, sf).withColumnRenamed("id", "qid")
    t = R.retrieved_table(top, raw, qs, k=3)
    return t.select("qid", "question", "title", "document_id", F.transform("context", lambda c: F.sha2(c, 256)).alias("context_sha"),
                    "original_context", "original_document_id", F.element_at("answers.text", 1).alias("answer"),
                    F.element_at("answers.answer_start", 1).alias("answer_start"))


@register("e3_max_over_truths")
def q_e3(spark, sf) -> DataFrame:
    """E3 with three truths an id: the answer, its first token, the question."""
    j = _qa_pred(spark, sf)
    a = F.col("answers.text")[0]
    truths = F.array(a, F.element_at(F.split(a, " "), 1), F.col("question"))
    return j.select("id", E.max_over_truths(E.exact_match, F.col("prediction_text"), truths).alias("em"),
                    F.round(E.max_over_truths(E.char_f1, F.col("prediction_text"), truths), 6).alias("f1"))


@register("n4_max_context_nbest")
def q_n4(spark, sf) -> DataFrame:
    """Start positions whose max-context flag is absent or false go."""
    from quarry.operators import decode as N
    f = fx.reader_features(spark, sf)
    kept = F.filter(F.sequence(F.lit(0), F.size("offsets") - 1), lambda p: p % 3 != 0)
    f = f.withColumn("flags", F.map_from_arrays(F.transform(kept, lambda p: p.cast("string")),
                                                F.transform(kept, lambda p: p % 3 == 1)))
    return N.nbest_long(N.nbest(f, fx.qa(spark, sf), n_best=10, max_answer_length=30, max_context="flags"))


@register("s5_nbest_json")
def q_s5n(spark, sf) -> DataFrame:
    """The n-best file, read back."""
    from quarry.sources import io
    paths = io.write_predictions(_decoded(spark, sf, v2=True), io.scratch_path(spark, "out"),
                                 version_2_with_negative=True)
    lists = spark.read.schema("example_id long, nbest array<struct<rank:int, text:string, probability:double>>").json(
        paths["nbest_predictions"])
    return lists.select("example_id", F.explode("nbest").alias("b")).select(
        "example_id", F.col("b.rank").alias("rank"), F.col("b.text").alias("text"),
        F.round("b.probability", 6).alias("probability"))


@register("s5_null_odds_json")
def q_s5o(spark, sf) -> DataFrame:
    """The null-odds file, read back."""
    from quarry.sources import io
    paths = io.write_predictions(_decoded(spark, sf, v2=True), io.scratch_path(spark, "out"),
                                 version_2_with_negative=True)
    return spark.read.schema("example_id long, score_diff double").json(paths["null_odds"]).select(
        "example_id", F.round("score_diff", 6).alias("score_diff"))


@register("s9_report_file")
def q_s9f(spark, sf) -> DataFrame:
    """Reports with the answer (the context's first ten characters) written
    as text and read back: every line with its count."""
    from quarry.operators import report as RP
    from quarry.sources import io
    o = _overlap(spark, sf)
    path = io.scratch_path(spark, "report.txt")
    io.write_text(o.select(RP.overlap_report(
        F.col("conv_id"), F.col("context"), F.col("question"), F.left("context", F.lit(10)),
        F.col("shared"), F.col("ratio")).alias("report")), "report", path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@register("i6_kmeans_assignment")
def q_i6a(spark, sf) -> DataFrame:
    """I6 with learned centroids: whether each vector's cluster is a nearest
    one (to 6 places), by distances computed again from the stored centroids."""
    q, p = fx.vectors(spark, sf)
    cents = R.kmeans_centroids(p, num_clusters=10, seed=42)
    own = R.ivf_assign(p, cents).select("pid", "cluster_id", F.col("vec").cast("array<double>").alias("vec"))
    models = cents.agg(F.collect_list(F.struct("cluster_id", "centroid")).alias("m")).first()["m"]  # 10 rows
    far = lambda c: F.aggregate(F.zip_with("vec", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    by_id = {r["cluster_id"]: F.array(*[F.lit(float(x)) for x in r["centroid"]]) for r in models}
    nearest = F.least(*[far(c) for c in by_id.values()])
    chosen = F.coalesce(*[F.when(F.col("cluster_id") == i, far(c)) for i, c in by_id.items()])
    return own.select("pid", (F.abs(chosen - nearest) < 1e-6).alias("is_nearest"))


# ------------------------------------------- IVF over TF-IDF vectors

def _source_labels(docs):
    """One cluster a title (``source``), numbered in their order."""
    from pyspark.sql import Window
    docs = docs.select("dkey", "document_id", "title")
    names = docs.select("title").distinct()  # a handful of sources
    numbers = names.withColumn("cluster_id", F.row_number().over(Window.orderBy("title")) - 1)
    return docs.join(F.broadcast(numbers), docs["title"].eqNullSafe(numbers["title"])).select("dkey", "document_id", "cluster_id")


def _source_ivf(spark, sf):
    from quarry.operators import sparse_ivf as V
    from quarry.session import materialize
    docs = materialize(I.prepare_corpus(fx.corpus(spark, sf)), "prepared-documents")
    idx = I.build_tfidf(docs)
    return V.build_lists(idx, V.centroids_by_label(idx, _source_labels(docs), top_terms=500))


@register("i6_tfidf_ivf_assign")
def q_i6t(spark, sf) -> DataFrame:
    """I6 over TF-IDF vectors: the nearest of the sources' mean vectors."""
    lists = _source_ivf(spark, sf).lists
    return lists.select("document_id", "cluster_id").distinct()


@register("r8_tfidf_ivf_topk")
def q_r8t(spark, sf) -> DataFrame:
    """R8 over TF-IDF vectors: three nearest lists of each question."""
    from quarry.operators import sparse_ivf as V
    return V.topk(_source_ivf(spark, sf), fx.questions(spark, sf), k=10, nprobe=3)


@register("r8_tfidf_kmeans_full_probe")
def q_r8f(spark, sf) -> DataFrame:
    """R8 with learned centroids, all lists probed: exact search."""
    from quarry.operators import sparse_ivf as V
    idx = _tfidf(spark, sf)
    ivf = V.build_lists(idx, V.kmeans(idx, num_clusters=16, iterations=4, top_terms=500))
    return V.topk(ivf, fx.questions(spark, sf), k=10, nprobe=16)


@register("r8_tfidf_kmeans_recall")
def q_r8k(spark, sf) -> DataFrame:
    """Learned centroids, a quarter of the lists probed: of the ten nearest
    documents of each question, how many are found."""
    from quarry.operators import sparse_ivf as V
    idx = _tfidf(spark, sf)
    ivf = V.build_lists(idx, V.kmeans(idx, num_clusters=16, iterations=4, top_terms=500))
    qs = fx.questions(spark, sf)
    exact = R.tfidf_topk(idx, qs, k=10).select("qid", "document_id")
    found = V.topk(ivf, qs, k=10, nprobe=4).select("qid", "document_id", F.lit(1).alias("hit"))
    return exact.join(found, ["qid", "document_id"], "left").groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_found"))


@register("r8_sq8_ivf_topk")
def q_r8q(spark, sf) -> DataFrame:
    """R8 over 8-bit codes: the scan reads codes, the candidates that the
    bounds leave are ranked by their full vectors."""
    from quarry.operators import quantize as Z
    q, p = fx.vectors(spark, sf)
    cents = R.centroids_by_label(p)
    index = Z.build(R.ivf_assign(p, cents), cents)
    return Z.coded_topk(index, q, k=10, nprobe=1)


@register("r5_bm25_impact_topk")
def q_r5i(spark, sf) -> DataFrame:
    """R5 with impact bounds: frequent terms are scored only for documents that
    can still reach a question's threshold."""
    from quarry.operators import impacts as M
    idx = I.build_bm25(I.prepare_corpus(fx.corpus(spark, sf)))
    return M.topk(M.build(idx, block_docs=16), fx.questions(spark, sf), k=10)


@register("s4_tfidf_ivf_persistent_topk")
def q_s4v(spark, sf) -> DataFrame:
    """The stored IVF over TF-IDF vectors, all lists probed."""
    from quarry.sources import io
    index = io.tfidf_ivf_persistent(spark, fx.corpus(spark, sf), root=io.scratch_path(spark, "ix"), num_clusters=16,
                                    iterations=3, top_terms=500, rows_per_file=20_000)
    return R.retrieve(fx.questions(spark, sf), method="faiss", k=10, nprobe=16, index=index)


@register("s4_sq8_persistent_topk")
def q_s4q(spark, sf) -> DataFrame:
    """The stored 8-bit index, lists in several files."""
    from quarry.sources import io
    q, p = fx.vectors(spark, sf)
    index = io.coded_persistent(spark, p, R.centroids_by_label(p), root=io.scratch_path(spark, "ix"), rows_per_file=50)
    return R.retrieve(None, method="faiss", k=10, query_vectors=q, index=index).select("qid", "rank", "pid", "score")


@register("r11_method_dispatch_stored")
def q_r11s(spark, sf) -> DataFrame:
    """R11 over stored indexes: BM25, TF-IDF and IVF over TF-IDF vectors (all
    lists probed) answer the same questions."""
    from quarry.sources import io
    src, qs, root = fx.corpus(spark, sf), fx.questions(spark, sf), io.scratch_path(spark, "ix")
    bm25, _ = io.bm25_persistent(spark, src, root=root)
    tfidf = io.tfidf_persistent(spark, src, root=root)
    ivf = io.tfidf_ivf_persistent(spark, src, root=root, num_clusters=8, iterations=2, top_terms=300)
    parts = [R.retrieve(qs, method=m, k=5, index=i, nprobe=8).withColumn("method", F.lit(m))
             for m, i in (("bm25", bm25), ("tfidf", tfidf), ("faiss", ivf))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("s6_scores_from_files")
def q_s6(spark, sf) -> DataFrame:
    """Truth and prediction files, a record a line, scored as E4."""
    from quarry.sources import io
    root = io.scratch_path(spark, "s6")
    io.write_ground_truth_lines(fx.qa(spark, sf).select("id", F.col("answers.text").alias("answers")), f"{root}/truth")
    io.write_prediction_lines(fx.predictions(spark, sf), f"{root}/predictions")
    return E.dataset_scores(io.read_ground_truth(spark, f"{root}/truth", lines=True),
                            io.read_prediction_object(spark, f"{root}/predictions", lines=True))
