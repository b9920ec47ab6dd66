"""Oracle SQL (DuckDB) for each registered query in ``quarry.plans.catalog``."""

from __future__ import annotations

from quarry.plans import oracle as O

SQL: dict[str, str] = {}


def sql(name):
    def deco(fn):
        SQL[name] = fn()
        return fn
    return deco


@sql("p6_preprocess")
def _p6():
    return f"SELECT doc_id, {O.p6('text')} AS text_pp FROM documents"


@sql("p2_allowlist_preprocess")
def _p2():
    return f"SELECT doc_id, {O.p6('text', no_other_languages=True)} AS text_pp FROM documents"


@sql("p7_eda_clean")
def _p7():
    return f"SELECT doc_id, {O.p7('text')} AS text_clean FROM documents"


@sql("p11_normalize_answer")
def _p11():
    return f"SELECT item_id, {O.p11('text')} AS norm FROM benchmark"


@sql("t1_whitespace_tokens")
def _t1():
    t = O.tok_raw("text")
    return f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, t[1] AS first_token,
                      t[-1] AS last_token
               FROM (SELECT doc_id, {t} AS t FROM documents)"""


@sql("j1_dedup_keep_first")
def _j1():
    return f"""WITH {O.corpus_ctes()}
SELECT document_id, title, CAST(length(ptext) AS INTEGER) AS ptext_len FROM docs"""


@sql("j2_dedup_counts")
def _j2():
    return f"""SELECT count(*) AS n_before, count(DISTINCT c) AS n_after
FROM (SELECT {O.p6('text')} AS c FROM documents)"""


@sql("i4_bm25_terms")
def _i4():
    return f"WITH {O.bm25_ctes()}\nSELECT term, df, round(idf, 6) AS idf FROM terms"


@sql("r5_bm25_topk")
def _r5():
    return f"WITH {O.bm25_ctes()}\n{O.topk_select('bm25', 10)}"


@sql("e6_topk_accuracy_bm25")
def _e6():
    return f"""WITH {O.bm25_ctes()}, {O.gold_cte()},
ranked AS ({O.topk_select('bm25', 100)}),
first AS (SELECT qid, min(rank) AS first_rank FROM ranked SEMI JOIN gold USING (qid, document_id) GROUP BY qid),
perq AS (SELECT qs.qid, first_rank FROM qs LEFT JOIN first USING (qid)),
ks AS (SELECT unnest([10, 20, 50, 100]) AS k)
SELECT CAST(k AS INTEGER) AS k, CAST(sum(CASE WHEN first_rank <= k THEN 1 ELSE 0 END) AS BIGINT) AS hits,
       count(*) AS n_questions,
       round(sum(CASE WHEN first_rank <= k THEN 1 ELSE 0 END) / count(*), 6) AS accuracy
FROM perq, ks GROUP BY k"""


@sql("i7_corpus_stats")
def _i7():
    return f"""WITH {O.bm25_ctes()}
SELECT (SELECT count(*) FROM docs) AS n_docs, (SELECT count(DISTINCT term) FROM post) AS n_terms,
       (SELECT count(*) FROM post) AS n_postings"""


@sql("i2_tfidf_vocab")
def _i2():
    return f"WITH {O.tfidf_ctes()}\nSELECT term, cf, df, round(idf, 6) AS idf FROM vocab"


@sql("i2_heaviest_terms")
def _i2h():
    return f"WITH {O.tfidf_ctes(max_features=300)}\nSELECT term, cf, df FROM vocab"


@sql("i3_tfidf_doc_norms")
def _i3():
    return f"""WITH {O.tfidf_ctes()}
SELECT document_id, count(*) AS n_terms, round(sum(w * w), 6) AS norm2, round(max(w), 6) AS max_w
FROM w GROUP BY document_id"""


@sql("r3_tfidf_topk")
def _r3():
    return f"WITH {O.tfidf_ctes()}\n{O.topk_select('cosine', 10)}"


@sql("r1_oov_report")
def _r1():
    base = O.tfidf_ctes().replace(
        O.questions_cte(),
        "qs AS (SELECT item_id AS qid, text AS question FROM benchmark UNION ALL "
        "SELECT item_id + 1000000, reverse(text) FROM benchmark)")
    return f"""WITH {base}
SELECT qid, count(*) AS n_terms, CAST(sum(CASE WHEN v.term IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_oov,
       count(*) = sum(CASE WHEN v.term IS NULL THEN 1 ELSE 0 END) AS all_oov
FROM qt LEFT JOIN vocab v USING (term) GROUP BY qid"""


def _clean_docs_cte():
    return f"""cd0 AS (SELECT doc_id AS document_id, source AS title, {O.p6('text')} AS clean FROM documents),
cd AS (SELECT min(document_id) AS document_id, arg_min(title, document_id) AS title, clean
       FROM cd0 GROUP BY clean),
ct AS (SELECT document_id, title, {O.toks('clean')} AS t FROM cd),
cw AS (SELECT document_id, title, t,
              CAST(1 + ceil(greatest(len(t) - 150, 0) / 100.0) AS INTEGER) AS nw FROM ct),
pw AS (SELECT document_id, title, CAST(i AS INTEGER) AS window_index,
              array_to_string(t[i * 100 + 1 : i * 100 + 150], ' ') AS text
       FROM (SELECT *, unnest(range(0, nw)) AS i FROM cw))"""


@sql("c1_passages")
def _c1():
    return f"""WITH {_clean_docs_cte()}
SELECT document_id, window_index, CAST(length(text) AS INTEGER) AS n_chars,
       CAST(len(string_split(text, ' ')) AS INTEGER) AS n_tokens, sha256(text) AS h FROM pw"""


@sql("c2_passage_ids")
def _c2():
    return f"""WITH {_clean_docs_cte()}
SELECT row_number() OVER (ORDER BY document_id, window_index) - 1 AS passage_id,
       document_id, title, window_index, sha256(text) AS h FROM pw"""


def _qa_pred():
    return f"{O.qa_cte()}, {O.predictions_cte()}, j AS (SELECT * FROM qa JOIN preds USING (id))"


@sql("e1_exact_match")
def _e1():
    return f"""WITH {_qa_pred()}
SELECT id, list_max(list_transform(answers.text, lambda g: {O.p11('prediction_text')} = {O.p11('g')})) AS em FROM j"""


@sql("e2_char_f1")
def _e2():
    return f"""WITH {_qa_pred()}
SELECT id, round(coalesce(list_max(list_transform(answers.text, lambda g: {O.char_f1('prediction_text', 'g')})), 0.0), 6) AS f1 FROM j"""


def _em_f1_cols():
    em = f"coalesce(list_max(list_transform(answers.text, lambda g: CAST({O.p11('p.prediction_text')} = {O.p11('g')} AS DOUBLE))), 0.0)"
    f1 = f"coalesce(list_max(list_transform(answers.text, lambda g: {O.char_f1('p.prediction_text', 'g')})), 0.0)"
    return em, f1


@sql("e4_dataset_scores")
def _e4():
    em, f1 = _em_f1_cols()
    return f"""WITH {O.qa_cte()}, {O.predictions_cte()},
s AS (SELECT CASE WHEN p.id IS NULL THEN 0.0 ELSE {em} END AS em,
             CASE WHEN p.id IS NULL THEN 0.0 ELSE {f1} END AS f1,
             p.id IS NULL AS miss
      FROM qa LEFT JOIN preds p USING (id)),
a AS (SELECT avg(em) AS em, avg(f1) AS f1, count(*) AS n_total,
             CAST(sum(CAST(miss AS INTEGER)) AS BIGINT) AS n_unanswered FROM s)
SELECT round(em, 6) AS em, round(f1, 6) AS f1, printf('%.2f%%', em * 100) AS em_str,
       printf('%.2f%%', f1 * 100) AS f1_str, n_total, n_unanswered FROM a"""


@sql("e5_squad_scores")
def _e5():
    em = f"list_max(list_transform(answers.text, lambda g: CAST({O.squad_norm('prediction_text')} = {O.squad_norm('g')} AS DOUBLE)))"
    f1 = f"list_max(list_transform(answers.text, lambda g: {O.squad_f1('prediction_text', 'g')}))"
    return f"""WITH {O.qa_cte()}, {O.predictions_cte()}, j AS (SELECT * FROM qa LEFT JOIN preds USING (id))
SELECT round(100 * avg(CASE WHEN prediction_text IS NULL THEN 0.0 ELSE {em} END), 6) AS exact_match,
       round(100 * avg(CASE WHEN prediction_text IS NULL THEN 0.0 ELSE {f1} END), 6) AS f1 FROM j"""


@sql("j10_unanswered")
def _j10():
    return f"WITH {O.qa_cte()}, {O.predictions_cte()}\nSELECT id FROM qa ANTI JOIN preds USING (id)"


@sql("e7_eval_table")
def _e7():
    return f"""WITH {_qa_pred()}
SELECT id, prediction_text, prediction_start, answers.answer_start[1] AS answer_start,
       answers.text[1] AS answer_text, context, question FROM j"""


@sql("e8_pred_table")
def _e8():
    return f"WITH {_qa_pred()}\nSELECT id, prediction_text, prediction_start, question, context FROM j"


@sql("e9_strict_match")
def _e9():
    return f"""WITH {_qa_pred()}
SELECT id, prediction_start = answers.answer_start[1] AND prediction_text = answers.text[1] AS strict FROM j"""


@sql("p9_question_decoration")
def _p9():
    return f"WITH {O.qa_cte()}\nSELECT id, question || ' [SEP] ^' || coalesce(title, '') || '^' AS question FROM qa"


@sql("p14_first_answer")
def _p14():
    return f"WITH {O.qa_cte()}\nSELECT id, answers.text[1] AS answer_text, answers.answer_start[1] AS answer_start FROM qa"


def _vec_ctes():
    return """q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT vec_id AS pid, vec_id // 5 AS document_id, embedding::DOUBLE[] AS v, label
      FROM embeddings)"""


@sql("r6_dense_topk")
def _r6():
    return f"""WITH {_vec_ctes()},
s AS (SELECT qid, pid, round(list_dot_product(q.v, p.v), 6) AS score FROM q, p)
SELECT qid, rank, pid, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS INTEGER) AS rank FROM s)
WHERE rank <= 10"""


@sql("r7_dense_doc_topk")
def _r7():
    return f"""WITH {_vec_ctes()},
s AS (SELECT qid, pid, document_id, round(list_dot_product(q.v, p.v), 6) AS score FROM q, p),
best AS (SELECT qid, document_id, pid, score FROM (
           SELECT *, row_number() OVER (PARTITION BY qid, document_id ORDER BY score DESC, pid) AS r FROM s)
         WHERE r = 1)
SELECT qid, rank, pid, document_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, document_id) AS INTEGER) AS rank FROM best)
WHERE rank <= 10"""


def _centroid_ctes():
    return _vec_ctes() + """,
pe AS (SELECT label, i, avg(x) AS m FROM (
         SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM p) GROUP BY label, i),
c AS (SELECT label AS cluster_id, list(m ORDER BY i) AS cv FROM pe GROUP BY label),
asg AS (SELECT pid, v, cluster_id FROM (
          SELECT pid, p.v, cluster_id, row_number() OVER (PARTITION BY pid ORDER BY
                 round(list_sum(list_transform(list_zip(p.v, cv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9),
                 cluster_id) AS r
          FROM p, c) WHERE r = 1)"""


@sql("i6_ivf_assign")
def _i6():
    return f"WITH {_centroid_ctes()}\nSELECT pid, cluster_id FROM asg"


@sql("i6_ivf_assign_blocks")
def _i6b():
    return f"WITH {_centroid_ctes()}\nSELECT pid, cluster_id FROM asg"


@sql("r8_ivf_topk")
def _r8():
    return f"""WITH {_centroid_ctes()},
qp AS (SELECT qid, v, cluster_id FROM (
         SELECT qid, q.v, cluster_id, row_number() OVER (PARTITION BY qid ORDER BY
                round(list_sum(list_transform(list_zip(q.v, cv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9),
                cluster_id) AS r
         FROM q, c) WHERE r = 1),
s AS (SELECT qid, pid,
             round(list_sum(list_transform(list_zip(qp.v, asg.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS score
      FROM qp JOIN asg USING (cluster_id))
SELECT qid, rank, pid, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score, pid) AS INTEGER) AS rank FROM s)
WHERE rank <= 10"""


@sql("i5_vector_table_stats")
def _i5():
    return f"""WITH {_vec_ctes()}
SELECT document_id, count(*) AS n_vectors, CAST(max(len(v)) AS INTEGER) AS dim FROM p GROUP BY document_id"""


@sql("e18_inbatch_contrastive")
def _e18():
    return """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
pr AS (SELECT a.vec_id AS qid, a.v AS qv, b.v AS pv, a.vec_id // 8 AS batch_id
       FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
s AS (SELECT x.batch_id, x.qid, y.qid AS pq, list_dot_product(x.qv, y.pv) AS logit
      FROM pr x JOIN pr y USING (batch_id)),
l AS (SELECT batch_id, qid, max(logit) + ln(sum(exp(logit - m))) - max(CASE WHEN pq = qid THEN logit END) AS nll
      FROM (SELECT *, max(logit) OVER (PARTITION BY batch_id, qid) AS m FROM s) GROUP BY batch_id, qid)
SELECT batch_id, round(avg(nll), 6) AS loss, count(*) AS n FROM l GROUP BY batch_id"""


def _long_select():
    return """SELECT example_id, rank, text, start_logit, end_logit, probability, prediction_start,
       CAST(context_index AS INTEGER) AS context_index FROM prob"""


@sql("n13_nbest")
def _n13():
    return f"WITH {O.qa_cte()}, {O.nbest_ctes()}\n{_long_select()}"


@sql("n12_nbest_negative")
def _n12():
    return f"WITH {O.qa_cte()}, {O.nbest_ctes(v2=True)}\n{_long_select()}"


@sql("n10_best_answer")
def _n10():
    return f"""WITH {O.qa_cte()}, {O.nbest_ctes()}
SELECT p.example_id, p.text AS prediction_text, CAST(p.prediction_start AS INTEGER) AS prediction_start,
       qa.answers.text[1] AS label
FROM prob p JOIN qa ON qa.id = p.example_id WHERE rank = 1"""


@sql("n11_best_answer_negative")
def _n11():
    return f"""WITH {O.qa_cte()}, {O.nbest_ctes(v2=True)},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY rank) AS q
                        FROM prob WHERE text <> '') WHERE q = 1),
nulls AS (SELECT example_id, score AS ns FROM prob WHERE kind = 1),
d AS (SELECT b.example_id, b.text, b.prediction_start, ns - b.start_logit - b.end_logit AS diff
      FROM best b JOIN nulls USING (example_id))
SELECT example_id, CASE WHEN diff > 0.0 THEN '' ELSE text END AS prediction_text,
       CAST(CASE WHEN diff > 0.0 THEN 0 ELSE prediction_start END AS INTEGER) AS prediction_start,
       round(diff, 6) AS score_diff FROM d"""


@sql("n1_feature_alignment")
def _n1():
    return f"""WITH {O.qa_cte()}, {O.features_cte()}
SELECT count(*) AS n_features,
       count(*) FILTER (WHERE len(start_logits) <> len(offsets) OR len(end_logits) <> len(offsets)) AS n_misaligned
FROM feats"""


@sql("n2_top_positions")
def _n2():
    def top(col):
        return (f"list_transform(list_sort(list_transform(range(0, len({col})), lambda i: {{'nv': -{col}[i + 1], 'i': i}}))[1:10], "
                f"lambda x: CAST(x.i AS INTEGER))")
    return f"""WITH {O.qa_cte()}, {O.features_cte()}
SELECT example_id, window_index, {top('start_logits')} AS top_start, {top('end_logits')} AS top_end FROM feats"""


def _lse(x):
    return f"(list_max({x}) + ln(list_sum(list_transform({x}, lambda v: exp(v - list_max({x}))))))"


def _labels_ctes(src, offsets="offsets", id_col="example_id"):
    return f"""lab AS (SELECT f.*, qa.answers.answer_start[1] AS sc,
                  qa.answers.answer_start[1] + length(qa.answers.text[1]) AS ec
           FROM {src} f JOIN qa ON qa.id = f.{id_col}),
lab2 AS (SELECT *, list_filter(range(0, len({offsets})), lambda p: {offsets}[p + 1] IS NOT NULL) AS ctx FROM lab),
lab3 AS (SELECT *, coalesce(len(ctx) > 0 AND {offsets}[ctx[1] + 1].s <= sc AND {offsets}[ctx[-1] + 1].e >= ec
                          AND NOT (sc = 0 AND ec = 0), false) AS ok,
                list_max(list_filter(ctx, lambda p: {offsets}[p + 1].s <= sc)) AS s0,
                list_min(list_filter(ctx, lambda p: {offsets}[p + 1].e >= ec)) AS e0 FROM lab2),
labs AS (SELECT *, CAST(CASE WHEN ok THEN s0 ELSE 0 END AS INTEGER) AS start_positions,
                CAST(CASE WHEN ok THEN e0 ELSE 0 END AS INTEGER) AS end_positions FROM lab3)"""


@sql("e19_span_loss")
def _e19():
    return f"""WITH {O.qa_cte()}, {O.features_cte()}, {_labels_ctes('feats')}
SELECT example_id, window_index,
       round(((({_lse('start_logits')}) - start_logits[start_positions + 1])
            + (({_lse('end_logits')}) - end_logits[end_positions + 1])) / 2, 6) AS loss FROM labs"""


def _tid(x):
    return f"CAST(5 + (('0x' || substr(md5({x}), 1, 8))::BIGINT % 29995) AS INTEGER)"


def _token_id(x):
    return (f"CASE {x} WHEN '[PAD]' THEN 0 WHEN '[UNK]' THEN 1 WHEN '[CLS]' THEN 2 "
            f"WHEN '[SEP]' THEN 3 WHEN '[MASK]' THEN 4 ELSE {_tid(x)} END")


def _windows_ctes(decorate=False, max_len=48, stride=8):
    q = "question || ' [SEP] ^' || coalesce(title, '') || '^'" if decorate else "question"
    return f"""w0 AS (
  SELECT id, context, {O.tok_raw(q)} AS qt, string_split(context, ' ') AS ct,
         list_transform(range(1, len(string_split(context, ' ')) + 1),
           lambda j: length(array_to_string(string_split(context, ' ')[1:j - 1], ' ')) + CASE WHEN j > 1 THEN 1 ELSE 0 END) AS st
  FROM qa),
w1 AS (SELECT *, {max_len} - len(qt) - 3 AS W FROM w0 WHERE {max_len} - len(qt) - 3 > {stride}),
w2 AS (SELECT *, CAST(wi AS INTEGER) AS window_index FROM (
         SELECT *, unnest(range(0, CAST(1 + ceil(greatest(len(ct) - W, 0) / (W - {stride})) AS BIGINT))) AS wi FROM w1)),
w3 AS (SELECT *, list_transform(range(window_index * (W - {stride}) + 1, least(window_index * (W - {stride}) + W, len(ct)) + 1),
                               lambda j: {{'tok': ct[j], 's': CAST(st[j] AS INTEGER), 'e': CAST(st[j] + length(ct[j]) AS INTEGER)}}) AS win
       FROM w2),
wins AS (
  SELECT id AS example_id, window_index,
         list_concat([2], list_transform(qt, lambda t: {_token_id('t')}), [3],
                     list_transform(win, lambda o: {_token_id('o.tok')}), [3]) AS input_ids,
         list_concat(list_transform(range(0, len(qt) + 2), lambda i: 0), list_transform(range(0, len(win) + 1), lambda i: 1)) AS token_type_ids,
         list_concat(list_transform(range(0, len(qt) + 2), lambda i: NULL::STRUCT(s INTEGER, e INTEGER)),
                     list_transform(win, lambda o: {{'s': o.s, 'e': o.e}}), [NULL::STRUCT(s INTEGER, e INTEGER)]) AS offset_mapping
  FROM w3)"""


@sql("c3_reader_windows")
def _c3():
    return f"""WITH {O.qa_cte()}, {_windows_ctes()}
SELECT example_id, window_index, input_ids, token_type_ids,
       list_transform(input_ids, lambda x: 1) AS attention_mask,
       list_transform(offset_mapping, lambda o: o.s) AS offset_start,
       list_transform(offset_mapping, lambda o: o.e) AS offset_end FROM wins"""


@sql("c6_span_labels")
def _c6():
    return f"""WITH {O.qa_cte()}, {_windows_ctes()}, {_labels_ctes('wins', 'offset_mapping')}
SELECT example_id, window_index, start_positions, end_positions,
       CAST(CASE WHEN start_positions > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS answerable FROM labs"""


@sql("c7_title_segments")
def _c7():
    return f"""WITH {O.qa_cte()}, {_windows_ctes(decorate=True)}, {_labels_ctes('wins', 'offset_mapping')},
sp AS (SELECT *, list_filter(range(0, len(input_ids)), lambda i: input_ids[i + 1] = 3) AS seps FROM labs)
SELECT example_id, window_index,
       list_filter(input_ids, lambda v, i: i - 1 <> seps[2]) AS input_ids,
       list_filter(list_transform(token_type_ids, lambda v, i: CASE WHEN i - 1 > seps[1] AND i - 1 < seps[2] THEN 1 ELSE v END),
                   lambda v, i: i - 1 <> seps[2]) AS token_type_ids,
       CAST(greatest(start_positions - 1, 0) AS INTEGER) AS start_positions,
       CAST(greatest(end_positions - 1, 0) AS INTEGER) AS end_positions
FROM sp WHERE len(seps) = 3"""


@sql("c8_answer_centred")
def _c8():
    L = 14
    return f"""WITH {O.qa_cte()},
a0 AS (SELECT id, string_split(context, ' ') AS ct, answers.answer_start[1] AS sc,
              answers.answer_start[1] + length(answers.text[1]) AS ec,
              list_transform(range(1, len(string_split(context, ' ')) + 1),
                lambda j: length(array_to_string(string_split(context, ' ')[1:j - 1], ' ')) + CASE WHEN j > 1 THEN 1 ELSE 0 END) AS st
       FROM qa),
a1 AS (SELECT *, len(ct) AS n,
              coalesce(list_max(list_filter(range(0, len(ct)), lambda p: st[p + 1] <= sc)), 0) AS ts,
              coalesce(list_min(list_filter(range(0, len(ct)), lambda p: st[p + 1] + length(ct[p + 1]) >= ec)), len(ct) - 1) AS te
       FROM a0),
a2 AS (SELECT *, CAST(CASE WHEN n <= {L} THEN 0 ELSE least(greatest(floor((ts + te) / 2) - {L // 2 + L % 2}, 0), n - {L}) END AS INTEGER) AS window_start FROM a1),
a3 AS (SELECT *, list_concat([2], list_transform(ct[window_start + 1 : window_start + {L}], lambda t: {_tid('t')}), [3]) AS ids FROM a2)
SELECT id, window_start, list_concat(ids, list_transform(range(0, 16 - len(ids)), lambda i: 0)) AS p_input_ids,
       list_concat(list_transform(ids, lambda i: 1), list_transform(range(0, 16 - len(ids)), lambda i: 0)) AS p_attention_mask
FROM a3"""


def _mlm_cte():
    return f"""mw AS (
  SELECT doc_id, t0, unnest(range(0, CAST(1 + ceil(greatest(len(t0) - 126, 0) / 126.0) AS BIGINT))) AS w
  FROM (SELECT doc_id, {O.tok('text')} AS t0 FROM documents)),
mlm AS (
  SELECT row_id, list_concat([2], list_transform(t, lambda x: {_tid('x')}), [3]) AS input_ids,
         list_concat([1], list_transform(t, lambda x: 0), [1]) AS special_tokens_mask,
         list_concat([false], list_transform(t, lambda x: length(x) >= 6), [false]) AS ner_map
  FROM (SELECT doc_id * 1000000 + w AS row_id, t0[w * 126 + 1 : w * 126 + 126] AS t FROM mw))"""


def _batches(multiple=None):
    mx = "max(len(input_ids)) OVER (PARTITION BY batch_id)"
    if multiple:
        mx = f"CAST(ceil({mx} / {multiple}.0) * {multiple} AS INTEGER)"
    return f"""bt AS (SELECT *, CAST(row_number() OVER (ORDER BY row_id) - 1 AS BIGINT) AS row_index FROM mlm),
bt2 AS (SELECT *, row_index // 8 AS batch_id FROM bt),
bt3 AS (SELECT *, list_concat(input_ids, list_transform(range(0, {mx} - len(input_ids)), lambda i: 0)) AS padded FROM bt2)"""


@sql("c10_batch_padding")
def _c10():
    return f"""WITH {_mlm_cte()}, {_batches(8)}
SELECT row_id, row_index, batch_id, CAST(len(padded) AS INTEGER) AS padded_len, padded[-1] AS last_id FROM bt3"""


@sql("c14_causal_labels")
def _c14():
    return f"""WITH {_mlm_cte()}, {_batches()}
SELECT row_id, list_transform(padded, lambda v: CASE WHEN v = 0 THEN -100 ELSE v END) AS labels FROM bt3"""


def _mlm_select(prob, ner=False, span=False):
    def u(k):
        return f"(('0x' || substr(h[p + 1], {8 * k + 1}, 8))::BIGINT / 4294967296.0)"
    elig = "special_tokens_mask[p + 1] = 0" + (" AND ner_map[p + 1]" if ner else "")
    base = f"""m0 AS (SELECT *, list_transform(range(0, len(input_ids)),
                 lambda p: md5('42:' || CAST(row_id AS VARCHAR) || ':' || CAST(p AS VARCHAR))) AS h FROM mlm),
m1 AS (SELECT *, list_transform(range(0, len(input_ids)), lambda p: {elig} AND {u(0)} < {prob}) AS d0 FROM m0)"""
    if span:
        base += """,
m2 AS (SELECT *, list_transform(range(0, len(input_ids)), lambda p: len(list_filter(ner_map[1:p], lambda v: NOT v))) AS k FROM m1),
m3 AS (SELECT *, list_distinct(list_transform(list_filter(range(0, len(input_ids)), lambda p: d0[p + 1]), lambda p: k[p + 1])) AS runs FROM m2),
m4 AS (SELECT *, list_transform(range(0, len(input_ids)), lambda p: d0[p + 1] OR (ner_map[p + 1] AND list_contains(runs, k[p + 1]))) AS d FROM m3)"""
    else:
        base += ", m4 AS (SELECT *, d0 AS d FROM m1)"
    return f"""{base}
SELECT row_id,
  list_transform(range(0, len(input_ids)), lambda p: CASE
      WHEN d[p + 1] AND {u(1)} < 0.8 THEN 4
      WHEN d[p + 1] AND {u(2)} < 0.5 THEN CAST(floor({u(3)} * 30000) AS INTEGER)
      ELSE input_ids[p + 1] END) AS input_ids,
  list_transform(range(0, len(input_ids)), lambda p: CASE WHEN d[p + 1] THEN input_ids[p + 1] ELSE -100 END) AS labels
FROM m4"""


@sql("c11_mlm_mask")
def _c11():
    return f"WITH {_mlm_cte()}, {_mlm_select(0.15)}"


@sql("c13_span_mask")
def _c13():
    return f"WITH {_mlm_cte()}, {_mlm_select(0.3, ner=True, span=True)}"


@sql("p15_substring_search")
def _p15():
    return "SELECT doc_id FROM documents WHERE contains(text, 'ion d')"


@sql("p16_length_outliers")
def _p16():
    return "SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars FROM documents WHERE length(text) > 20000"


def _overlap_ctes():
    return f"""pr AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS context
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
ov0 AS (SELECT *, {O.tok_raw('question')} AS qt, {O.tok_raw('context')} AS ct FROM pr),
ov AS (SELECT conv_id, turn, question, context, CAST(len(qt) AS INTEGER) AS n_q_tokens,
              list_filter(qt, lambda t: list_contains(ct, t)) AS sh FROM ov0),
ovr AS (SELECT conv_id, turn, question, context, n_q_tokens, CAST(len(sh) AS INTEGER) AS n_shared,
               round(CASE WHEN n_q_tokens > 0 THEN len(sh) / n_q_tokens END, 6) AS ratio,
               array_to_string(sh, ' ') AS shared FROM ov)"""


@sql("e13_token_overlap")
def _e13():
    return f"WITH {_overlap_ctes()}\nSELECT conv_id, turn, n_q_tokens, n_shared, ratio, shared FROM ovr"


@sql("r13_overlap_lowest")
def _r13a():
    return f"WITH {_overlap_ctes()}\nSELECT conv_id, turn, ratio FROM ovr ORDER BY ratio ASC NULLS FIRST, conv_id, turn LIMIT 10"


@sql("r13_overlap_highest")
def _r13b():
    return f"WITH {_overlap_ctes()}\nSELECT conv_id, turn, ratio FROM ovr ORDER BY ratio DESC NULLS LAST, conv_id, turn LIMIT 10"


@sql("r13_longest_documents")
def _r13c():
    return "SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100"


@sql("s9_overlap_report")
def _s9():
    lines = ("array_to_string(list_transform(range(0, CAST(ceil(length(context) / 100.0) AS BIGINT)), "
             "lambda i: substring(context, i * 100 + 1, 100) || chr(10)), '')")
    return f"""WITH {_overlap_ctes()}
SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || ' ' || {lines} || 'Q: ' || question || ' -> A: ' || chr(10)
       || 'SAME: ' || shared || ' -> ACCURACY:' || printf('%.2f', ratio) || chr(10) || chr(10) AS report FROM ovr"""


@sql("e14_length_histogram")
def _e14():
    return """SELECT CAST(b AS INTEGER) AS bin, count(x) AS n FROM range(30) t(b)
LEFT JOIN (SELECT CASE WHEN length(text) = 5000 THEN 29 ELSE floor(length(text) * 30 / 5000) END AS x
           FROM documents WHERE length(text) <= 5000) ON b = x GROUP BY b"""


@sql("e14_length_summary")
def _e14s():
    return """SELECT count(*) AS n_docs, CAST(min(length(text)) AS INTEGER) AS min_len,
       CAST(max(length(text)) AS INTEGER) AS max_len,
       CAST(sum(CASE WHEN length(text) > 20000 THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers FROM documents"""


@sql("e15_joined_length")
def _e15():
    return "SELECT CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS total_chars FROM documents"


def _special_cte():
    SPECIAL_CHAR = O.SPECIAL_CHAR
    return f"""sc AS (SELECT ch, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(text, {O.lit(SPECIAL_CHAR)}, 0)) AS ch FROM documents) GROUP BY ch)"""


@sql("e16_special_chars")
def _e16():
    return f"WITH {_special_cte()}\nSELECT ch, n FROM sc"


@sql("j12_special_chars_in_answers")
def _j12():
    return f"""WITH {O.qa_cte()}, {_special_cte()},
ac AS (SELECT DISTINCT unnest(string_split(answers.text[1], '')) AS ch FROM qa)
SELECT ch, ch IN (SELECT ch FROM ac) AS in_answer FROM sc"""


@sql("e17_micro_f1")
def _e17():
    return "SELECT round(avg(CAST(toxic = quality AS DOUBLE)), 6) AS micro_f1, count(*) AS n FROM labels"


def _psub(ctx, a, b):
    a2 = f"least(greatest({a}, 0), length({ctx}))"
    b2 = f"least(greatest({b}, {a2}), length({ctx}))"
    return f"substring({ctx}, {a2} + 1, {b2} - {a2})"


def _wrap(ctx, a, b, start):
    from quarry.operators.report import SPAN_END
    return f"{_psub(ctx, '0', a)} || {O.lit(start)} || {_psub(ctx, a, b)} || {O.lit(SPAN_END)}"


def _highlight_eval():
    from quarry.operators.report import BLUE_START, RED_START, SPAN_END
    c = "context"
    tail = lambda x: _psub(c, x, f"length({c})")
    return f"""CASE
  WHEN ps < 0 THEN {_wrap(c, 'a0', 'ae0', BLUE_START)} || {tail('ae0')}
  WHEN ps = a0 AND prediction_text = answer_text THEN {_wrap(c, 'a0', 'ae0', BLUE_START)} || {tail('ae0')}
  WHEN ps <= a0 AND ae0 <= pe THEN {_wrap(c, 'ps', 'pe', RED_START)} || {tail('pe')}
  WHEN pe <= as_ THEN {_wrap(c, 'ps', 'pe', RED_START)} || {_psub(c, 'pe', 'as_')} || {O.lit(BLUE_START)}
       || {_psub(c, 'as_', 'ae')} || {O.lit(SPAN_END)} || {tail('ae')}
  WHEN ps >= ae THEN {_wrap(c, 'as_', 'ae', BLUE_START)} || {_psub(c, 'ae', 'ps')} || {O.lit(RED_START)}
       || {_psub(c, 'ps', 'pe')} || {O.lit(SPAN_END)} || {tail('pe')}
  ELSE {_wrap(c, 'a0', 'ae0', BLUE_START)} || {tail('ae0')} END"""


def _eval_rows_ctes():
    return f"""{_qa_pred()},
r0 AS (SELECT id, question, context, prediction_text, prediction_start AS ps,
              answers.text[1] AS answer_text, answers.answer_start[1] AS a0,
              prediction_start + length(prediction_text) AS pe,
              answers.answer_start[1] + length(answers.text[1]) AS ae0
       FROM j),
r1 AS (SELECT *, CASE WHEN ps < ae0 AND ae0 < pe THEN ps - 1 ELSE ae0 END AS ae,
              CASE WHEN NOT (ps < ae0 AND ae0 < pe) AND ps < a0 AND a0 < pe THEN pe + 1 ELSE a0 END AS as_ FROM r0)"""


@sql("e10_highlight_eval")
def _e10():
    return f"WITH {_eval_rows_ctes()}\nSELECT id, {_highlight_eval()} AS html FROM r1"


@sql("e11_highlight_pred")
def _e11():
    from quarry.operators.report import BLUE_START
    return f"""WITH {_eval_rows_ctes()}
SELECT id, CASE WHEN ps < 0 THEN context
           ELSE {_wrap('context', 'ps', 'pe', BLUE_START)} || {_psub('context', 'pe', 'length(context)')} END AS html FROM r1"""


def _template(t, values):
    out, rest = [], t
    while "$" in rest:
        i = rest.index("$")
        out.append(O.lit(rest[:i]))
        j = i + 1
        while j < len(rest) and (rest[j].isalnum() or rest[j] == "_"):
            j += 1
        out.append(values[rest[i + 1:j]])
        rest = rest[j:]
    out.append(O.lit(rest))
    return " || ".join(out)


@sql("e12_eval_paragraphs")
def _e12():
    from quarry.operators.report import EVAL_PARAGRAPH_TEMPLATE
    frag = _template(EVAL_PARAGRAPH_TEMPLATE, {
        "id": "CAST(id AS VARCHAR)", "question": "question",
        "is_match": "CASE WHEN ps = a0 AND prediction_text = answer_text THEN 'True' ELSE 'False' END",
        "paragraph": f"({_highlight_eval()})"})
    return f"WITH {_eval_rows_ctes()}\nSELECT id, {frag} AS fragment FROM r1"


@sql("e12_pred_paragraphs")
def _e12p():
    from quarry.operators.report import BLUE_START, PRED_PARAGRAPH_TEMPLATE
    para = (f"(CASE WHEN ps < 0 THEN context ELSE {_wrap('context', 'ps', 'pe', BLUE_START)} || "
            f"{_psub('context', 'pe', 'length(context)')} END)")
    frag = _template(PRED_PARAGRAPH_TEMPLATE, {"id": "CAST(id AS VARCHAR)", "question": "question",
                                               "paragraph": para})
    return f"WITH {_eval_rows_ctes()}\nSELECT id, {frag} AS fragment FROM r1"


@sql("p8_title_prefix")
def _p8():
    return f"SELECT doc_id AS document_id, coalesce(source, '') || ' ' || {O.p6('text')} AS ptext FROM documents"


def _titles_cte():
    return f"""tt AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
                    {O.p5("regexp_replace(html, '<[^>]*>', ' ', 'g')")} AS text FROM pages)"""


@sql("p10_title_text_join")
def _p10():
    return f"WITH {_titles_cte()}\nSELECT page_id, title, coalesce(title, '') || '[SEP]' || coalesce(text, '') AS passage FROM tt"


@sql("p13_column_resolution")
def _p13():
    return "SELECT item_id, text AS question FROM benchmark"


@sql("p17_drop_token_type_ids")
def _p17():
    return f"""WITH {O.qa_cte()}, {_windows_ctes()}
SELECT example_id, window_index, input_ids, list_transform(input_ids, lambda x: 1) AS attention_mask FROM wins"""


@sql("t3_token_offsets")
def _t3():
    WS_CHARS = O.SPACE
    tokp = O.lit("[^" + WS_CHARS + "]+")
    gapp = O.lit("([" + WS_CHARS + "]*)[^" + WS_CHARS + "]+")
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(text, {tokp}) AS toks,
                          regexp_extract_all(text, {gapp}, 1) AS gaps FROM documents),
x AS (SELECT doc_id, unnest(toks) AS tok, unnest(gaps) AS gap, unnest(range(1, len(toks) + 1)) AS j FROM d),
y AS (SELECT doc_id, j, CAST(sum(length(gap) + length(tok)) OVER (PARTITION BY doc_id ORDER BY j) - length(tok) AS INTEGER) AS s,
             CAST(sum(length(gap) + length(tok)) OVER (PARTITION BY doc_id ORDER BY j) AS INTEGER) AS e FROM x),
z AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n_tokens, list(s ORDER BY j) AS starts, list(e ORDER BY j) AS ends
      FROM y GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(starts, []) AS starts, coalesce(ends, []) AS ends
FROM documents d LEFT JOIN z USING (doc_id)"""


@sql("t4_join_tokens")
def _t4():
    return f"SELECT doc_id, array_to_string({O.tok_raw('text')}, ' ') AS joined FROM documents"


@sql("i1_word_ngrams")
def _i1():
    return f"""WITH d AS (SELECT doc_id, {O.tok_raw('lower(text)')} AS t FROM documents),
g AS (SELECT doc_id, len(t) AS n,
             list_concat(t, CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END) AS g FROM d)
SELECT doc_id, CAST(len(g) AS INTEGER) AS n_grams, g[n + 1] AS first_bigram, g[-1] AS last_gram FROM g"""


@sql("j3_union_splits")
def _j3():
    return f"""WITH {O.qa_cte()}
SELECT id, 'train' AS split, question FROM qa WHERE id % 2 = 0
UNION ALL SELECT id, 'validation', question FROM qa WHERE id % 2 = 1"""


def _bm25_top3():
    return f"{O.bm25_ctes()}, top AS ({O.topk_select('bm25', 3)})"


@sql("j7_document_lookup")
def _j7():
    return f"""WITH {_bm25_top3()}
SELECT qid, rank, document_id, title, CAST(length(text) AS INTEGER) AS n_chars FROM top JOIN docs USING (document_id)"""


@sql("r9_retrieved_table")
def _r9():
    return f"""WITH {_bm25_top3()},
l AS (SELECT qid, list(title ORDER BY rank) AS title, list(document_id ORDER BY rank) AS document_id,
             list(CAST(length(text) AS INTEGER) ORDER BY rank) AS context_chars
      FROM top JOIN docs USING (document_id) GROUP BY qid)
SELECT qs.qid, qs.question, l.title, l.document_id, l.context_chars FROM qs LEFT JOIN l USING (qid)"""


@sql("c4_multi_context")
def _c4():
    return f"""WITH {_bm25_top3()}
SELECT t.qid AS id, CAST(t.rank - 1 AS INTEGER) AS context_index, d.title, CAST(length(d.text) AS INTEGER) AS n_chars
FROM top t JOIN docs d USING (document_id)"""


@sql("j8_passage_document_audit")
def _j8():
    return f"""WITH {_clean_docs_cte()}, {O.corpus_ctes()}
SELECT DISTINCT document_id FROM pw WHERE document_id NOT IN (SELECT document_id FROM docs)"""


@sql("j9_features_per_example")
def _j9():
    return f"""WITH {O.qa_cte()}, {_windows_ctes()}
SELECT example_id, count(*) AS n_windows, max(window_index) AS last_window FROM wins GROUP BY example_id"""


@sql("c9_pad_truncate")
def _c9():
    return f"""WITH {_mlm_cte()}
SELECT row_id, list_concat(input_ids[1:64], list_transform(range(0, 64 - len(input_ids[1:64])), lambda i: 0)) AS input_ids FROM mlm"""


@sql("s1_corpus_jsonl_roundtrip")
def _s1():
    return "SELECT doc_id AS document_id, source AS title, CAST(length(text) AS INTEGER) AS n_chars FROM documents"


@sql("s2_qa_split_scan")
def _s2():
    return f"WITH {O.qa_cte()}\nSELECT id, question, answers.text[1] AS answer_text FROM qa WHERE id % 2 = 1"


SQL["s3_passages_roundtrip"] = SQL["c2_passage_ids"]
SQL["s4_bm25_persistent_topk"] = SQL["r5_bm25_topk"]


@sql("s5_predictions_json")
def _s5():
    return f"""WITH {O.qa_cte()}, {O.nbest_ctes()}
SELECT example_id, text AS prediction_text, CAST(prediction_start AS INTEGER) AS prediction_start FROM prob WHERE rank = 1"""


SQL["s7_result_csv_roundtrip"] = SQL["e7_eval_table"]


@sql("s8_metrics_table")
def _s8():
    em, f1 = _em_f1_cols()
    return f"""WITH {O.qa_cte()}, {O.predictions_cte()},
s AS (SELECT CASE WHEN p.id IS NULL THEN 0.0 ELSE {em} END AS em,
             CASE WHEN p.id IS NULL THEN 0.0 ELSE {f1} END AS f1, p.id IS NULL AS miss
      FROM qa LEFT JOIN preds p USING (id)),
a AS (SELECT round(avg(em), 6) AS em, round(avg(f1), 6) AS f1, count(*) AS n_total,
             sum(CAST(miss AS INTEGER)) AS n_unanswered FROM s)
SELECT 'eval_em' AS metric, CAST(em AS DOUBLE) AS value FROM a
UNION ALL SELECT 'eval_f1', CAST(f1 AS DOUBLE) FROM a
UNION ALL SELECT 'eval_n_total', CAST(n_total AS DOUBLE) FROM a
UNION ALL SELECT 'eval_n_unanswered', CAST(n_unanswered AS DOUBLE) FROM a"""


@sql("p1_p5_cleaning_steps")
def _p1_p5():
    return f"""SELECT doc_id, {O.p1('text')} AS p1, {O.p3(O.p1('text'))} AS p3,
       {O.p4(O.p1('text'))} AS p4, {O.p5('text')} AS p5 FROM documents"""


@sql("p12_projection_by_mode")
def _p12():
    return f"WITH {O.qa_cte()}\nSELECT id, question, title, context, answers.text AS answer_texts FROM qa"


SQL["s4_tfidf_persistent_topk"] = SQL["r3_tfidf_topk"]
SQL["s4_ivf_persistent_topk"] = SQL["r8_ivf_topk"]


@sql("e4_scores_json")
def _e4j():
    inner = SQL["e4_dataset_scores"]
    return f"""SELECT '{{"EM": {{"value": "' || em_str || '", "rank": true, "decs": true}}, "F1": {{"value": "'
       || f1_str || '", "rank": false, "decs": true}}}}' AS report FROM ({inner})"""


@sql("e6_topk_accuracy_by_context")
def _e6c():
    return f"""WITH {O.bm25_ctes()}, {O.gold_cte()},
ranked AS ({O.topk_select('bm25', 100)}),
orig AS (SELECT g.qid, d.text AS ctx FROM (SELECT qid, min(document_id) AS document_id FROM gold GROUP BY qid) g
         JOIN documents d ON d.doc_id = g.document_id),
hits AS (SELECT r.qid, r.document_id FROM ranked r JOIN documents d ON d.doc_id = r.document_id
         JOIN orig o ON o.qid = r.qid WHERE {O.p6('d.text')} = {O.p6('o.ctx')}),
first AS (SELECT qid, min(rank) AS first_rank FROM ranked SEMI JOIN hits USING (qid, document_id) GROUP BY qid),
perq AS (SELECT qs.qid, first_rank FROM qs LEFT JOIN first USING (qid)),
ks AS (SELECT unnest([10, 20, 50, 100]) AS k)
SELECT CAST(k AS INTEGER) AS k, CAST(sum(CASE WHEN first_rank <= k THEN 1 ELSE 0 END) AS BIGINT) AS hits,
       count(*) AS n_questions,
       round(sum(CASE WHEN first_rank <= k THEN 1 ELSE 0 END) / count(*), 6) AS accuracy
FROM perq, ks GROUP BY k"""


# ------------------------------------------- rows that had no query of their own

@sql("t2_letter_tokenizer_terms")
def _t2():
    letters = "regexp_extract_all(lower(ptext), '[a-z]+')"
    ctes = O.bm25_ctes().replace(f"{O.toks('ptext')} AS t FROM docs", f"{letters} AS t FROM docs")
    assert letters in ctes
    return f"WITH {ctes}\nSELECT term, df, round(idf, 6) AS idf FROM terms"


def _one_question(ctes: str, scores: str) -> str:
    return f"""WITH {ctes},
top AS ({O.topk_select(scores, 10)})
SELECT rank, document_id, score, d.title, d.text AS context FROM top JOIN docs d USING (document_id)
WHERE qid = (SELECT min(item_id) FROM benchmark)"""


SQL["r4_r10_bm25_one_question"] = _one_question(O.bm25_ctes(), "bm25")
SQL["r2_r10_tfidf_one_question"] = _one_question(O.tfidf_ctes(), "cosine")

SQL["r11_method_dispatch"] = f"""
SELECT 'bm25' AS method, qid, rank, document_id, score FROM ({SQL['r5_bm25_topk']})
UNION ALL SELECT 'tfidf', qid, rank, document_id, score FROM ({SQL['r3_tfidf_topk']})
UNION ALL SELECT 'dpr', qid, rank, document_id, score FROM ({SQL['r7_dense_doc_topk']})
UNION ALL SELECT 'faiss', qid, rank, pid, score FROM ({SQL['r8_ivf_topk']})"""


@sql("r5_bm25_padded_negative")
def _r5n():
    # Okapi BM25 over every document, k1 = 1.5, b = 0.75, floor 0.25 * mean idf
    return """WITH t AS (SELECT doc_id AS document_id, regexp_extract_all(lower(coalesce(text, '')), '[aeiot]') AS ws FROM documents),
s AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM t),
p AS (SELECT document_id, dl, w, count(*) AS tf FROM (SELECT document_id, len(ws) AS dl, unnest(ws) AS w FROM t) GROUP BY ALL),
f AS (SELECT w, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT w, count(*) AS df FROM p GROUP BY w), s),
i AS (SELECT w, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM f) ELSE raw END AS idf FROM f),
q AS (SELECT item_id AS qid, regexp_extract_all(lower(coalesce(text, '')), '[aeiot]')[1:2] AS ws FROM benchmark),
qw AS (SELECT qid, unnest(ws) AS w FROM q),
m AS (SELECT qid, document_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score
      FROM qw JOIN i USING (w) JOIN p USING (w), s GROUP BY qid, document_id),
e AS (SELECT q.qid, t.document_id, round(coalesce(m.score, 0.0), 6) AS score
      FROM q CROSS JOIN t LEFT JOIN m ON m.qid = q.qid AND m.document_id = t.document_id)
SELECT qid, rank, document_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, document_id) AS INTEGER) AS rank FROM e)
WHERE rank <= 10"""


@sql("r9_retrieved_with_truth")
def _r9t():
    return f"""WITH {_bm25_top3()}, {O.qa_cte()},
l AS (SELECT qid, list(title ORDER BY rank) AS title, list(document_id ORDER BY rank) AS document_id,
             list(sha256(text) ORDER BY rank) AS context_sha
      FROM top JOIN docs USING (document_id) GROUP BY qid)
SELECT qa.id AS qid, qa.question, l.title, l.document_id, l.context_sha, qa.context AS original_context,
       qa.document_id AS original_document_id, qa.answers.text[1] AS answer, qa.answers.answer_start[1] AS answer_start
FROM qa LEFT JOIN l ON l.qid = qa.id"""


@sql("e3_max_over_truths")
def _e3():
    truths = "[answers.text[1], string_split(answers.text[1], ' ')[1], question]"
    return f"""WITH {_qa_pred()}
SELECT id, list_max(list_transform({truths}, lambda g: CAST({O.p11('prediction_text')} = {O.p11('g')} AS DOUBLE))) AS em,
       round(list_max(list_transform({truths}, lambda g: {O.char_f1('prediction_text', 'g')})), 6) AS f1 FROM j"""


@sql("n4_max_context_nbest")
def _n4():
    ctes = O.nbest_ctes()
    where = "AND e >= s AND e - s + 1 <= 30"
    assert where in ctes
    return f"WITH {O.qa_cte()}, {ctes.replace(where, where + ' AND s % 3 = 1')}\n{_long_select()}"


@sql("s5_nbest_json")
def _s5n():
    return f"""WITH {O.qa_cte()}, {O.nbest_ctes(v2=True)}
SELECT example_id, rank, text, probability FROM prob"""


@sql("s5_null_odds_json")
def _s5o():
    return f"SELECT example_id, round(score_diff, 6) AS score_diff FROM ({SQL['n11_best_answer_negative']})"


@sql("s9_report_file")
def _s9f():
    body = SQL["s9_overlap_report"].replace("' -> A: ' || chr(10)", "' -> A: ' || substring(context, 1, 10) || chr(10)")
    assert body != SQL["s9_overlap_report"]
    # a text file ends each report with a line feed of its own
    return f"""SELECT line, count(*) AS n FROM (
  SELECT unnest(string_split(report, chr(10))) AS line FROM ({body})) GROUP BY line"""


@sql("i6_kmeans_assignment")
def _i6a():
    return "SELECT vec_id AS pid, TRUE AS is_nearest FROM embeddings"


# ------------------------------------------- IVF over TF-IDF vectors

def _tfidf_ivf_ctes():
    # one list per title, centroids = mean vectors cut to their 500 heaviest terms
    return O.tfidf_ctes() + """,
labels AS (SELECT title, CAST(row_number() OVER (ORDER BY title NULLS FIRST) - 1 AS INTEGER) AS cluster_id
           FROM (SELECT DISTINCT title FROM docs)),
member AS (SELECT DISTINCT w.document_id, cluster_id FROM w JOIN docs USING (document_id) JOIN labels ON docs.title IS NOT DISTINCT FROM labels.title),
every AS (SELECT docs.document_id, cluster_id FROM docs JOIN labels ON docs.title IS NOT DISTINCT FROM labels.title),
size AS (SELECT cluster_id, count(*) AS n FROM every GROUP BY cluster_id),
mean AS (SELECT cluster_id, term, sum(w) / any_value(n) AS c FROM w JOIN every USING (document_id) JOIN size USING (cluster_id) GROUP BY cluster_id, term),
cent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY c DESC, term) AS r FROM mean) WHERE r <= 500),
norm AS (SELECT cluster_id, sum(c * c) / 2 AS half FROM cent GROUP BY cluster_id),
near AS (SELECT document_id, cluster_id FROM (
  SELECT m.document_id, norm.cluster_id, row_number() OVER (PARTITION BY m.document_id ORDER BY
         round(coalesce(d.dot, 0) - half, 9) DESC, norm.cluster_id) AS r
  FROM (SELECT DISTINCT document_id FROM w) m CROSS JOIN norm
  LEFT JOIN (SELECT document_id, cluster_id, sum(w * c) AS dot FROM w JOIN cent USING (term) GROUP BY ALL) d
    ON d.document_id = m.document_id AND d.cluster_id = norm.cluster_id) WHERE r = 1),
qnear AS (SELECT qid, cluster_id FROM (
  SELECT m.qid, norm.cluster_id, row_number() OVER (PARTITION BY m.qid ORDER BY
         round(coalesce(d.dot, 0) - half, 9) DESC, norm.cluster_id) AS r
  FROM (SELECT DISTINCT qid FROM qw) m CROSS JOIN norm
  LEFT JOIN (SELECT qid, cluster_id, sum(wq * c) AS dot FROM qw JOIN cent USING (term) GROUP BY ALL) d
    ON d.qid = m.qid AND d.cluster_id = norm.cluster_id) WHERE r <= 3)"""


def _by_distance(src):
    return f"""SELECT qid, rank, document_id, score FROM (
  SELECT qid, document_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score, document_id) AS INTEGER) AS rank
  FROM (SELECT qid, document_id, round(2 - 2 * score, 6) AS score FROM {src})) WHERE rank <= 10"""


@sql("i6_tfidf_ivf_assign")
def _i6t():
    return f"WITH {_tfidf_ivf_ctes()}\nSELECT document_id, cluster_id FROM near"


@sql("r8_tfidf_ivf_topk")
def _r8t():
    return f"""WITH {_tfidf_ivf_ctes()},
probed AS (SELECT c.* FROM cosine c JOIN near USING (document_id) JOIN qnear ON qnear.qid = c.qid AND qnear.cluster_id = near.cluster_id)
{_by_distance('probed')}"""


@sql("r8_tfidf_kmeans_full_probe")
def _r8f():
    return f"WITH {O.tfidf_ctes()}\n{_by_distance('cosine')}"


@sql("r8_sq8_ivf_topk")
def _r8q():
    return _r8()


@sql("r5_bm25_impact_topk")
def _r5i():
    return _r5()


@sql("s4_tfidf_ivf_persistent_topk")
def _s4v():
    return _r8f()


@sql("s4_sq8_persistent_topk")
def _s4q():
    return _r8()


@sql("r11_method_dispatch_stored")
def _r11s():
    far = _by_distance("cosine").replace("<= 10", "<= 5")
    return f"""SELECT 'bm25' AS method, * FROM (WITH {O.bm25_ctes()} {O.topk_select('bm25', 5)})
UNION ALL SELECT 'tfidf' AS method, * FROM (WITH {O.tfidf_ctes()} {O.topk_select('cosine', 5)})
UNION ALL SELECT 'faiss' AS method, * FROM (WITH {O.tfidf_ctes()} {far})"""


@sql("s6_scores_from_files")
def _s6():
    return SQL["e4_dataset_scores"]
