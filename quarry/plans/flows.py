"""End-to-end flows of SURVEY §3, composed from the operators.

The reader network is outside the library: ``reader_features`` stops where
its inputs are ready, and ``prediction_report`` resumes from its logits
(two array columns on the feature rows).

* §3.1 predict: questions -> P6 -> R9 -> C4/C3 -> [model] -> N13 -> E8
* §3.2 train/eval data: qa -> P9 -> C3 -> C5/C6/C7
* §3.3 retrieval evaluation: R9 (k = max) -> E6
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import decode as N
from quarry.operators import evaluate as E
from quarry.operators import features as C
from quarry.operators import index as I
from quarry.operators import retrieve as R


def reader_input(questions: DataFrame, corpus: DataFrame, k: int = 20,
                 method: str = "bm25") -> DataFrame:
    """R9 + R12 + P12 (predict mode): ``id, question, title[], context[]``
    with the top-k retrieved documents of every question."""
    docs = I.prepare_corpus(corpus)
    top = R.retrieve(questions, docs, method=method, k=k)
    t = R.retrieved_table(top, corpus, questions, k=k)
    return t.select(F.col("qid").alias("id"), "question", "title", "context")


def reader_features(examples: DataFrame, max_seq_length: int = 384, doc_stride: int = 128,
                    add_title: bool = True, status: str | None = "status") -> DataFrame:
    """C4 + P9 + C3 (+ C7 when ``add_title``): one row per window of each
    (question, retrieved context) pair, with ``example_id`` and
    ``context_index`` to map model outputs back. ``status`` says which rows
    have no features (question too long, no title segment); with None such a
    row fails the query."""
    fan = C.multi_context(examples) if dict(examples.dtypes)["context"].startswith("array") \
        else examples.withColumn("context_index", F.lit(0))
    if add_title:
        fan = fan.withColumn("question", T.decorate_question(F.col("question"), F.col("title")))
    w = C.reader_windows(fan, max_seq_length, doc_stride, context_index="context_index", status=status)
    return C.merge_title_segment(w, labels=False, status=status) if add_title else w


def prediction_report(features_with_logits: DataFrame, examples: DataFrame,
                      n_best: int = 20, max_answer_length: int = 30,
                      version_2_with_negative: bool = False) -> DataFrame:
    """N13 + E8: ``id, prediction_text, prediction_start, question, context``
    (context = the context the answer was taken from)."""
    feats = features_with_logits.withColumnRenamed("offset_mapping", "offsets")
    dec = N.nbest(feats, examples, n_best, max_answer_length, version_2_with_negative)
    best_ci = F.try_element_at(F.col("nbest"), F.lit(1))["context_index"]
    ex = examples.select(F.col("id").alias("example_id"), "question", F.col("context").alias("_ctx"))
    j = dec.join(ex, "example_id")
    is_array = dict(examples.dtypes)["context"].startswith("array")
    ctx = (F.try_element_at(F.col("_ctx"), F.coalesce(best_ci, F.lit(0)) + 1) if is_array
           else F.col("_ctx"))
    return j.select(F.col("example_id").alias("id"), "prediction_text", "prediction_start",
                    "question", ctx.alias("context"))


def retrieval_accuracy(questions: DataFrame, corpus: DataFrame, ks=(10, 20, 50, 100),
                       method: str = "bm25") -> DataFrame:
    """§3.3: retrieve once with k = max(ks), then E6 by original context
    (``questions``: ``qid, question, context``)."""
    docs = I.prepare_corpus(corpus)
    ranked = R.retrieve(questions.select("qid", "question"), docs, method=method, k=max(ks))
    return E.topk_accuracy_by_context(ranked, corpus, questions, ks)


def evaluate_files(spark, gt_path: str, pred_path: str) -> DataFrame:
    """E4 from files, as the scorer is called: a ground-truth JSON array of
    ``{id, answers: {text: [...]}}`` and a prediction JSON object
    ``{id: text}`` -> one row with the scores and the JSON report string.
    Unanswered ids score 0 and are counted."""
    from quarry.sources import io
    truth = io.read_ground_truth(spark, gt_path)
    preds = io.read_prediction_object(spark, pred_path)
    scores = E.dataset_scores(truth, preds)
    return scores.select("*", E.report_json("em_str", "f1_str").alias("report"))
