"""§3 flows end to end on the smallest driver tables, with synthetic logits."""

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans import fixtures as fx
from quarry.plans import flows
from tests.conftest import SF001


def test_predict_flow_end_to_end(spark):
    qs = fx.questions(spark, SF001)
    corpus = fx.corpus(spark, SF001)
    examples = flows.reader_input(qs, corpus, k=2)
    feats = flows.reader_features(examples, max_seq_length=64, doc_stride=16)
    pos = F.sequence(F.lit(0), F.size("input_ids") - 1)

    def logits(seed):
        return F.transform(pos, lambda p: F.round(
            10 * T.portable_uniform(F.lit(seed), F.col("example_id"), F.col("context_index"),
                                    F.col("window_index"), p) - 5, 3))
    with_logits = feats.withColumn("start_logits", logits("s")).withColumn("end_logits", logits("e"))
    report = flows.prediction_report(with_logits, examples, n_best=5, max_answer_length=10).collect()
    assert {r.id for r in report} == {r.qid for r in qs.collect()}
    for r in report:
        if r.prediction_text != "empty":
            s = r.prediction_start
            assert r.context[s:s + len(r.prediction_text)] == r.prediction_text


def test_retrieval_accuracy_flow(spark):
    qs = fx.questions(spark, SF001)
    gold = fx.gold(spark, SF001)
    orig = (gold.groupBy("qid").agg(F.min("document_id").alias("document_id"))
                .join(fx.corpus(spark, SF001).select("document_id", "text"), "document_id")
                .select("qid", F.col("text").alias("context")))
    acc = flows.retrieval_accuracy(qs.join(orig, "qid", "left"), fx.corpus(spark, SF001), ks=(1, 5))
    got = {r.k: r.hits for r in acc.collect()}
    assert got[1] == got[5] == gold.select("qid").distinct().count() == 3


def test_evaluate_files(spark, tmp_path):
    import json
    gt = tmp_path / "gt.json"
    gt.write_text(json.dumps([{"id": "a", "answers": {"text": ["Seoul"]}},
                              {"id": "b", "answers": {"text": ["x", "yy"]}},
                              {"id": "c", "answers": {"text": ["z"]}}]))
    pr = tmp_path / "pred.json"
    pr.write_text(json.dumps({"a": "seoul", "b": "y"}))
    r = flows.evaluate_files(spark, str(gt), str(pr)).first()
    assert r.n_unanswered == 1 and r.em_str == f"{1 / 3:.2%}"
    assert json.loads(r.report)["EM"]["value"] == r.em_str
