"""E1-E6, E17-E19 against Python models."""

import math
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluate as E
from quarry.functions import text as T

# prediction, truth, exact match, character F1 (worked out by hand)
PAIRS = [("The Cat", "the cat", True, 1.0), ("(고양이)", "고양이", True, 1.0), ("", "abc", False, 0.0),
         ("aab", "abb", False, 2 / 3), ("!!!", "...", True, 0.0), ("an apple", "apple", False, 5 / 6),
         ("Café, au lait", "cafe au lait", False, 0.9), ("x y z", "z y x", False, 1.0), ("the the", "the", False, 2 / 3)]


def char_multiset_f1(p, g):
    """F1 of two normalised strings over their characters without spaces."""
    p, g = Counter(p.replace(" ", "")), Counter(g.replace(" ", ""))
    same = sum((p & g).values())
    return 2 * same / (sum(p.values()) + sum(g.values())) if same else 0.0


def py_squad_norm(s):
    s = s.lower()
    s = "".join(c for c in s if c not in set(string.punctuation))
    s = re.sub(r"\b(a|an|the)\b", " ", s)
    return " ".join(s.split())


def py_squad_f1(p, g):
    pt, gt = py_squad_norm(p).split(), py_squad_norm(g).split()
    same = sum((Counter(pt) & Counter(gt)).values())
    if same == 0:
        return 0
    pr, rc = same / len(pt), same / len(gt)
    return 2 * pr * rc / (pr + rc)


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(i, *x[:2]) for i, x in enumerate(PAIRS)], "i int, p string, g string")


def test_em_and_char_f1(pairs):
    rows = pairs.select("i", E.exact_match("p", "g").alias("em"), E.char_f1("p", "g").alias("f1")).collect()
    for r in rows:
        _, _, em, f1 = PAIRS[r.i]
        assert r.em == em and r.f1 == pytest.approx(f1), PAIRS[r.i]


def test_squad_f1(pairs):
    rows = pairs.select("i", E.squad_f1("p", "g").alias("f1"), E.squad_em("p", "g").alias("em")).collect()
    for r in rows:
        p, g = PAIRS[r.i][:2]
        assert r.f1 == pytest.approx(py_squad_f1(p, g))
        assert r.em == (py_squad_norm(p) == py_squad_norm(g))


def test_dataset_scores_counts_missing_as_zero(spark):
    truth = spark.createDataFrame([("a", ["x"]), ("b", ["y", "z"]), ("c", ["w"])], "id string, answers array<string>")
    preds = spark.createDataFrame([("a", "x"), ("b", "z")], "id string, prediction_text string")
    r = E.dataset_scores(truth, preds).first()
    assert r.em == pytest.approx(2 / 3, abs=1e-6) and r.n_unanswered == 1
    assert r.em_str == f"{2 / 3:.2%}"


def test_percent_format_rounds_like_python(spark):
    for v in [0.00125, 0.5, 0.12345, 0.99995, 1 / 3]:
        got = spark.range(1).select(E.fmt_percent(F.lit(v)).alias("s")).first().s
        assert got == f"{v:.2%}"


def test_topk_accuracy(spark):
    ranked = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 12), (2, 2, 13), (3, 1, 14)],
                                   "qid long, rank int, document_id long")
    gold = spark.createDataFrame([(1, 11), (2, 12), (4, 99)], "qid long, document_id long")
    qs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "qid long")
    acc = {r.k: r.accuracy for r in E.topk_accuracy(ranked, gold, qs, ks=(1, 2)).collect()}
    assert acc == {1: 0.25, 2: 0.5}


def test_span_loss(spark):
    df = spark.createDataFrame([([1.0, 2.0, 0.5], [0.0, 0.0, 3.0], 1, 2), ([1.0, 2.0], [1.0, 1.0], 5, 0)],
                               "s array<double>, e array<double>, sp int, ep int")
    rows = df.select(*E.span_loss("s", "e", "sp", "ep")).collect()

    def ce(x, i):
        return math.log(sum(math.exp(v) for v in x)) - x[i]
    assert rows[0][0] == pytest.approx(ce([1, 2, .5], 1))
    assert rows[0][1] == pytest.approx(ce([0, 0, 3], 2))
    assert rows[1][0] is None          # clamped to L = ignored


def test_inbatch_contrastive(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    Q, P = rng.normal(size=(5, 4)), rng.normal(size=(5, 4))
    df = spark.createDataFrame([(i, 0, Q[i].tolist(), P[i].tolist()) for i in range(5)],
                               "qid long, batch_id long, qvec array<double>, pvec array<double>")
    got = E.inbatch_contrastive(df).first().loss
    S = Q @ P.T
    nll = [math.log(np.exp(S[i]).sum()) - S[i, i] for i in range(5)]
    assert got == pytest.approx(sum(nll) / 5, abs=1e-6)


@pytest.mark.parametrize("block", [1, 3, 7, 100])
def test_inbatch_contrastive_in_blocks(spark, block):
    """Batches of 1, 5 and 23 rows, larger than a block or not; large logits."""
    import numpy as np
    rng = np.random.default_rng(2)
    rows, expected, n = [], {}, 0
    for b, size in (("a", 1), ("b", 5), ("c", 23)):
        Q, P = rng.normal(size=(size, 3)) * 30, rng.normal(size=(size, 3)) * 30
        S = Q @ P.T
        high = S.max(axis=1)
        expected[b] = float(np.mean(high + np.log(np.exp(S - high[:, None]).sum(axis=1)) - np.diag(S)))
        rows += [(n + i, b, Q[i].tolist(), P[i].tolist()) for i in range(size)]
        n += size
    df = spark.createDataFrame(rows, "qid long, batch_id string, qvec array<double>, pvec array<double>").repartition(5)
    got = {r.batch_id: (r.loss, r.n) for r in E.inbatch_contrastive(df, block=block).collect()}
    assert {b: x[1] for b, x in got.items()} == {"a": 1, "b": 5, "c": 23}
    assert all(got[b][0] == pytest.approx(expected[b], abs=2e-6) for b in expected)


@pytest.mark.parametrize("size", [3, 200, 1600])
def test_f1_counts_repeats_of_long_texts(spark, size):
    import random
    rng = random.Random(size)
    p, g = ([rng.choice(["x", "y", "zz", "w w"[:1]]) + str(rng.randrange(size // 2 + 1)) for _ in range(size)] for _ in range(2))
    df = spark.createDataFrame([(" ".join(p), " ".join(g)), ("", ""), (" ".join(p), "")], "p string, g string")
    got = [r.s for r in df.select(E.squad_f1("p", "g").alias("s")).collect()]
    assert got[0] == pytest.approx(py_squad_f1(" ".join(p), " ".join(g))) and got[1:] == [0.0, 0.0]


def test_scores_json_matches_python_dumps(spark):
    import json
    truth = spark.createDataFrame([("a", ["x"]), ("b", ["y"])], "id string, answers array<string>")
    preds = spark.createDataFrame([("a", "x"), ("b", "q")], "id string, prediction_text string")
    got = E.scores_json(E.dataset_scores(truth, preds)).first().report
    exp = json.dumps({"EM": {"value": f"{0.5:.2%}", "rank": True, "decs": True},
                      "F1": {"value": f"{0.5:.2%}", "rank": False, "decs": True}})
    assert got == exp


def test_length_histogram_matches_numpy(spark):
    import numpy as np
    from quarry.operators import profile as P
    lens = [0, 1, 166, 167, 2500, 4999, 5000, 5001, 12000, 333]
    df = spark.createDataFrame([("x" * n,) for n in lens], "text string")
    got = {r.bin: r.n for r in P.length_histogram(df).collect()}
    counts, _ = np.histogram(lens, bins=30, range=(0, 5000))
    assert [got.get(b, 0) for b in range(30)] == counts.tolist()


def test_topk_accuracy_by_context(spark):
    corpus = spark.createDataFrame([(1, "The  cat’s mat"), (2, "a dog"), (3, "x")],
                                   "document_id long, text string")
    ranked = spark.createDataFrame([(7, 1, 2), (7, 2, 1), (8, 1, 3), (9, 1, 2)],
                                   "qid long, rank int, document_id long")
    qs = spark.createDataFrame([(7, "The cat's mat "), (8, "nothing"), (9, "a  dog")],
                               "qid long, context string")
    acc = {r.k: (r.hits, r.n_questions) for r in E.topk_accuracy_by_context(ranked, corpus, qs, ks=(1, 2)).collect()}
    assert acc == {1: (1, 3), 2: (2, 3)}


def test_f1_random_pairs(spark):
    import random
    rng = random.Random(3)
    alphabet = list("abcde ÉéüßA.,!'\"()《》-_ ") + ["the", "an", "a "]
    pairs = [("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))),
              "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))) for _ in range(300)]
    df = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(pairs)], "i int, p string, g string")
    rows = df.select("i", E.char_f1("p", "g").alias("c"), E.squad_f1("p", "g").alias("s"),
                     E.exact_match("p", "g").alias("em"),
                     T.normalize_answer(F.col("p")).alias("np"), T.normalize_answer(F.col("g")).alias("ng")).collect()
    for r in rows:
        p, g = pairs[r.i]
        assert r.c == pytest.approx(char_multiset_f1(r.np, r.ng)), (p, g)
        assert r.s == pytest.approx(py_squad_f1(p, g)), (p, g)
        assert r.em == (r.np == r.ng)


def test_by_context_makes_questions_once(spark):
    made = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b
    corpus = spark.createDataFrame([(i, f"text  {i}") for i in range(6)], "document_id long, text string")
    qs = spark.createDataFrame([(1, "text 3"), (2, "text 9"), (3, None)], "qid long, context string")
    qs = qs.mapInArrow(passed, "qid long, context string")
    ranked = spark.createDataFrame([(q, r, (r + q) % 6) for q in (1, 2, 3) for r in (1, 2, 3)], "qid long, rank int, document_id long")
    got = {r.k: (r.hits, r.n_questions) for r in E.topk_accuracy_by_context(ranked, corpus, qs, ks=(1, 2)).collect()}
    assert got == {1: (0, 3), 2: (1, 3)} and made.value == 3
