"""IVF over TF-IDF vectors against dense numpy models."""

import random

import numpy as np
import pytest

from quarry.operators import index as I
from quarry.operators import retrieve as R
from quarry.operators import sparse_ivf as V


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(8)
    rows = []
    for d in range(180):
        topic = d % 4
        words = [f"t{topic}w{rng.randrange(12)}" for _ in range(rng.randrange(4, 14))] + [f"c{rng.randrange(6)}" for _ in range(4)]
        rows.append((d, f"s{topic}", " ".join(words)))
    docs = I.prepare_corpus(spark.createDataFrame(rows, "document_id long, title string, text string"))
    return I.build_tfidf(docs, max_features=400)


@pytest.fixture(scope="module")
def questions(spark):
    qs = [(0, "t0w1 t0w2 c1"), (1, "t3w1 t3w5"), (2, "c1 c2 c3"), (3, "t1w1 t2w1")]
    return spark.createDataFrame(qs, "qid long, question string")


def dense(frame, row, value):
    rows = frame.collect()
    terms = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    out = {}
    for r in rows:
        out.setdefault(r[row], {})[r["term"]] = r[value]
    return terms, out


def test_values_are_dot_products_less_half_norms(index):
    cents = V.kmeans(index, num_clusters=5, iterations=2, top_terms=30)
    _, docs = dense(index.weights, "document_id", "w")
    _, model = dense(cents, "cluster_id", "c")
    for c in model.values():
        own = {t: x for t, x in c.items() if t != V.BIAS}
        assert len(own) <= 30 and c[V.BIAS] == pytest.approx(-sum(x * x for x in own.values()) / 2)
    values = {(r.document_id, r.cluster_id): r.value for r in V.cluster_values(index.weights, cents, V.DOC).collect()}
    assert len(values) == len(docs) * len(model)
    for (d, c), v in values.items():
        dot = sum(x * docs[d].get(t, 0.0) for t, x in model[c].items() if t != V.BIAS)
        assert v == pytest.approx(dot + model[c][V.BIAS])
    chosen = {r.document_id: r.cluster_id for r in V.assign(index.weights, cents).collect()}
    for d in docs:
        best = max(round(values[d, c], 9) for c in model)
        assert chosen[d] == min(c for c in model if round(values[d, c], 9) == best)


def loss(index, cents):
    values = V.cluster_values(index.weights, cents, V.DOC).collect()
    best = {}
    for r in values:
        best[r.document_id] = max(best.get(r.document_id, -9), r.value)
    return -2 * sum(best.values())


def test_rounds_lower_the_distance(index):
    steps = [loss(index, V.kmeans(index, num_clusters=4, iterations=n, top_terms=400)) for n in (0, 2, 6)]
    assert steps[0] > steps[1] >= steps[2] - 1e-9


def test_full_probe_is_exact_search(index, questions):
    ivf = V.build_lists(index, V.kmeans(index, num_clusters=6, iterations=3, top_terms=20))
    assert ivf.lists.select("dkey", "term").distinct().count() == index.weights.count()
    exact = {(r.qid, r.document_id): r.score for r in R.tfidf_topk(index, questions, k=180).collect()}
    got = {(r.qid, r.document_id): r.score for r in V.topk(ivf, questions, k=180, nprobe=6).collect()}
    assert set(got) == set(exact)
    assert all(got[x] == pytest.approx(2 - 2 * exact[x], abs=2e-6) for x in got)


def test_probing_is_a_subset_with_good_recall(index, questions):
    ivf = V.build_lists(index, V.kmeans(index, num_clusters=6, iterations=4))
    exact = {(r.qid, r.document_id) for r in R.tfidf_topk(index, questions, k=5).collect()}
    last = -1
    for nprobe in (1, 3, 6):
        found = {(r.qid, r.document_id) for r in V.topk(ivf, questions, k=5, nprobe=nprobe).collect()} & exact
        assert len(found) >= last
        last = len(found)
    assert last == len(exact)
    means = V.centroids_by_label(index, ivf.lists.select(*V.DOC, "cluster_id").distinct(), 400)
    assert means.select("cluster_id").distinct().count() == ivf.lists.select("cluster_id").distinct().count()


def test_empty_clusters_keep_their_centroid(index):
    many = V.kmeans(index, num_clusters=60, iterations=2, top_terms=5, train_docs=70)
    assert many.select("cluster_id").distinct().count() <= 60
    assert np.isfinite([r.c for r in many.collect()]).all()
