"""Sparse and dense top-k against brute-force Python models."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import index as I
from quarry.operators import retrieve as R

CORPUS = [
    (1, "a", "the cat sat on the mat"),
    (2, "b", "the dog sat on the log"),
    (3, "c", "cats and dogs"),
    (4, "a", "the cat sat on the mat"),          # duplicate of 1 (same title+text)
    (5, "d", ""),                                # empty document
    (6, "e", "a mat for the cat and the dog"),
]
QUESTIONS = [(10, "cat on mat"), (11, "dog dog log"), (12, "zebra"), (13, "the")]


def py_bm25(docs, query, k1=1.5, b=0.75, eps=0.25):
    toks = {d: t.split() for d, t in docs.items()}
    N = len(toks)
    avgdl = sum(len(t) for t in toks.values()) / N
    df = Counter(w for t in toks.values() for w in set(t))
    idf = {w: math.log(N - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: (eps * mean if v < 0 else v) for w, v in idf.items()}
    out = {}
    for d, t in toks.items():
        c = Counter(t)
        s = sum(idf.get(q, 0) * c[q] * (k1 + 1) / (c[q] + k1 * (1 - b + b * len(t) / avgdl))
                for q in query.split())
        # documents sharing a query term
        if any(q in c for q in query.split()):
            out[d] = round(s, 6)
    return out


def expected_topk(scores, k):
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "document_id long, title string, text string")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "qid long, question string")


def test_prepare_corpus_dedup_keeps_first(corpus):
    ids = sorted(r.document_id for r in I.prepare_corpus(corpus).collect())
    assert ids == [1, 2, 3, 5, 6]


@pytest.mark.parametrize("parts", [1, 7])
def test_bm25_matches_model(spark, corpus, questions, parts):
    docs = I.prepare_corpus(corpus.repartition(parts))
    ptext = {r.document_id: r.ptext for r in docs.collect()}
    top = R.bm25_topk(I.build_bm25(docs), questions, k=3).collect()
    for qid, q in QUESTIONS:
        exp = expected_topk(py_bm25(ptext, q), 3)
        got = [(r.document_id, r.score) for r in sorted(top, key=lambda r: r.rank) if r.qid == qid]
        assert [g[0] for g in got] == [e[0] for e in exp]
        assert all(abs(a[1] - b[1]) < 1e-6 for a, b in zip(got, exp))


def test_tfidf_full_k_is_superset(spark, corpus, questions):
    docs = I.prepare_corpus(corpus)
    idx = I.build_tfidf(docs, max_features=1000)
    small = {(r.qid, r.document_id) for r in R.tfidf_topk(idx, questions, k=2).collect()}
    full = {(r.qid, r.document_id) for r in R.tfidf_topk(idx, questions, k=100).collect()}
    assert small <= full
    # unit-norm document vectors
    norms = idx.weights.groupBy("document_id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-9 for r in norms)


def test_oov_report(spark, corpus, questions):
    docs = I.prepare_corpus(corpus)
    idx = I.build_tfidf(docs)
    rep = {r.qid: r.all_oov for r in R.oov_report(
        idx.vocab, questions, lambda c: I.tfidf_terms(c)).collect()}
    assert rep[12] is True and rep[10] is False


def _vectors(spark, n=60, q=7, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    P = rng.normal(size=(n, dim)).astype(np.float32)
    Q = rng.normal(size=(q, dim)).astype(np.float32)
    p = spark.createDataFrame([(i, i // 3, P[i].tolist(), i % 4) for i in range(n)],
                              "pid long, document_id long, vec array<float>, label int")
    qq = spark.createDataFrame([(i, Q[i].tolist()) for i in range(q)], "qid long, vec array<float>")
    return P, Q, p, qq


@pytest.mark.parametrize("rows_per_block,q_per_block,stream",
                         [(7, 2, False), (1000, 1000, False), (1000, 3, True)])
def test_dense_topk_brute_force(spark, rows_per_block, q_per_block, stream):
    P, Q, p, q = _vectors(spark)
    got = R.dense_topk(p, q, k=5, rows_per_block=rows_per_block,
                       queries_per_block=q_per_block, stream=stream).collect()
    S = np.round(Q.astype(np.float64) @ P.astype(np.float64).T, 6)
    for i in range(len(Q)):
        exp = sorted(range(len(P)), key=lambda j: (-S[i, j], j))[:5]
        assert [r.pid for r in sorted(got, key=lambda r: r.rank) if r.qid == i] == exp


@pytest.mark.parametrize("stream", [False, True])
def test_dense_distinct_documents(spark, stream):
    P, Q, p, q = _vectors(spark)
    got = R.dense_topk(p.repartition(5), q, k=4, group_col="document_id", rows_per_block=9,
                       queries_per_block=3, stream=stream).collect()
    S = np.round(Q.astype(np.float64) @ P.astype(np.float64).T, 6)
    for i in range(len(Q)):
        best = {}
        for j in range(len(P)):
            d = j // 3
            if d not in best or (-S[i, j], j) < (-S[i, best[d]], best[d]):
                best[d] = j
        exp = sorted(best, key=lambda d: (-S[i, best[d]], d))[:4]
        assert [r.document_id for r in sorted(got, key=lambda r: r.rank) if r.qid == i] == exp


@pytest.mark.parametrize("stream", [False, True])
def test_ivf_all_probes_equals_exact(spark, stream):
    P, Q, p, q = _vectors(spark)
    cents = R.centroids_by_label(p)
    assigned = R.ivf_assign(p, cents)
    got = R.ivf_topk(assigned, q, cents, k=5, nprobe=4, rows_per_block=5, stream=stream).collect()
    D = ((Q[:, None, :].astype(np.float64) - P[None, :, :].astype(np.float64)) ** 2).sum(-1)
    D = np.round(D, 6)
    for i in range(len(Q)):
        exp = sorted(range(len(P)), key=lambda j: (D[i, j], j))[:5]
        assert [r.pid for r in sorted(got, key=lambda r: r.rank) if r.qid == i] == exp


def test_bm25_pad_zero(spark, corpus, questions):
    docs = I.prepare_corpus(corpus)
    top = R.bm25_topk(I.build_bm25(docs), questions, k=4, pad_zero=True).collect()
    by_q = {}
    for r in top:
        by_q.setdefault(r.qid, []).append(r)
    assert all(len(v) == 4 for v in by_q.values()) and set(by_q) == {10, 11, 12, 13}
    zebra = sorted(by_q[12], key=lambda r: r.rank)
    assert [r.document_id for r in zebra] == [1, 2, 3, 5] and all(r.score == 0 for r in zebra)


def test_bm25_ranks_negative_scores(spark):
    """Terms in more than half of the documents: three matches below zero, one
    document that shares nothing."""
    rows = [(1, "c c c", "x"), (2, "c c", "y x"), (3, "z", "w"), (4, "c", "v u x y")]
    docs = spark.createDataFrame([(f"k{d}", d, "t", a + " " + b) for d, a, b in rows],
                                 "dkey string, document_id long, title string, ptext string")
    q = spark.createDataFrame([(1, "c x"), (2, "nothing")], "qid long, question string")
    index = I.build_bm25(docs)
    scores = {r.document_id: r.score for r in R.bm25_scores(index, q).collect()}
    assert set(scores) == {1, 2, 4}
    # make the floor negative whatever the small corpus gives
    index.terms = index.terms.withColumn("idf", F.lit(-0.1))
    scores = py = {r.document_id: round(r.score, 6) for r in R.bm25_scores(index, q).collect()}
    assert max(py.values()) < 0
    got = [r.document_id for r in R.bm25_topk(index, q, k=4).orderBy("rank").collect() if r.qid == 1]
    assert got == sorted(scores, key=lambda d: (-scores[d], d))
    padded = R.bm25_topk(index, q, k=4, pad_zero=True, docs=docs).orderBy("qid", "rank").collect()
    assert [r.document_id for r in padded if r.qid == 1] == [3, *got]
    assert [(r.document_id, r.score) for r in padded if r.qid == 2] == [(d, 0.0) for d in (1, 2, 3, 4)]


@pytest.mark.parametrize("seed", [1, 2])
def test_bm25_padding_matches_model(spark, seed):
    rng = random.Random(seed)
    docs = {i * 3: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for i in range(25)}
    queries = {1: "a b", 2: "h", 3: "zz", 4: "a b c d e f g h"}
    frame = spark.createDataFrame([(f"k{d}", d, "t", t) for d, t in docs.items()],
                                  "dkey string, document_id long, title string, ptext string")
    qs = spark.createDataFrame(list(queries.items()), "qid long, question string")
    got = R.bm25_topk(I.build_bm25(frame), qs, k=8, pad_zero=True, docs=frame).collect()
    for q, text in queries.items():
        scores = {**dict.fromkeys(docs, 0.0), **py_bm25(docs, text)}
        assert [r.document_id for r in sorted(got, key=lambda r: r.rank) if r.qid == q] == [
            d for d, _ in expected_topk(scores, 8)]


@pytest.mark.parametrize("stream", [True, False])
@pytest.mark.parametrize("grouped", [None, "document_id"])
def test_dense_takes_string_ids(spark, stream, grouped):
    rng = random.Random(8)
    vec = lambda: [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]
    # one document holds half of all passages
    p = [(f"p{i}", "hot" if i % 2 else f"d{i % 7}é", vec()) for i in range(60)]
    q = [(f"q{i}", vec()) for i in range(5)]
    passages = spark.createDataFrame(p, "pid string, document_id string, vec array<double>")
    queries = spark.createDataFrame(q, "qid string, vec array<double>")
    got = R.dense_topk(passages, queries, k=3, group_col=grouped, rows_per_block=7, queries_per_block=2,
                       stream=stream).collect()
    for qid, v in q:
        rows = sorted((-sum(a * b for a, b in zip(v, w)), doc if grouped else pid, pid) for pid, doc, w in p)
        seen, want = set(), []
        for _, group, pid in rows:
            if group not in seen:
                seen.add(group)
                want.append(pid)
        assert [r.pid for r in sorted(got, key=lambda r: r.rank) if r.qid == qid] == want[:3]


def test_ivf_takes_string_ids_and_centroids_over_the_limit(spark):
    vecs = [(f"p{i}", [float(i % 3), float(i % 5)]) for i in range(30)]
    passages = spark.createDataFrame(vecs, "pid string, vec array<double>")
    cents = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 4.0])], "cluster_id int, centroid array<double>")
    queries = passages.limit(4).withColumnRenamed("pid", "qid")
    a, b = (sorted(map(tuple, R.ivf_topk(R.ivf_assign(passages, cents), queries, cents, k=3, nprobe=2,
                                         rows_per_block=5, stream=s).select("qid", "rank", "pid").collect()))
            for s in (True, False))
    assert a == b and len(a) == 12
    spark.conf.set("quarry.broadcast.maxBytes", "10")
    try:
        c = sorted(map(tuple, R.ivf_topk(R.ivf_assign(passages, cents, rows_per_block=7), queries, cents, k=3, nprobe=2,
                                         rows_per_block=5).select("qid", "rank", "pid").collect()))
        assert c == a
    finally:
        spark.conf.unset("quarry.broadcast.maxBytes")


def py_tfidf_scores(ptext, queries, max_features):
    import math
    from collections import Counter
    def grams(t):
        toks = t.lower().split()
        return toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]
    docs = {d: Counter(grams(t)) for d, t in ptext.items()}
    cf = Counter()
    df = Counter()
    for c in docs.values():
        cf.update(c)
        df.update(c.keys())
    vocab = sorted(cf, key=lambda t: (-cf[t], t))[:max_features]
    n = len(docs)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocab}
    def vec(c):
        w = {t: c[t] * idf[t] for t in c if t in idf}
        z = math.sqrt(sum(v * v for v in w.values()))
        return {t: v / z for t, v in w.items()} if z else {}
    dv = {d: vec(c) for d, c in docs.items()}
    out = {}
    for qid, q in queries:
        qv = vec(Counter(grams(q)))
        s = {d: round(sum(qv[t] * v.get(t, 0.0) for t in qv), 6) for d, v in dv.items()}
        out[qid] = {d: x for d, x in s.items() if any(t in v for t in qv for v in [dv[d]])}
    return out


def test_tfidf_random_corpus_matches_model(spark):
    import random
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    rows = [(i, f"t{i % 3}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))))
            for i in range(30)]
    corpus = spark.createDataFrame(rows, "document_id long, title string, text string")
    qs = [(1, "alpha beta"), (2, "zeta zeta eta"), (3, "t1 gamma")]
    docs = I.prepare_corpus(corpus)
    ptext = {r.document_id: r.ptext for r in docs.collect()}
    idx = I.build_tfidf(docs, max_features=15)
    got = R.tfidf_topk(idx, spark.createDataFrame(qs, "qid long, question string"), k=5).collect()
    model = py_tfidf_scores(ptext, qs, 15)
    for qid, _ in qs:
        exp = sorted(model[qid].items(), key=lambda x: (-x[1], x[0]))[:5]
        g = [(r.document_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.qid == qid]
        assert [d for d, _ in g] == [d for d, _ in exp]
        assert all(abs(a[1] - b[1]) < 1e-6 for a, b in zip(g, exp))


def test_bm25_random_corpus_negative_idf(spark):
    import random
    rng = random.Random(17)
    common = ["the", "of", "and"]                 # in most documents: negative raw idf
    rare = ["kiwi", "fig", "lime", "plum", "pear", "date"]
    rows = []
    for i in range(40):
        toks = [rng.choice(common) for _ in range(rng.randint(1, 6))]
        toks += [rng.choice(rare) for _ in range(rng.randint(0, 3))]
        rng.shuffle(toks)
        rows.append((i, "t", " ".join(toks)))
    corpus = spark.createDataFrame(rows, "document_id long, title string, text string")
    qs = [(1, "the fig fig"), (2, "and of"), (3, "plum pear the")]
    docs = I.prepare_corpus(corpus)
    ptext = {r.document_id: r.ptext for r in docs.collect()}
    top = R.bm25_topk(I.build_bm25(docs), spark.createDataFrame(qs, "qid long, question string"),
                      k=6).collect()
    for qid, q in qs:
        exp = expected_topk(py_bm25(ptext, q), 6)
        got = [(r.document_id, r.score) for r in sorted(top, key=lambda r: r.rank) if r.qid == qid]
        assert [g[0] for g in got] == [e[0] for e in exp]
        assert all(abs(a[1] - b[1]) < 1e-6 for a, b in zip(got, exp))


@pytest.mark.parametrize("string_ids", [False, True])
@pytest.mark.parametrize("block,k", [(2, 2), (5, 4), (1024, 6)])
def test_padding_by_blocks_matches_sorting(spark, monkeypatch, string_ids, block, k):
    """Score-0 documents are the unmatched ones of smallest id, whatever the
    matched ones are: none, all, the first, every other."""
    import random
    monkeypatch.setattr(R, "PAD_BLOCK", block)
    rng = random.Random(block)
    ids = [f"d{i:03d}" if string_ids else i * 3 - 20 for i in range(40)]
    matched = {0: [], 1: ids, 2: ids[:17], 3: ids[::2], 4: ids[1:30], 5: rng.sample(ids, 33), 6: ids[20:]}
    scores = [(q, d, -0.5 if (i + q) % 9 else 1.5) for q, own in matched.items() for i, d in enumerate(own)]
    kind = "string" if string_ids else "long"
    pairs = spark.createDataFrame(scores, f"qid long, document_id {kind}, score double")
    docs = spark.createDataFrame([(d,) for d in ids + ids[:3]], f"document_id {kind}")
    qs = spark.createDataFrame([(q,) for q in matched], "qid long")
    got = {}
    for r in R.rank_topk(R.with_zero_padding(pairs, docs, qs, k), k).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.document_id, r.score))
    for q, own in matched.items():
        rows = [(s, d) for qq, d, s in scores if qq == q] + [(0.0, d) for d in ids if d not in set(own)]
        best = sorted(rows, key=lambda x: (-x[0], x[1]))[:k]
        assert sorted(got[q]) == [(i + 1, d, s) for i, (s, d) in enumerate(best)]


def _near(v, cents, nprobe):
    far = sorted((round(sum((x - y) ** 2 for x, y in zip(v, c)), 9), i) for i, c in cents)
    return [i for _, i in far[:nprobe]]


@pytest.mark.parametrize("nprobe", [1, 3, 9])
def test_nearest_centroids_both_ways_equal_brute_force(spark, nprobe):
    import random
    rng = random.Random(nprobe)
    cents = [(i, [float(rng.randrange(4)) for _ in range(3)]) for i in rng.sample(range(-5, 60), 7)]   # ties
    vecs = [(i, [float(rng.randrange(4)) for _ in range(3)]) for i in range(120)] + [(500, [1.0, 1.0, 1.0])] * 60
    c = spark.createDataFrame(cents, "cluster_id int, centroid array<double>")
    q = spark.createDataFrame(vecs, "qid long, vec array<double>").repartition(3)
    want = sorted((i, n) for i, v in vecs for n in _near(v, cents, nprobe))
    for how in (dict(stream=True), dict(stream=False, rows_per_block=40), dict(stream=False, rows_per_block=10_000)):
        got = R.ivf_probes(q, c, nprobe, **how).select("qid", "cluster_id").collect()
        assert sorted(map(tuple, got)) == want


def test_blocks_of_vectors_keep_rows_whole(spark):
    rows = [(i, None if i % 3 else "x", [float(i), 0.0], 7 * i) for i in range(50)]
    v = spark.createDataFrame(rows, "pid long, `a b` string, vec array<float>, block long")
    c = spark.createDataFrame([(2, [0.0, 0.0]), (4, [40.0, 0.0])], "cluster_id int, centroid array<double>")
    got = R.ivf_assign(v, c, stream=False, rows_per_block=9)
    assert got.columns == v.columns + ["cluster_id"]
    assert sorted(tuple(r)[:4] for r in got.collect()) == rows
    assert {r.pid: r.cluster_id for r in got.collect()} == {i: 2 if i <= 20 else 4 for i in range(50)}
    assert R.ivf_assign(v.filter("pid < 0"), c, stream=False).count() == 0
    for stream in (True, False):
        with pytest.raises(Exception, match="no centroids"):
            R.ivf_assign(v, c.filter("cluster_id > 9"), stream=stream).count()


def test_nearest_in_tiles(monkeypatch):
    import numpy as np
    rng = np.random.default_rng(1)
    V, C, ids = rng.integers(0, 5, (70, 4)).astype(float), rng.integers(0, 5, (31, 4)).astype(float), np.arange(3, 34)
    V[5] = np.nan
    D = np.round(((V[:, None] - C[None]) ** 2).sum(2), 9)
    D[np.isnan(D)] = np.inf
    for nprobe in (1, 4, 40):
        want = ids[np.lexsort((np.broadcast_to(ids, D.shape), D), axis=1)[:, :nprobe]]
        for tile in (8, 1_000, 8 << 20):
            monkeypatch.setattr(R, "TILE_BYTES", tile)
            near = R._Nearest(V, nprobe)
            for a in range(0, 31, 6):
                near.offer(ids[a:a + 6], C[a:a + 6])
            row, got = near.pairs()
            assert (got.reshape(70, -1) == want).all() and (row == np.repeat(np.arange(70), want.shape[1])).all()
