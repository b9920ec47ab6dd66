"""Scores in the tasks that hold the documents equal the sums of the join."""

import dataclasses
import random

import pyarrow as pa
import pytest

from quarry.operators import impacts as M
from quarry.operators import index as I
from quarry.operators import retrieve as R
from quarry.operators import scan
from quarry.operators import sparse_ivf as V


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(5)
    rows = [(f"d{i:03}", f"s{i % 3}", " ".join(rng.choice(["a", "b", "c", *(f"w{j}" for j in range(30))])
                                                 for _ in range(rng.randrange(0, 15)))) for i in range(150)]
    docs = I.prepare_corpus(spark.createDataFrame(rows, "document_id string, title string, text string")).cache()
    qs = [(f"q{i}", " ".join(rng.choice(rows)[2].split()[:5])) for i in range(12)] + [("none", "zebra"), (None, "a w3"), ("e", "")]
    return docs, spark.createDataFrame(qs, "qid string, question string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def no_pair_shuffle(df) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "hashpartitioning(qid" in plan and not any(
        "hashpartitioning(" in line and "dkey" in line and "qid" in line for line in plan.splitlines())


@pytest.mark.parametrize("pad", [False, True])
def test_bm25_equals_the_join_and_moves_no_pairs(world, pad):
    docs, qs = world
    index = I.build_bm25(docs)
    postings_only = dataclasses.replace(index, documents=None)
    for d in ((None, docs) if pad else (None,)):
        got = R.bm25_topk(index, qs, k=7, pad_zero=pad, docs=d)
        assert no_pair_shuffle(got)
        assert rows(got) == rows(R.bm25_topk(postings_only, qs, k=7, pad_zero=pad, docs=d))


def test_tfidf_and_ivf_equal_the_join_and_move_no_pairs(world):
    docs, qs = world
    index = I.build_tfidf(docs, max_features=120)
    rows_only = dataclasses.replace(index, vectors=None, counts=None)
    got = R.tfidf_topk(index, qs, k=6)
    assert no_pair_shuffle(got) and rows(got) == rows(R.tfidf_topk(rows_only, qs, k=6))
    assert rows(got) == rows(R.tfidf_topk(dataclasses.replace(index, counts=None), qs, k=6))
    assert "Window" not in index.weights._jdf.queryExecution().executedPlan().toString()
    ivf = V.build_lists(index, V.kmeans(index, num_clusters=4, iterations=2))
    assert rows(ivf.documents.select(*V.DOC, "cluster_id")) == rows(V.assign(index.weights, ivf.centroids))
    got = V.topk(ivf, qs, k=6, nprobe=2)
    assert no_pair_shuffle(got) and rows(got) == rows(V.topk(dataclasses.replace(ivf, documents=None), qs, k=6, nprobe=2))


def test_impacts_move_no_postings(world):
    docs, qs = world
    index = I.build_bm25(docs)
    got = M.topk(M.build(index, 4), qs, k=5, seed_rows=20)
    assert no_pair_shuffle(got) and rows(got) == rows(R.bm25_topk(index, qs, k=5))


def test_impacts_in_slices_of_questions(spark, world, monkeypatch):
    docs, qs = world
    index = I.build_bm25(docs)
    m = M.build(index, 4)
    monkeypatch.setattr(M, "broadcast_limit", lambda spark: 700)
    assert rows(M.topk(m, qs, k=5, seed_rows=20)) == rows(R.bm25_topk(index, qs, k=5))


@pytest.mark.parametrize("cells,pairs", [(1, 1), (40, 7), (1 << 20, 1 << 21)])
def test_tiles(monkeypatch, cells, pairs):
    monkeypatch.setattr(scan, "CELLS", cells)
    monkeypatch.setattr(scan, "PAIRS", pairs)
    rng = random.Random(1)
    docs = [[{"term": t, "x": rng.randrange(1, 5)} for t in rng.sample("abcdef", rng.randrange(0, 6))] for _ in range(40)] + [None]
    side = [(q, t, rng.random()) for q in range(9) for t in rng.sample("abcxyz", 3)]
    made = scan.by_term(pa.table({"q": [s[0] for s in side], "term": [s[1] for s in side], "w": [s[2] for s in side]}), "q", "w")
    lists = pa.array(docs, pa.list_(pa.struct([("term", pa.string()), ("x", pa.int32())])))
    got, seen = {}, []
    for a, n, cell, x, entry in scan.products(lists.slice(3), lambda x, row: x, made):
        seen.append((a, n))
        for c, v in zip(cell, x * made.w[entry]):
            key = a + c // made.n + 3, made.qids[c % made.n].as_py()
            got[key] = got.get(key, 0) + v
    want = {}
    for i, d in enumerate(docs):
        for p in d or []:
            for q, t, w in side:
                if t == p["term"] and i >= 3:
                    want[i, q] = want.get((i, q), 0) + w * p["x"]
    assert got == pytest.approx(want) and sum(n for _, n in seen) == 38
