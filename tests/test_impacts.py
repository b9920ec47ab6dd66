"""BM25 with impact bounds equals the plain search and scores fewer rows."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import impacts as M
from quarry.operators import index as I
from quarry.operators import retrieve as R


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(4)
    rows = []
    for d in range(400):
        words = [f"c{rng.randrange(4)}" for _ in range(rng.randrange(3, 25))]
        words += [f"m{rng.randrange(60)}" for _ in range(rng.randrange(6))]
        words += [f"r{rng.randrange(400)}" for _ in range(rng.randrange(3))]
        rows.append((d, "t", " ".join(words)))
    docs = I.prepare_corpus(spark.createDataFrame(rows, "document_id long, title string, text string"))
    index = I.build_bm25(docs)
    qs = [(0, "c0 c1 r3 m4"), (1, "c0"), (2, "nothing here"), (3, "r1 r2 r3 r4 r5"), (4, "m1 m1 m2 c3"), (5, "")]
    qs += [(10 + i, " ".join(rng.choice(rows)[2].split()[:12])) for i in range(20)]
    return index, spark.createDataFrame(qs, "qid long, question string")


@pytest.mark.parametrize("k,block_docs,seed_rows", [(3, 8, None), (10, 64, 40), (1, 1, 5), (500, 16, None)])
def test_equals_plain_search(world, k, block_docs, seed_rows):
    index, qs = world
    got = M.topk(M.build(index, block_docs), qs, k, seed_rows).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, R.bm25_topk(index, qs, k).collect()))


def test_frequent_terms_are_scored_for_few_documents(spark):
    from quarry.plans import fixtures as fx
    from tests.conftest import SF01
    index = I.build_bm25(I.prepare_corpus(fx.corpus(spark, SF01)))
    m = M.build(index, 8)
    side = M._question_side(m, fx.questions(spark, SF01), 2000).cache()
    split = M.split_terms(m, side, M.thresholds(m, side, 10)).cache()
    live = M.survivors(m, split).cache()
    every = index.postings.join(side, "term").count()
    essential = index.postings.join(split.filter("essential"), "term").count()
    frequent = M.frequent_postings(m, split, live).count()
    print(every, essential, frequent)
    assert essential + frequent < 0.6 * every


def test_bounds_hold(world):
    index, _ = world
    m = M.build(index, 8)
    over = m.postings.join(m.bounds, ["term", "block"]).join(m.terms.select("term", "most"), "term").filter(
        (F.col("impact") > F.col("top")) | (F.col("top") > F.col("most")))
    assert over.count() == 0
    sizes = m.postings.groupBy("block").agg(F.count_distinct("document_id").alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= 8
