"""Heaviest terms by merged summaries equal a plain count."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import heavy as H


def _rows(seed, n, words):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(words)]
    return [(f"w{i}", rng.randrange(1, 4)) for i in rng.choices(range(words), weights, k=n)]


def _brute(rows, k):
    cf, df = Counter(), Counter()
    for t, n in rows:
        if t is not None:
            cf[t] += n
            df[t] += 1
    best = sorted(cf, key=lambda t: (-cf[t], t))[:k]
    return sorted((t, cf[t], df[t]) for t in best)


@pytest.fixture(scope="module")
def table(spark):
    rows = _rows(1, 30_000, 3_000)
    return rows, spark.createDataFrame(rows, "term string, tf long").repartition(5).cache()


@pytest.mark.parametrize("k,capacity", [(1, 40), (10, 200), (20, 2_000), (50, None), (300, 320), (5_000, 10)])
def test_equals_plain_count(table, k, capacity):
    rows, df = table
    assert sorted(map(tuple, H.top_terms(df, k, capacity).collect())) == _brute(rows, k)


def test_recount_reads_only_candidates(table, monkeypatch):
    rows, df = table
    seen, plain = [], H._exact
    monkeypatch.setattr(H, "_exact", lambda r, k: seen.append(r.select("term").distinct().count()) or plain(r, k))
    assert sorted(map(tuple, H.top_terms(df, 20, 400).collect())) == _brute(rows, 20)
    assert len(seen) == 1 and seen[0] < 200


def test_bounds_hold_for_every_hash(spark, table):
    rows, df = table
    true = dict(map(tuple, df.groupBy(F.xxhash64("term").alias("h")).agg(F.sum("tf")).collect()))
    for capacity in (3, 50, 1_000):
        got = dict(map(tuple, H.summary(df, capacity).collect()))
        short = got.pop(None)
        assert len(got) <= 5 * capacity and short > 0
        assert all(got.get(h, 0) <= n <= got.get(h, 0) + short for h, n in true.items())
    whole = dict(map(tuple, H.summary(df, 10_000).collect()))
    assert whole == true


def test_terms_that_share_a_hash(table, monkeypatch):
    """One hash for many terms lifts the floor above the answer's counts; the
    exact count shows it and the search goes on under a lower floor."""
    rows, df = table
    monkeypatch.setattr(H, "term_hash", lambda t: F.pmod(F.xxhash64(t), F.lit(60)))
    for k in (5, 40, 59, 60, 100):
        assert sorted(map(tuple, H.top_terms(df, k, 55).collect())) == _brute(rows, k)


def test_ties_nulls_long_and_empty_terms(spark):
    rows = [(f"t{i % 90:02d}", 2) for i in range(900)] + [(None, 9)] * 50 + [("", 500), ("x" * 100_000, 400)]
    df = spark.createDataFrame(rows, "term string, tf long").repartition(4)
    for k, capacity in ((2, 5), (10, 95), (91, 91), (500, 20)):
        assert sorted(map(tuple, H.top_terms(df, k, capacity).collect())) == _brute(rows, k)


def test_extra_columns_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1, 7, 8), ("a", 2, 7, 8), ("b", 1, 7, 8)], "term string, tf int, h long, n long")
    assert sorted(map(tuple, H.top_terms(df.coalesce(1), 1, 1).collect())) == [("a", 3, 2)]
    assert H.top_terms(df.filter("tf > 5"), 3, 1).count() == 0
    with pytest.raises(ValueError):
        H.top_terms(df, 0)


def test_broadcast_limit_leads_to_one_aggregate(spark, table):
    rows, df = table
    spark.conf.set("quarry.broadcast.maxBytes", "1")
    try:
        assert sorted(map(tuple, H.top_terms(df, 20, 400).collect())) == _brute(rows, 20)
    finally:
        spark.conf.unset("quarry.broadcast.maxBytes")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=40), max_size=6),
       st.integers(1, 12))
def test_summary_arithmetic(batches, capacity):
    keys = counts = np.empty(0, np.int64)
    short, true = 0, Counter()
    for b in batches:
        for key, n in b:
            true[key] += n
        arr = np.array(b, np.int64).reshape(-1, 2)
        keys, counts, off = H._added(keys, counts, [(arr[:, 0], arr[:, 1])], capacity)
        short += off
        assert len(keys) <= capacity and (counts > 0).all()
    got = dict(zip(keys.tolist(), counts.tolist()))
    assert all(got.get(t, 0) <= n <= got.get(t, 0) + short for t, n in true.items())
