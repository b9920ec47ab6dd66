"""Closed-form windows against the sliding loop of the spec."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import chunk as C


def py_windows(tokens, W, S):
    if len(tokens) < W:
        return [tokens]
    out, idx = [], 0
    while idx + W < len(tokens):
        out.append(tokens[idx:idx + W])
        idx += W - S
    out.append(tokens[idx:])
    return out


@pytest.mark.parametrize("W,S", [(5, 2), (4, 1), (3, 0)])
def test_windows_match_loop(spark, W, S):
    lens = [0, 1, W - 1, W, W + 1, 2 * W, 3 * W + 2, 17]
    rows = [(i, [f"t{j}" for j in range(n)]) for i, n in enumerate(lens)]
    df = spark.createDataFrame(rows, "id int, toks array<string>")
    got = {r.id: [list(w) for w in r.w] for r in df.select(
        "id", C.token_windows(F.col("toks"), W, S).alias("w")).collect()}
    for i, toks in rows:
        assert got[i] == py_windows(toks, W, S)


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        C.token_windows(F.col("x"), 3, 3)


def test_windows_rejoin_to_tokens(spark):
    toks = [f"w{j}" for j in range(23)]
    W, S = 6, 2
    df = spark.createDataFrame([(toks,)], "toks array<string>")
    wins = [list(w) for w in df.select(C.token_windows(F.col("toks"), W, S).alias("w")).first().w]
    rebuilt = wins[0] + [t for w in wins[1:] for t in w[S:]]
    assert rebuilt == toks


@pytest.mark.parametrize("n_ranges", [1, 3, 16])
def test_dense_passage_ids(spark, n_ranges):
    rows = [(d, f"t{d}", [f"x{j}" for j in range((d * 7) % 23)]) for d in range(0, 120, 3)]
    df = spark.createDataFrame(rows, "document_id long, title string, toks array<string>")
    p = C.numbered_passages(df, "toks", 5, 2, n_ranges=n_ranges).collect()
    got = sorted((r.document_id, r.window_index, r.passage_id) for r in p)
    assert [g[2] for g in got] == list(range(len(got)))


@pytest.mark.parametrize("kind", ["long", "string", "date"])
def test_row_numbers_of_any_key(spark, kind):
    import random
    rng = random.Random(13)
    df = spark.createDataFrame([(i,) for i in rng.sample(range(10 ** 6), 300)], "x long").select(
        F.expr({"long": "x - 500000", "string": "concat('d', x % 7, '-', x)", "date": "date_add(date'1970-01-01', cast(x as int))"}[kind])
        .alias("k")).repartition(7)
    expected = {k: i for i, k in enumerate(sorted(r.k for r in df.collect()))}
    for n_ranges in (1, 3, 40):
        got = {r.k: r.row_index for r in C.number_rows(df, "k", n_ranges=n_ranges).collect()}
        assert got == expected


def test_passage_ids_of_string_documents(spark):
    rows = [(f"doc-{d % 13}-{d}", f"t{d}", " ".join(f"x{j}" for j in range((d * 7) % 23))) for d in range(200)]
    df = spark.createDataFrame(rows, "document_id string, title string, text string")
    p = C.numbered_passages(df, F.filter(F.split("text", " "), lambda t: t != ""), 5, 2, n_ranges=9).collect()
    got = sorted((r.document_id, r.window_index, r.passage_id) for r in p)
    assert [g[2] for g in got] == list(range(len(got))) and len({g[0] for g in got}) == 200


def test_batch_padding_of_string_keys(spark):
    from quarry.operators import features as FT
    df = spark.createDataFrame([(f"k{(i * 37) % 101:03d}", [1] * ((i * 5) % 9)) for i in range(101)], "k string, input_ids array<int>")
    out = sorted((r.k, r.row_index, r.batch_id, len(r.input_ids)) for r in FT.batch_pad(df, "k", 8, n_ranges=6).collect())
    sizes = {r.k: len(r.input_ids) for r in df.collect()}
    order = sorted(sizes)
    longest = [max(sizes[k] for k in order[b:b + 8]) for b in range(0, 101, 8)]
    assert out == [(k, i, i // 8, longest[i // 8]) for i, k in enumerate(order)]


def test_texts_are_exchanged_once(spark):
    """Of the exchanges of the stored passages' plan only one, by ranges, holds texts."""
    df = spark.range(50).select(F.col("id").alias("document_id"), F.lit("t").alias("title"), F.lit("a b c").alias("text"))
    made = C._sorted_by(df, "document_id", 4).select("document_id", F.posexplode_outer(
        C.token_windows(F.split("text", " "), 2, 1)).alias("i", "w"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
