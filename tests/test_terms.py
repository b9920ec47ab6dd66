"""Term counts a batch of rows at a time equal a plain count."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from quarry.operators import index as I


def _plain(tokens, grams):
    if not tokens:
        return {}
    return dict(Counter(" ".join(tokens[i:i + n]) for n in range(1, grams + 1) for i in range(len(tokens) - n + 1)))


@pytest.mark.parametrize("grams", [1, 2, 3])
@pytest.mark.parametrize("words", [["a", "b", "é", "가나"], ["a", "a b", "b", "b a"]])
def test_counts_equal_a_plain_count(grams, words, monkeypatch):
    monkeypatch.setattr(I, "TERM_SLICE", 50)
    rng = random.Random(grams)
    rows = [[rng.choice(words) for _ in range(rng.randrange(0, 40))] for _ in range(60)] + [[], None, ["x"], ["a"] * 200]
    lists = pa.array(rows, pa.list_(pa.string()))
    for part, want in ((lists, rows), (lists.slice(7, 20), rows[7:27]), (lists.slice(0, 0), [])):
        got = I._count_terms(grams)(part).to_pylist()
        assert [len(g) for g in got] == [len(_plain(r, grams)) for r in want]
        assert [{p["term"]: p["tf"] for p in g} for g in got] == [_plain(r, grams) for r in want]


def test_counting_is_no_interpreted_lambda(spark):
    df = spark.createDataFrame([(["a", "b", "a"],)], "toks array<string>")
    plan = I.with_term_counts(df, "toks", grams=2)._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan.lower()
