"""Small tables with every awkward case, and the session of the other tests."""

import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          # names that operators use inside
          "tag long, kept boolean, h long, pos int, shard int, ids binary, fp long, level int, kind int")


def make_docs(spark, rows):
    """rows: (doc_id, text); the other columns clash on purpose."""
    return spark.createDataFrame(
        [(d, t, "en" if i % 2 else None, "s", 1, 5, False, 3, 2, 1, bytearray(b"x"), 9, 4, 0)
         for i, (d, t) in enumerate(rows)], SCHEMA)


def words(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def edge_rows(seed=0):
    """Nulls, empty and blank texts, repeated rows, an id with two texts,
    copies that differ in case, near copies, shared passages, a long text."""
    rng = random.Random(seed)
    passage = words(rng, 40, 400)
    long_text = words(rng, 4000, 400)
    base = words(rng, 60, 300)
    rows = [(1, None), (2, ""), (3, "   \t\n"), (4, "!!! ???"), (5, "One two"), (6, "ONE two"),
            (7, "Émile été ÉTÉ"), (8, "Émile été été"), (9, "émile été été"),
            (10, passage), (11, "before " + passage + " after"), (12, long_text), (13, long_text + " " + passage),
            (14, base), (15, base.replace("x", "X", 3)), (16, base + " end"), (17, "a\x00b a\x00b\x00"),
            (18, "w " * 300), (19, "w " * 280), (20, "日本語 テキスト " * 30), (21, "日本語 テキスト " * 31)]
    rows += [(100 + i, base if i % 3 else passage.upper()) for i in range(12)]
    rows += [(200 + i, words(rng, rng.randrange(0, 80), 6)) for i in range(30)]
    rows += [(14, base), (14, base), (5, "another text under a known id"), (None, base), (None, None), (None, "alone 1 2 3")]
    return rows


@pytest.fixture(scope="session")
def llm_spark(spark):
    from quarry.session import ship_package
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def edge(llm_spark):
    rows = edge_rows()
    return rows, make_docs(llm_spark, rows)


@pytest.fixture(scope="session")
def nothing(llm_spark):
    return make_docs(llm_spark, [])
