"""Queries over documents without tokens: empty, blank and null texts."""

import duckdb
import pytest

import __spark_entry__ as E

TEXTS = ["a b c", "", "   ", "one", "　 \t", "A  B\tC", None]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("blank"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(
        1).write.parquet(f"{path}/documents.parquet")
    return path


def _as_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    rel, df = con.sql(E.oracle_sql()[name]), E.queries()[name](spark, folder)
    assert df.columns == rel.columns
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(rel.fetchall())
    return got


def test_word_ngrams_of_blank_texts(spark, folder):
    got = _as_sql(spark, folder, "i1_word_ngrams")
    assert got[1:4] == [(1, 0, None, None), (2, 0, None, None), (3, 1, None, "one")]


def test_whitespace_tokens_of_blank_texts(spark, folder):
    got = _as_sql(spark, folder, "t1_whitespace_tokens")
    assert got[1:4] == [(1, 0, None, None), (2, 0, None, None), (3, 1, "one", "one")]
