"""S1, S4, S6, S7 round trips."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.sources import io


def test_corpus_object_and_predictions(spark, tmp_path):
    corpus = {"0": {"title": "T0", "text": "hello\nworld", "document_id": 7},
              "1": {"title": "T1", "text": "x", "document_id": 8}}
    p = tmp_path / "wiki.json"
    p.write_text(json.dumps(corpus, ensure_ascii=False))
    rows = sorted((r.document_id, r.title, r.text) for r in io.read_corpus_object(spark, str(p)).collect())
    assert rows == [(7, "T0", "hello\nworld"), (8, "T1", "x")]
    pp = tmp_path / "pred.json"
    pp.write_text(json.dumps({"a": "ans", "b": ""}))
    assert sorted(tuple(r) for r in io.read_prediction_object(spark, str(pp)).collect()) == [("a", "ans"), ("b", "")]
    gt = tmp_path / "gt.json"
    gt.write_text(json.dumps([{"id": "a", "answers": {"text": ["ans", "x"]}}]))
    assert [list(r.answers) for r in io.read_ground_truth(spark, str(gt)).collect()] == [["ans", "x"]]


def test_csv_keeps_newlines_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"\nnext line', "a,b")], "id int, context string, q string")
    path = str(tmp_path / "r.csv")
    io.write_csv(df, path)
    back = io.read_csv(spark, path, schema=df.schema).collect()
    assert [tuple(r) for r in back] == [(1, 'say "hi"\nnext line', "a,b")]


def test_load_or_build_reuses(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return {"t": spark.range(5).withColumn("x", F.col("id") * 2)}
    a = io.load_or_build(spark, "demo", "fp1", build, ("t",), root=str(tmp_path))
    b = io.load_or_build(spark, "demo", "fp1", build, ("t",), root=str(tmp_path))
    assert len(calls) == 1 and a["t"].count() == b["t"].count() == 5


def test_metrics_table(spark):
    m = spark.createDataFrame([(0.5, 0.25)], "em double, f1 double")
    assert sorted(tuple(r) for r in io.metrics_table(m).collect()) == [("eval_em", 0.5), ("eval_f1", 0.25)]


CORPUS = [(1, "a", "red fox jumps #1 ábc"), (2, "b", "lazy dog sleeps"), (3, "c", "red dog runs dog")]
CORPUS += [(10 + i, "t", f"word{i % 7} red text number {i}") for i in range(60)]
SCHEMA = "document_id long, title string, text string"


@pytest.fixture
def stored(spark, tmp_path):
    """A corpus in files, a question, and a forgetful catalog."""
    path = str(tmp_path / "c.parquet")
    spark.createDataFrame(CORPUS, SCHEMA).write.parquet(path)
    q = spark.createDataFrame([(1, "red dog"), (2, "word3 text")], "qid long, question string")

    def forget():
        for t in spark.catalog.listTables():
            if t.name.startswith("quarry_"):
                spark.sql(f"DROP TABLE {t.name}")
    forget()
    return spark.read.parquet(path), q, str(tmp_path / "ix"), forget


def top(idx, q, k=50):
    from quarry.operators import retrieve as R
    from quarry.operators.index import Bm25Index
    f = R.bm25_topk if isinstance(idx, Bm25Index) else R.tfidf_topk
    return sorted(map(tuple, f(idx, q, k=k).collect()))


@pytest.mark.parametrize("method", ["bm25", "tfidf"])
def test_reopened_with_fewer_buckets_keeps_all_documents(spark, stored, method):
    src, q, root, forget = stored
    open_ = {"bm25": lambda **kw: io.bm25_persistent(spark, src, root, **kw)[0],
             "tfidf": lambda **kw: io.tfidf_persistent(spark, src, root, **kw)}[method]
    first = top(open_(buckets=7), q)
    forget()  # a new session has the files only
    again = open_(buckets=3)
    table = again.postings if method == "bm25" else again.weights
    assert table.select("dkey").distinct().count() == table.groupBy("dkey").count().count() == len(CORPUS)
    assert top(again, q) == first and len(first) > 50


def test_other_parameters_get_another_index(spark, stored):
    src, q, root, _ = stored
    base, _ = io.bm25_persistent(spark, src, root)
    other, docs = io.bm25_persistent(spark, src, root, preparation={"no_other_languages": True})
    assert base.terms.filter("term = 'ábc'").count() == 1 and other.terms.filter("term = 'ábc'").count() == 0
    assert docs.count() == len(CORPUS)
    tuned, _ = io.bm25_persistent(spark, src, root, k1=0.9, b=0.1)
    assert (tuned.k1, tuned.b) == (0.9, 0.1) and top(tuned, q) != top(base, q)
    again, _ = io.bm25_persistent(spark, src, root, k1=0.9, b=0.1)
    assert (again.k1, again.b) == (0.9, 0.1) and top(again, q) == top(tuned, q)


def test_own_tokenizer_is_named_and_kept(spark, stored):
    src, q, root, _ = stored
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x.rlike("[a-z]"))
    with pytest.raises(ValueError, match="tokenizer_name"):
        io.bm25_persistent(spark, src, root, tokenizer=chars)
    for _ in range(2):
        idx, _ = io.bm25_persistent(spark, src, root, tokenizer=chars, tokenizer_name="letters")
        assert idx.tokenizer is chars and idx.terms.filter("length(term) > 1").count() == 0
        assert len(top(idx, q)) > 50


def test_other_corpora_and_roots(spark, stored, tmp_path):
    src, q, root, _ = stored
    memory = spark.createDataFrame([(1, "t", "only here")], SCHEMA)
    with pytest.raises(ValueError, match="version"):
        io.bm25_persistent(spark, memory, root)
    a, _ = io.bm25_persistent(spark, memory, root, version="1")
    b, _ = io.bm25_persistent(spark, spark.createDataFrame([(1, "t", "and there")], SCHEMA), root, version="2")
    assert a.terms.filter("term = 'here'").count() == 1 and b.terms.filter("term = 'there'").count() == 1
    c, _ = io.bm25_persistent(spark, src, root)
    d, _ = io.bm25_persistent(spark, src, str(tmp_path / "elsewhere"))
    assert top(c, q) == top(d, q)
    assert c.postings.inputFiles() and not set(c.postings.inputFiles()) & set(d.postings.inputFiles())


def test_ivf_index_follows_its_centroids(spark, tmp_path):
    path = str(tmp_path / "v.parquet")
    spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "pid long, vec array<double>").write.parquet(path)
    p = spark.read.parquet(path)
    root = str(tmp_path / "ix")
    counts = []
    for cut in (2.0, 8.0):
        cents = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2 * cut, 0.0])], "cluster_id int, centroid array<double>")
        vectors, back = io.ivf_persistent(spark, p, cents, root)
        assert back.count() == 2
        counts.append(vectors.filter("cluster_id = 0").count())
    assert counts == [3, 9]


def test_write_predictions_three_outputs(spark, tmp_path):
    from quarry.operators import decode as N
    ex = spark.createDataFrame([(1, "alpha beta")], "id long, context string")
    ft = spark.createDataFrame([(1, 0, 0, [None, {"s": 0, "e": 5}, {"s": 6, "e": 10}], [0.0, 2.0, 1.0],
                                 [0.0, 1.0, 3.0])],
                               "example_id long, window_index int, context_index int, "
                               "offsets array<struct<s:int,e:int>>, start_logits array<double>, "
                               "end_logits array<double>")
    dec = N.nbest(ft, ex, n_best=3, version_2_with_negative=True)
    paths = io.write_predictions(dec, str(tmp_path), prefix="x", version_2_with_negative=True)
    assert set(paths) == {"predictions", "nbest_predictions", "null_odds"}
    assert paths["predictions"].endswith("predictions_x.json")
    p = spark.read.json(paths["predictions"]).first()
    assert p.prediction_text == "alpha beta"
    assert spark.read.json(paths["null_odds"]).first().score_diff is not None
    assert len(spark.read.json(paths["nbest_predictions"]).first().nbest) >= 2


def test_split_scan_prunes_partitions(spark, tmp_path):
    import contextlib
    import io as _io
    df = spark.createDataFrame([(1, "train"), (2, "validation"), (3, "validation")], "id long, split string")
    path = str(tmp_path / "qa")
    io.write_qa(df, path)
    v = io.read_qa_split(spark, path, "validation")
    buf = _io.StringIO()
    with contextlib.redirect_stdout(buf):
        v.explain()
    assert "PartitionFilters: [isnotnull(split" in buf.getvalue()
    assert sorted(r.id for r in v.collect()) == [2, 3]


def test_large_lists_are_split(spark, tmp_path):
    """A cluster of half the vectors is written as several sub-lists, and
    searches over the stored lists give the uncoded result."""
    import numpy as np
    from pyspark.sql import functions as F
    from quarry.operators import retrieve as R
    from quarry.sources import io
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(120, 4)), rng.normal(size=(120, 4)) * 0.1 + 9])
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pid long, vec array<double>")
    q = spark.createDataFrame([(i, (v + 0.01).tolist()) for i, v in enumerate(x[::30])], "qid long, vec array<double>")
    cents = spark.createDataFrame([(0, [9.0] * 4), (1, [1.0] * 4), (2, [-1.0] * 4)], "cluster_id int, centroid array<double>")
    vectors, c = io.ivf_persistent(spark, p, cents, root=str(tmp_path), version="1", rows_per_file=25)
    files = io.IndexHome(spark, "ivf", {"source": "version:1", "centroids": io._table_hash(cents, "cluster_id", "centroid"),
                                        "rows_per_file": 25}, str(tmp_path)).read("vectors_files")
    sizes = {r.cluster_id: r.n for r in files.groupBy("cluster_id").agg(F.count("*").alias("n")).collect()}
    assert sizes[0] >= 4 and files.agg(F.sum("n_rows")).first()[0] == 240
    expected = sorted(map(tuple, R.ivf_topk(R.ivf_assign(p, cents), q, cents, k=7, nprobe=2).collect()))
    assert sorted(map(tuple, R.ivf_topk(vectors, q, c, k=7, nprobe=2).collect())) == expected
    coded = io.coded_persistent(spark, p, cents, root=str(tmp_path), version="1", rows_per_file=25)
    again = io.coded_persistent(spark, p, cents, root=str(tmp_path), version="1", rows_per_file=25)
    assert (coded.low == again.low).all()
    got = R.retrieve(None, method="faiss", k=7, query_vectors=q, nprobe=2, index=again)
    assert sorted((r.qid, r.rank, r.pid) for r in got.collect()) == [(a, b, c) for a, b, c, *_ in expected]


def test_retrieve_takes_built_indexes(spark):
    from quarry.operators import impacts as M, index as I, retrieve as R
    rows = [(i, "t", f"w{i % 7} w{i % 5} x{i}") for i in range(60)]
    docs = I.prepare_corpus(spark.createDataFrame(rows, "document_id long, title string, text string"))
    qs = spark.createDataFrame([(1, "w1 w2"), (2, "x9 w4")], "qid long, question string")
    bm25 = I.build_bm25(docs)
    rank = lambda df: sorted((r.qid, r.rank, r.document_id) for r in df.collect())
    plain = rank(R.retrieve(qs, docs, "bm25", 5))
    assert rank(R.retrieve(qs, method="bm25", k=5, index=bm25)) == plain
    assert rank(R.retrieve(qs, method="bm25", k=5, index=M.build(bm25, 4))) == plain
    exact = rank(R.retrieve(qs, docs, "tfidf", 5))
    assert rank(R.retrieve(qs, docs, "faiss", 5, nprobe=4, num_clusters=4, iterations=1)) == exact
