"""8-bit codes: bounds, size and equality with the uncoded search; tiles of the dense scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import quantize as Z
from quarry.operators import retrieve as R


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8)).astype(np.float32) * np.array([1, 5, .1, 1, 1, 0, 2, 1], np.float32)
    x[:, 7] = 3.0                       # a constant dimension
    x[100:140] = x[100]                 # many equal vectors
    p = spark.createDataFrame([(i, i // 5, v.tolist()) for i, v in enumerate(x)], "pid long, document_id long, vec array<float>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[::25] + np.float32(0.01))], "qid long, vec array<float>")
    cents = spark.createDataFrame([(i, x[i * 50].astype(float).tolist()) for i in range(6)], "cluster_id int, centroid array<double>")
    return x, p.repartition(5), q, cents


def test_codes_bound_the_loss(vectors):
    x, p, _, _ = vectors
    low, step = Z.dimension_ranges(p)
    assert low == pytest.approx(x.min(axis=0), rel=1e-6)
    for r in Z.encode(p.select("pid", "vec"), low, step).collect():
        code = np.frombuffer(bytes(r.code), np.uint8)
        assert len(code) == 8                     # 32-bit floats take four times as much
        near = low + code * step
        assert r.lost == pytest.approx(np.linalg.norm(x[r.pid].astype(float) - near), abs=1e-9)
        assert (np.abs(x[r.pid] - near) <= step / 2 + 1e-6).all()


@pytest.mark.parametrize("k,nprobe", [(1, 1), (10, 2), (45, 6), (600, 6)])
def test_coded_search_equals_uncoded(vectors, k, nprobe):
    _, p, q, cents = vectors
    lists = R.ivf_assign(p.select("pid", "vec"), cents)
    expected = R.ivf_topk(lists, q, cents, k=k, nprobe=nprobe).select("qid", "rank", "pid", "score").collect()
    got = Z.coded_topk(Z.build(lists, cents), q, k=k, nprobe=nprobe).collect()
    assert sorted((r.qid, r.rank, r.pid, round(r.score, 5)) for r in got) == sorted(
        (r.qid, r.rank, r.pid, round(r.score, 5)) for r in expected)


def test_candidates_are_few(vectors):
    _, p, q, cents = vectors
    index = Z.build(R.ivf_assign(p.select("pid", "vec"), cents), cents)
    assert Z.candidates(index, q, 3, 6).count() < 0.3 * 500 * q.count()


def test_many_questions_go_in_parts(spark, vectors):
    _, p, q, cents = vectors
    index = Z.build(R.ivf_assign(p.select("pid", "vec"), cents), cents)
    whole = sorted(map(tuple, Z.coded_topk(index, q, 5, 2).collect()))
    old = spark.conf.get("quarry.broadcast.maxBytes", None)
    spark.conf.set("quarry.broadcast.maxBytes", "1500")
    try:
        assert sorted(map(tuple, Z.coded_topk(index, q, 5, 2).collect())) == whole
    finally:
        spark.conf.unset("quarry.broadcast.maxBytes") if old is None else spark.conf.set("quarry.broadcast.maxBytes", old)


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("tile", [8, 400, 1 << 20])
def test_scan_in_tiles_equals_sorting(monkeypatch, metric, grouped, tile):
    monkeypatch.setattr(R, "TILE_BYTES", tile)
    rng = np.random.default_rng(5)
    P, Q = rng.normal(size=(60, 3)).round(1), rng.normal(size=(9, 3)).round(1)
    P *= rng.choice([0.1, 1, 10], size=(60, 1))
    pid, doc = rng.permutation(60), np.arange(60) // 4
    top = R._Running(9, 5, grouped)
    for part in np.array_split(np.arange(60), 4):
        R._scan(top, np.arange(9), P[part], pid[part], doc[part], Q, metric, 4)
    for i in range(9):
        s = P @ Q[i] if metric == "ip" else ((P - Q[i]) ** 2).sum(axis=1)
        rows = sorted(zip(np.round(-s if metric == "ip" else s, 6), doc, pid))
        if grouped:
            seen, best = set(), []
            for r in rows:
                if r[1] not in seen:
                    seen.add(r[1])
                    best.append(r)
            rows = best
        key, d, p = top.rows[i]
        assert list(zip(key.round(5), d, p)) == [(pytest.approx(round(a, 5), abs=2e-5), b, c) for a, b, c in rows[:5]]


def test_candidates_are_few_whatever_the_files(spark):
    """Codes in many small files: a question's bounds still come from one task,
    so that about k candidates are left, and none are broadcast."""
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, rng.normal(size=8).tolist()) for i in range(400)]
    v = spark.createDataFrame(rows, "pid long, cluster_id int, vec array<float>").repartition(40)
    cents = v.groupBy("cluster_id").agg(F.array(*[F.avg(F.col("vec")[j].cast("double")) for j in range(8)]).alias("centroid"))
    queries = v.select(F.col("pid").alias("qid"), "vec")
    found = Z.candidates(Z.build(v, cents), queries, 5).count()
    assert 400 * 5 <= found < 400 * 9
