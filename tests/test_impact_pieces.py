"""Blocks of documents are stored, read and scored a bounded piece at a time."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from quarry.operators import impacts as M
from quarry.operators import scan
from quarry.session import BATCH_KEY, materialize


def _batch(docs):
    """``docs``: (block, {term: tf}) in order of blocks."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
    return pa.record_batch([
        pa.array([f"k{i}" for i in range(len(docs))]), pa.array(range(len(docs)), pa.int64()),
        pa.array([sum(d.values()) for _, d in docs], pa.int32()),
        M._packed(pa.array([[{"term": t, "tf": n} for t, n in d.items()] for _, d in docs], kind)),
        pa.array([b for b, _ in docs], pa.int64())], names=["dkey", "document_id", "dl", "tc", "block"])


def _values(batch):
    dl = batch.column("dl").to_numpy()
    return lambda tf, row: tf / dl[row]


def _docs():
    rng = random.Random(9)
    return [(i // 4, {f"t{j}": rng.randrange(1, 4) for j in rng.sample(range(40), rng.randrange(1, 12))}) for i in range(90)]


def test_pieces_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(M, "PIECE", 60)
    docs = _docs()
    rows = list(M._with_bounds(_values)([_batch(docs[:50]).slice(2), _batch(docs[:0]), _batch(docs[50:])]))
    pieces = list(M._stored(rows))
    assert len(pieces) == len(rows) > 5
    for row, piece in zip(rows, pieces):
        assert row.num_rows == 1 and row.column("block")[0] == piece.column("block")[0]
        sizes = [sum(len(d["tc"]) for d in b) for b in piece.column("docs").to_pylist()]
        assert sum(sizes) <= 60 or len(sizes) == 1
    got = [(r["block"], {p["term"]: p["tf"] for p in d["tc"]}) for piece in pieces for r in piece.to_pylist() for d in r["docs"]]
    assert got == docs[2:]
    for piece in pieces:
        for r in piece.to_pylist():
            tops = {}
            for d in r["docs"]:
                for p in d["tc"]:
                    tops[p["term"]] = max(tops.get(p["term"], 0), p["tf"] / d["dl"])
            assert len(r["tops"]) == len(tops)
            assert all(tops[p["term"]] <= p["top"] <= tops[p["term"]] * (1 + 2e-7) for p in r["tops"])
        most = M._most_rows(piece).to_pydict()
        bounds = M._bound_rows(piece).to_pylist()
        assert dict(zip(most["term"], most["most"])) == {t: max(x["top"] for x in bounds if x["term"] == t) for t in {x["term"] for x in bounds}}


def test_a_block_larger_than_a_piece_is_stored_alone(monkeypatch):
    monkeypatch.setattr(M, "PIECE", 1)
    docs = _docs()
    pieces = list(M._stored(M._with_bounds(_values)([_batch(docs)])))
    assert [p.num_rows for p in pieces] == [1] * len({b for b, _ in docs})


def test_products_of_numbered_terms():
    lists = M._unpacked(_batch(_docs()).column("tc"))
    flat = lists.flatten()
    coded = pa.ListArray.from_arrays(lists.offsets, pa.StructArray.from_arrays([flat.field(0).dictionary_encode(), flat.field(1)], ["term", "tf"]))
    side = scan.by_term(pa.table({"q": [0, 0, 1, 2], "term": ["t1", "none", "t1", "t5"], "w": [1.0, 2.0, 3.0, 4.0]}), "q", "w")
    for a, b in zip(scan.products(lists.slice(7), lambda x, row: x, side), scan.products(coded.slice(7), lambda x, row: x, side), strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_stored_rows_of_a_row_group(spark):
    df = materialize(spark.range(40).coalesce(1), "groups", **{"parquet.block.row.count.limit": 16})
    groups = pq.ParquetFile(df.inputFiles()[0].removeprefix("file:")).metadata
    assert [groups.row_group(i).num_rows for i in range(groups.num_row_groups)] == [16, 16, 8]


def test_python_gets_batches_of_bounded_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], names=["n"])
    was = spark.conf.get(BATCH_KEY, None)
    df = spark.range(60).coalesce(1).selectExpr("repeat('x', 100000) AS t").mapInArrow(sizes, "n long")
    assert max(r.n for r in materialize(df, "bytes", 1 << 20).collect()) < 1.5 * (1 << 20)
    assert materialize(df, "bytes").count() == 1 and spark.conf.get(BATCH_KEY, None) == was


def test_packed_terms_come_back():
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
    docs = [[("a", 1), ("\x00é\U0001F600", 3)], [("", 2)], [("long" * 99, 70_000), ("b\u3000c", 1)]]
    lists = pa.array([[{"term": t, "tf": n} for t, n in d] for d in docs], kind)
    assert M._unpacked(M._packed(lists)).to_pylist() == lists.to_pylist()
    assert M._unpacked(M._packed(lists.slice(1, 2))).to_pylist() == lists.slice(1, 2).to_pylist()
    assert M._unpacked(M._packed(lists.slice(0, 0))).to_pylist() == []
