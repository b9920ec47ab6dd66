"""The pipeline against the stages' brute-force models, on awkward tables."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline
from quarry.llm.queries import word_tokenizer
from tests.llm.conftest import SCHEMA, edge_rows, make_docs
from tests.llm.test_dedup import exact_model, fingerprint_model, group_model, low
from tests.llm.test_operators import benchmark_items, check_packed, contamination_model

LAST = (1 << 63) - 1


def kept_model(rows, items):
    """(doc_id, text) after each stage but the last."""
    steps = [[r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]]
    # exact: of equal texts the largest id; whose spelling of it stays is the kept row's own
    groups = defaultdict(list)
    for d, t in steps[-1]:
        groups[low(t)].append((d, t))
    steps.append([max(g, key=lambda r: (r[0] is not None, r[0] or 0)) for g in groups.values()])
    prints = [fingerprint_model(t) for _, t in steps[-1]]
    near = defaultdict(list)
    for r, g in zip(steps[-1], group_model(prints, 2)):
        near[g].append(r)
    steps.append([min(g, key=lambda r: LAST if r[0] is None else r[0]) for g in near.values()])
    dirty = contamination_model(steps[-1], items, 10)
    steps.append([r for r, c in zip(steps[-1], dirty) if not c[4]])
    return steps


@pytest.fixture(scope="module")
def folder(llm_spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    rows = edge_rows(5)
    make_docs(llm_spark, rows).repartition(3).write.parquet(f"{root}/documents.parquet")
    items = benchmark_items(rows)[:2] + [(50, "one TWO"), (52, None)]
    llm_spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows, items


def test_each_stage_keeps_what_its_model_keeps(llm_spark, folder):
    root, rows, items = folder
    docs = llm_spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    # equal ids, texts that differ in case only: either spelling may stay
    spelled = lambda rs: sorted((repr(d), low(t)) for d, t in rs)
    for (name, stage), want in zip(corpus_pipeline.STAGES, kept_model(rows, items)):
        out = stage(llm_spark, docs, root)
        assert out.columns == columns, name
        out.write.parquet(f"{root}/{name}")
        docs = llm_spark.read.parquet(f"{root}/{name}")
        assert spelled((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()) == spelled(want), name


def test_run_packs_what_is_left(llm_spark, folder):
    from tokenizers import Tokenizer
    root, rows, items = folder
    pieces = corpus_pipeline.run(llm_spark, root).collect()
    left = kept_model(rows, items)[-1]
    check_packed(left, pieces, Tokenizer.from_file(word_tokenizer()), 2048)
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_take_empty_tables(llm_spark, tmp_path):
    root = str(tmp_path)
    docs = llm_spark.createDataFrame([], SCHEMA)
    llm_spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(llm_spark, docs, root)
        assert out.collect() == [], name


def test_exact_model_is_used():
    assert exact_model([(1, "A"), (2, "a")])
