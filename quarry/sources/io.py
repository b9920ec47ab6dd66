"""Readers and writers.

Corpus and dataset formats of the reference are read with Spark's own
sources. Index tables are written once to the shared folder named by
``spark.checkpoint.dir`` under a fingerprint of the build parameters and the
input files, and read back on the next run (S4).
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, IntegerType, LongType, MapType, StringType,
                               StructField, StructType)
from pyspark.errors import AnalysisException

from quarry.session import shared_dir, stage_root

CORPUS_SCHEMA = StructType([
    StructField("title", StringType()), StructField("text", StringType()),
    StructField("document_id", LongType())])

ANSWERS_TYPE = StructType([StructField("text", ArrayType(StringType())),
                           StructField("answer_start", ArrayType(IntegerType()))])


# ---------------------------------------------------------------- S1 corpus

def read_corpus_object(spark: SparkSession, path: str) -> DataFrame:
    """A corpus stored as ONE JSON object ``{row_key: {title, text,
    document_id, ...}}``. A single object cannot be split, so each file is
    parsed by one task; convert once (:func:`write_corpus`) and read parquet
    from then on."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", MapType(StringType(), CORPUS_SCHEMA))
    return raw.select(F.explode_outer(m).alias("row_key", "r")).filter(F.col("r").isNotNull()).select(
        "row_key", "r.document_id", "r.title", "r.text")


def read_corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """S1, splittable form: one JSON document per line."""
    return spark.read.schema(CORPUS_SCHEMA).json(path).select("document_id", "title", "text")


def write_corpus(df: DataFrame, path: str) -> None:
    df.select("document_id", "title", "text").write.mode("overwrite").parquet(path)


# ---------------------------------------------------------------- S2 QA splits

def write_qa(df: DataFrame, path: str, split_col: str = "split") -> None:
    """S2 sink: QA rows partitioned by split, so a split scan prunes files."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def read_qa_split(spark: SparkSession, path: str, split: str,
                  split_col: str = "split") -> DataFrame:
    """One split of a QA dataset (partition pruning on ``split``)."""
    return spark.read.parquet(path).filter(F.col(split_col) == split).drop(split_col)


# ---------------------------------------------------------------- S3 passages

def write_passages(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ---------------------------------------------------------------- S4 index tables

def source_version(spark: SparkSession, df: DataFrame, version: str | None = None) -> str:
    """What identifies the content of ``df``: ``version`` if given, else the
    paths, sizes and times of its input files.

    The paths are listed on the driver, as Spark's own scan lists them; sizes
    and times are hashed on the executors. A frame without input files (made
    in memory) has no identity of its own and needs a ``version``.
    """
    if version is not None:
        return f"version:{version}"
    files = df.inputFiles()
    if not files:
        raise ValueError("a source without files needs an explicit version")
    h = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    r = (spark.read.format("binaryFile").load(files)
              .select("path", "length", "modificationTime")
              .agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h"),
                   F.sum("length").alias("bytes")).first())
    return f"files:{r['n']}:{r['h']}:{r['bytes']}"


def fingerprint(parameters: dict) -> str:
    blob = json.dumps(parameters, sort_keys=True)
    return hashlib.sha256(blob.encode()).hexdigest()[:20]


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).limit(0).collect()
        return True
    except AnalysisException:
        return False


def load_or_build(spark: SparkSession, name: str, fingerprint: str,
                  build: "callable", tables: tuple[str, ...],
                  root: str | None = None) -> dict[str, DataFrame]:
    """Read index tables ``root/name/fingerprint/<table>`` when the last
    table exists; otherwise build them (``build() -> dict[name, DataFrame]``),
    write each (the last one marks completion) and read them back."""
    base = os.path.join(root or os.path.join(shared_dir(spark), "indexes"), name, fingerprint)
    done = os.path.join(base, tables[-1])
    if not _exists(spark, done):
        built = build()
        for t in tables:
            built[t].write.mode("overwrite").parquet(os.path.join(base, t))
    return {t: spark.read.parquet(os.path.join(base, t)) for t in tables}


class IndexHome:
    """Where one stored index lives: ``root/method/fingerprint``.

    The fingerprint covers the source's content and every parameter of
    preparation and scoring. A manifest table, written last, marks the index
    complete and keeps what a later session must not guess: the number of
    buckets and the corpus scalars.
    """

    def __init__(self, spark: SparkSession, method: str, parameters: dict, root: str | None):
        self.spark = spark
        self.base = os.path.join(root or os.path.join(shared_dir(spark), "indexes"), method,
                                 fingerprint({**parameters, "method": method}))
        # one catalog name per place, so that equal indexes under two roots differ
        self.name = f"quarry_{method}_{hashlib.sha256(self.base.encode()).hexdigest()[:20]}"

    def path(self, table: str) -> str:
        return os.path.join(self.base, table)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def write(self, table: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table))
        return self.read(table)

    def manifest(self) -> dict | None:
        if not _exists(self.spark, self.path("manifest")):
            return None
        return json.loads(self.read("manifest").first()["value"])

    def finish(self, **values) -> dict:
        self.spark.createDataFrame([(json.dumps(values),)], "value string") \
            .write.mode("overwrite").parquet(self.path("manifest"))
        return values

    def write_bucketed(self, table: str, df: DataFrame, key: str, buckets: int) -> None:
        """One file per bucket, hashed and sorted by ``key``."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")
        (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
           .option("path", self.path(table)).saveAsTable(f"{self.name}_{table}"))

    def read_bucketed(self, table: str, key: str, buckets: int) -> DataFrame:
        """The table with its bucketing known to the planner, so scans report
        hash partitioning by ``key``; registered again in a new session."""
        name = f"{self.name}_{table}"
        if not self.spark.catalog.tableExists(name):
            schema = self.read(table).schema
            cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            self.spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet CLUSTERED BY ({key}) "
                           f"SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{self.path(table)}'")
        return self.spark.table(name)


def _tokenizer_name(tokenizer, name: str | None) -> str:
    from quarry.operators.index import default_tokenizer
    if tokenizer is default_tokenizer:
        return "whitespace"
    if not name:
        raise ValueError("a tokenizer of your own needs a tokenizer_name, which identifies it")
    return f"own:{name}"


def _prepared(home: IndexHome, source: DataFrame, preparation: dict) -> DataFrame:
    """The prepared documents, written once; everything else reads them."""
    from quarry.operators import index as I
    return home.write("docs", I.prepare_corpus(source, **preparation).select(
        "dkey", "document_id", "title", "ptext"))


ROW_A_DOCUMENT = "a row a document"   # of stored postings; part of the fingerprint
NUMBERED = "a row a document, numbered terms"   # of stored TF-IDF counts


def bm25_persistent(spark: SparkSession, source: DataFrame, root: str | None = None,
                    preparation: dict | None = None, k1: float = 1.5, b: float = 0.75,
                    epsilon: float = 0.25, tokenizer=None, tokenizer_name: str | None = None,
                    buckets: int | None = None, version: str | None = None):
    """S4 for BM25: ``(index, prepared documents)`` over the corpus ``source``
    (``document_id, title, text``), reused while the source's content and all
    parameters are the same.

    ``preparation`` holds the keyword arguments of ``prepare_corpus``. The
    corpus is read once per build: documents, their terms (a row a document,
    bucketed by its key), term statistics.
    ``buckets`` counts for a new build only; a stored index keeps its own.
    """
    from quarry.operators import index as I
    tokenizer = tokenizer or I.default_tokenizer
    preparation = preparation or {}
    home = IndexHome(spark, "bm25", {
        "source": source_version(spark, source, version), "preparation": preparation, "k1": k1, "b": b,
        "epsilon": epsilon, "tokenizer": _tokenizer_name(tokenizer, tokenizer_name), "layout": ROW_A_DOCUMENT}, root)
    kept = home.manifest()
    if kept is None:
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        docs = _prepared(home, source, preparation)
        home.write_bucketed("terms_by_document", I.bm25_documents(docs, tokenizer), "dkey", n)
        idx = I.bm25_from_documents(home.read_bucketed("terms_by_document", "dkey", n), tokenizer, k1, b, epsilon)
        home.write("terms", idx.terms)
        kept = home.finish(buckets=n, n_docs=idx.n_docs, avgdl=float(idx.avgdl))
    rows = home.read_bucketed("terms_by_document", "dkey", kept["buckets"])
    return (I.Bm25Index(I.term_rows(rows, "dl"), home.read("terms"), kept["n_docs"], kept["avgdl"], k1, b, tokenizer, rows),
            home.read("docs"))


def tfidf_persistent(spark: SparkSession, source: DataFrame, root: str | None = None,
                     preparation: dict | None = None, ngram_max: int = 2, max_features: int = 50000,
                     tokenizer=None, tokenizer_name: str | None = None,
                     buckets: int | None = None, version: str | None = None):
    """S4 for TF-IDF: term numbers with counts and the norm (a row a document, bucketed
    by its key), the vocabulary with idf, and N; reused as :func:`bm25_persistent`.
    A vocabulary too large for numbers is stored with the normalised weights."""
    from quarry.operators import index as I
    tokenizer = tokenizer or I.default_tokenizer
    preparation = preparation or {}
    home = IndexHome(spark, "tfidf", {
        "source": source_version(spark, source, version), "preparation": preparation,
        "ngram_max": ngram_max, "max_features": max_features,
        "tokenizer": _tokenizer_name(tokenizer, tokenizer_name), "layout": NUMBERED}, root)
    kept = home.manifest()
    if kept is None:
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        idx = I.build_tfidf(_prepared(home, source, preparation), tokenizer, ngram_max, max_features, stored=True)
        home.write_bucketed("vectors", I.document_vectors(idx) if idx.counts is None else idx.counts, "dkey", n)
        home.write("vocab", idx.vocab)
        kept = home.finish(buckets=n, n_docs=idx.n_docs)
    vectors = home.read_bucketed("vectors", "dkey", kept["buckets"])
    if "v" not in vectors.columns:
        return I.tfidf_from_counts(vectors, home.read("vocab"), kept["n_docs"], ngram_max, tokenizer)
    return I.TfidfIndex(I.weight_rows(vectors), home.read("vocab"), kept["n_docs"], ngram_max, tokenizer, vectors)


ROWS_PER_LIST_FILE = 500_000


def write_lists(home: IndexHome, table: str, rows: DataFrame, key: str,
                rows_per_file: int = ROWS_PER_LIST_FILE) -> None:
    """``rows`` (with ``cluster_id``) written partitioned by cluster, a cluster
    in as many files as its measured size asks for: rows are dealt to numbered
    sub-lists by a hash of ``key``, and every (cluster, sub-list) is a partition
    key of its own. ``<table>_files`` lists the sub-lists with their sizes."""
    clusters = rows.groupBy("cluster_id").agg(F.ceil(F.count(F.lit(1)) / rows_per_file).cast("int").alias("parts"))
    # a row a cluster: bounded by the number of clusters
    dealt = rows.join(F.broadcast(clusters), "cluster_id").withColumn(
        "sublist", F.pmod(F.xxhash64(key), F.col("parts")).cast("int")).drop("parts")
    (dealt.repartition("cluster_id", "sublist").write.mode("overwrite").partitionBy("cluster_id", "sublist")
     .parquet(home.path(table)))
    home.write(f"{table}_files", home.read(table).groupBy("cluster_id", "sublist").agg(F.count(F.lit(1)).alias("n_rows")))


def ivf_persistent(spark: SparkSession, passages: DataFrame, centroids: DataFrame,
                   root: str | None = None, version: str | None = None,
                   rows_per_file: int = ROWS_PER_LIST_FILE):
    """S4 for IVF: the centroid table and the passage vectors with their
    cluster, written by :func:`write_lists`: probing a few clusters reads only
    their files, and a large cluster is written and probed by several tasks.
    The centroids' values are part of the fingerprint."""
    from quarry.operators import retrieve as R
    from quarry.session import materialize
    home = IndexHome(spark, "ivf", {"source": source_version(spark, passages, version),
                                    "centroids": _table_hash(centroids, "cluster_id", "centroid"),
                                    "rows_per_file": rows_per_file}, root)
    if home.manifest() is None:
        write_lists(home, "vectors", materialize(R.ivf_assign(passages, centroids), "ivf-assigned"), "pid", rows_per_file)
        home.write("centroids", centroids)
        home.finish()
    return home.read("vectors").drop("sublist"), home.read("centroids")


def _table_hash(df: DataFrame, *cols: str) -> list:
    h = F.xxhash64(*cols).cast("decimal(38,0)")
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h")).first()
    return [r["n"], str(r["h"])]


def coded_persistent(spark: SparkSession, passages: DataFrame, centroids: DataFrame, root: str | None = None,
                     version: str | None = None, rows_per_file: int = ROWS_PER_LIST_FILE):
    """S4 for the 8-bit index (``quantize.CodedIndex``): codes and full vectors
    by cluster as :func:`ivf_persistent`; the levels are in the manifest."""
    import numpy as np
    from quarry.operators import quantize as Z
    vectors, cents = ivf_persistent(spark, passages, centroids, root, version, rows_per_file)
    home = IndexHome(spark, "ivf-sq8", {"source": source_version(spark, passages, version),
                                        "centroids": _table_hash(centroids, "cluster_id", "centroid"),
                                        "rows_per_file": rows_per_file}, root)
    kept = home.manifest()
    if kept is None:
        index = Z.build(vectors, cents)
        write_lists(home, "codes", index.codes, "pid", rows_per_file)
        kept = home.finish(low=index.low.tolist(), step=index.step.tolist())
    return Z.CodedIndex(home.read("codes").drop("sublist"), vectors.select("pid", "cluster_id", "vec"), cents,
                        np.array(kept["low"]), np.array(kept["step"]))


def tfidf_ivf_persistent(spark: SparkSession, source: DataFrame, root: str | None = None, num_clusters: int = 64,
                         iterations: int = 10, top_terms: int = 2000, rows_per_file: int = ROWS_PER_LIST_FILE,
                         version: str | None = None, **kw):
    """S4 for IVF over TF-IDF vectors (``sparse_ivf.SparseIvf``): the TF-IDF
    index of :func:`tfidf_persistent` (which takes ``kw``), learned centroids
    and the documents by cluster (``rows_per_file``: documents)."""
    from quarry.operators import sparse_ivf as V
    index = tfidf_persistent(spark, source, root, version=version, **kw)
    home = IndexHome(spark, "tfidf-ivf", {
        "source": source_version(spark, source, version), "clusters": num_clusters, "iterations": iterations,
        "top_terms": top_terms, "rows_per_file": rows_per_file, "layout": NUMBERED,
        "tfidf": {k: v for k, v in kw.items() if k not in ("tokenizer", "buckets")}}, root)
    if home.manifest() is None:
        ivf = V.build_lists(index, V.kmeans(index, num_clusters, iterations, top_terms))
        write_lists(home, "lists", ivf.documents, "dkey", rows_per_file)
        home.write("centroids", ivf.centroids)
        home.finish()
    return V.from_documents(home.read("centroids"), home.read("lists").drop("sublist"), index)


# ---------------------------------------------------------------- S5, S6 JSON

def write_predictions(decoded: DataFrame, output_dir: str, prefix: str | None = None,
                      version_2_with_negative: bool = False) -> dict[str, str]:
    """The decoder's outputs as JSON-lines directories
    ``predictions[_prefix].json`` (id, text, start),
    ``nbest_predictions[_prefix].json`` (id, label, n-best list) and, in
    negative mode, ``null_odds[_prefix].json`` (id, score difference)."""
    def name(k):
        return os.path.join(output_dir, (f"{k}_{prefix}" if prefix else k) + ".json")
    tables = {"predictions": decoded.select("example_id", "prediction_text", "prediction_start"),
              "nbest_predictions": decoded.select(
                  "example_id", *(["label"] if "label" in decoded.columns else []), "nbest")}
    if version_2_with_negative:
        tables["null_odds"] = decoded.select("example_id", "score_diff")
    out = {}
    for k, df in tables.items():
        df.write.mode("overwrite").json(name(k))
        out[k] = name(k)
    return out


def read_prediction_object(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Prediction files ``{id: text}``: one JSON object a file, which one
    task parses, or with ``lines`` one object a line (any number of ids in
    each), which Spark splits. :func:`write_prediction_lines` converts."""
    raw = spark.read.text(path, wholetext=not lines)
    return raw.select(F.explode_outer(F.from_json("value", MapType(StringType(), StringType())))
                      .alias("id", "prediction_text")).filter(F.col("id").isNotNull())


def write_prediction_lines(preds: DataFrame, path: str, id_col: str = "id", text: str = "prediction_text") -> None:
    """``{id: text}`` objects, a line each."""
    write_text(preds.select(F.to_json(F.create_map(F.col(id_col).cast("string"), F.col(text))).alias("value")), "value", path)


def read_ground_truth(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``{id, answers: {text: [...]}}`` records, in one JSON array a file
    (parsed by one task) or, with ``lines``, one a line."""
    schema = StructType([StructField("id", StringType()),
                         StructField("answers", StructType([
                             StructField("text", ArrayType(StringType()))]))])
    return spark.read.schema(schema).option("multiLine", not lines).json(path).select(
        "id", F.col("answers.text").alias("answers"))


def write_ground_truth_lines(truth: DataFrame, path: str, id_col: str = "id", answers: str = "answers") -> None:
    """Truth records, a line each; ``answers`` is an array of texts."""
    truth.select(F.col(id_col).cast("string").alias("id"), F.struct(F.col(answers).alias("text")).alias("answers")) \
        .write.mode("overwrite").json(path)


# ---------------------------------------------------------------- S7 CSV

CSV_OPTS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def write_csv(df: DataFrame, path: str) -> None:
    """Result tables whose texts may hold newlines and quotes."""
    df.write.mode("overwrite").options(**CSV_OPTS).csv(path)


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read.options(**CSV_OPTS)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


# ---------------------------------------------------------------- S8 metrics

def metrics_table(metrics: DataFrame, prefix: str = "eval_") -> DataFrame:
    """A one-row metrics frame -> ``(metric, value)`` rows with the prefix."""
    cols = [c for c in metrics.columns]
    pairs = ", ".join(f"'{prefix}{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return metrics.selectExpr(f"stack({len(cols)}, {pairs}) AS (metric, value)")


def write_metrics(metrics: DataFrame, path: str, prefix: str = "eval_") -> None:
    metrics_table(metrics, prefix).write.mode("overwrite").json(path)


# ---------------------------------------------------------------- S9 text

def write_text(df: DataFrame, col: str, path: str) -> None:
    """One report fragment per line of text output."""
    df.select(F.col(col).alias("value")).write.mode("overwrite").text(path)


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh folder in the shared directory for round trips; removed with
    the application's intermediate tables."""
    return os.path.join(stage_root(spark), "scratch", uuid.uuid4().hex, *parts)
