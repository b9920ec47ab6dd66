"""IVF over TF-IDF vectors: k-means on sparse rows.

A vector is a document's row with its terms (or rows ``(document, term, w)``); no
dense document x vocabulary matrix is made. A centroid is rows ``(cluster_id, term, c)`` too, cut to its
``top_terms`` heaviest terms, so the whole model has a bounded number of rows
(clusters x (top_terms + 1)).

Nearest by squared distance means the largest ``2 x.c - |c|^2``. The last part
is carried as one more dimension: every document and question has the term
``BIAS`` with weight 1, every centroid has it with ``-|c|^2 / 2``. The value of
a document for all clusters is then one equi-join on ``term`` (with the bounded
model as the small side) and one sum per (document, cluster), and a cluster
that shares no term with a document still gets its value. Where the model
measures small, a document is assigned in the task that reads it (:mod:`.scan`).

Training uses a bounded sample of documents (``train_docs``, as many as the
usual 256 a cluster), all documents are assigned in one pass.

Search. A question probes its nearest lists; only documents of these count for
it, scored where they are read, as in R3. The distance of
unit vectors is 2 - 2 cos. Documents that share no term with a question (distance
2) are not ranked, as in R3: with all clusters probed the ranking is R3's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import scan
from quarry.operators.index import TfidfIndex, document_vectors, number_rows, weight_rows
from quarry.operators.retrieve import rank_topk, tfidf_query_weights
from quarry.plans.sizing import maybe_broadcast
from quarry.session import materialize

BIAS = "\u0001"  # no token holds a control character after P6
VALUE_DIGITS = 9
DOC = ["dkey", "document_id"]


@dataclass
class SparseIvf:
    """``centroids``: cluster_id, term, c; ``lists``: dkey, document_id,
    cluster_id, term, w; ``tfidf`` the index whose vectors these are."""

    centroids: DataFrame
    lists: DataFrame
    tfidf: TfidfIndex
    documents: DataFrame | None = None   # the lists, a row a document: cluster_id with what the index has of it


def with_bias(means: DataFrame, top_terms: int) -> DataFrame:
    """Model rows of the mean vectors (cluster_id, term, c): the heaviest
    ``top_terms`` terms of each (ties: the smaller term) and the bias row."""
    heavy = Window.partitionBy("cluster_id").orderBy(F.desc("c"), F.asc("term"))
    cut = means.withColumn("_r", F.row_number().over(heavy)).filter(F.col("_r") <= top_terms).drop("_r")
    bias = cut.groupBy("cluster_id").agg((-F.sum(F.col("c") * F.col("c")) / 2).alias("c")).select(
        "cluster_id", F.lit(BIAS).alias("term"), "c")
    return cut.select("cluster_id", "term", "c").unionByName(bias)


def _model(centroids: DataFrame) -> DataFrame:
    """The bounded model as a join side, broadcast if it measures small."""
    return maybe_broadcast(centroids.select("cluster_id", "term", "c"), [F.octet_length("term")])[0]


def cluster_values(vectors: DataFrame, centroids: DataFrame, keys: list[str], w: str = "w") -> DataFrame:
    """``keys, cluster_id, value`` with value = x.c - |c|^2 / 2 for every
    vector (rows ``keys, term, w``) and every cluster."""
    ones = vectors.select(*keys).distinct().select(*keys, F.lit(BIAS).alias("term"), F.lit(1.0).alias(w))
    rows = vectors.select(*keys, "term", w).unionByName(ones)
    return (rows.join(_model(centroids), "term").groupBy(*keys, "cluster_id")
            .agg(F.sum(F.col(w) * F.col("c")).alias("value")))


def _nearest(values: DataFrame, keys: list[str]) -> DataFrame:
    best = F.max(F.struct(F.round("value", VALUE_DIGITS).alias("v"), (-F.col("cluster_id")).alias("c")))
    return values.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.c")).alias("cluster_id"))


def assign(weights: DataFrame, centroids: DataFrame) -> DataFrame:
    """``dkey, document_id, cluster_id`` of every document of ``weights``
    (value rounded to 9 places; ties: the smaller cluster)."""
    return _nearest(cluster_values(weights, centroids, DOC), DOC)


def assigned(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """``vectors`` (dkey, document_id, v) with the ``cluster_id`` that
    :func:`assign` gives."""
    model, small = maybe_broadcast(centroids.select("cluster_id", "term", "c"), [F.octet_length("term")])
    if small:
        return scan.nearest(vectors, "v", model, BIAS, VALUE_DIGITS)
    return vectors.join(assign(weight_rows(vectors), centroids), DOC)


def assigned_counts(index: TfidfIndex, centroids: DataFrame) -> DataFrame:
    """:func:`assigned` for the index's counts: these with the ``cluster_id``."""
    model, small = maybe_broadcast(centroids.select("cluster_id", "term", "c"), [F.octet_length("term")])
    if small:
        return scan.nearest(index.counts, scan.numbered, scan.by_number(model, index.vocab, "c"), -1, VALUE_DIGITS, scan.over_norm)
    return index.counts.join(assign(index.weights, centroids), DOC)


def mean_vectors(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """``cluster_id, term, c``: the mean of the vectors (dkey, document_id, v) of
    each cluster's ``members`` (dkey, document_id, cluster_id)."""
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    sums = weight_rows(vectors.join(members, DOC), "cluster_id").groupBy("cluster_id", "term").agg(F.sum("w").alias("s"))
    return sums.join(sizes, "cluster_id").select("cluster_id", "term", (F.col("s") / F.col("n")).alias("c"))


def kmeans(index: TfidfIndex, num_clusters: int = 64, iterations: int = 10, top_terms: int = 2000,
           train_docs: int | None = None) -> DataFrame:
    """Learned centroids. Trains on about ``train_docs`` documents (default
    256 a cluster), chosen by a hash of their content; begins with the
    ``num_clusters`` of least hash; a cluster that loses all members keeps its
    centroid. Every round is written, so its lineage is short."""
    train_docs = train_docs or 256 * num_clusters
    draw = F.pmod(F.xxhash64("dkey", F.lit("kmeans")), F.lit(1 << 40))
    share = min(1.0, train_docs / max(1, index.n_docs))
    drawn = draw < F.lit(int(share * (1 << 40)))
    sample = document_vectors(index).filter(drawn) if index.counts is None else scan.weigh(index.counts.filter(drawn), index.vocab)
    sample = materialize(sample, "ivf-sample")
    first = (sample.select(*DOC, draw.alias("_d")).distinct().orderBy("_d", "document_id").limit(num_clusters)
             .withColumn("cluster_id", (F.row_number().over(Window.orderBy("_d", "document_id")) - 1).cast("int")))
    members = first.drop("_d")  # num_clusters rows, a parameter
    centroids = materialize(with_bias(mean_vectors(sample, members), top_terms), "ivf-centroids")
    for _ in range(iterations):
        members = materialize(assigned(sample, centroids).select(*DOC, "cluster_id"), "ivf-members")
        new = with_bias(mean_vectors(sample, members), top_terms)
        left = centroids.join(members.select("cluster_id").distinct(), "cluster_id", "left_anti")
        centroids = materialize(new.unionByName(left), "ivf-centroids")
    return centroids


def centroids_by_label(index: TfidfIndex, labels: DataFrame, top_terms: int = 2000) -> DataFrame:
    """Given instead of learned centroids: the mean vector of the documents of
    each label (``dkey, document_id, cluster_id``)."""
    return materialize(with_bias(mean_vectors(document_vectors(index), labels), top_terms), "ivf-centroids")


def build_lists(index: TfidfIndex, centroids: DataFrame) -> SparseIvf:
    """Every document's vector under its cluster."""
    found = assigned(document_vectors(index), centroids) if index.counts is None else assigned_counts(index, centroids)
    return from_documents(centroids, materialize(found, "ivf-lists"), index)


def from_documents(centroids: DataFrame, documents: DataFrame, index: TfidfIndex) -> SparseIvf:
    """The IVF over stored documents (``cluster_id`` with the index's counts, or with dkey, document_id, v)."""
    rows = weight_rows(documents, "cluster_id") if "v" in documents.columns else number_rows(documents, index.vocab, "cluster_id")
    return SparseIvf(centroids, rows, index, documents)


def probes(query_weights: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """``qid, cluster_id`` of the ``nprobe`` nearest clusters of each question."""
    values = cluster_values(query_weights, centroids, ["qid"], "wq")
    near = Window.partitionBy("qid").orderBy(F.round("value", VALUE_DIGITS).desc(), F.asc("cluster_id"))
    return (values.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= nprobe)
            .select("qid", "cluster_id"))


def topk(ivf: SparseIvf, questions: DataFrame, k: int = 10, nprobe: int = 1, **kw) -> DataFrame:
    """``qid, rank, document_id, score`` by squared distance (ascending,
    6 places; ties: document_id) over the ``nprobe`` nearest lists."""
    qw, small = tfidf_query_weights(ivf.tfidf, questions, **kw)
    qw = materialize(qw.filter(F.col("qid").isNotNull()), "ivf-questions")   # a question without an id probes no list
    lists = probes(qw, ivf.centroids, nprobe)
    if small and ivf.documents is not None and scan.fits((ivf.documents, "document_id")):
        terms, side, values = "v", qw, None
        if "v" not in ivf.documents.columns:
            terms, side, values = scan.numbered, scan.by_number(qw, ivf.tfidf.vocab, "wq"), scan.over_norm
        far = scan.topk(ivf.documents, terms, side, k, weight="wq", values=values, distance=True, probes=lists)
        return rank_topk(far, k, ascending=True).select("qid", "rank", "document_id", "score")
    wanted = qw.join(lists, "qid")
    side, _ = maybe_broadcast(wanted, [F.octet_length("term")])
    cosine = (ivf.lists.join(side, ["cluster_id", "term"]).groupBy("qid", *DOC)
              .agg(F.sum(F.col("wq") * F.col("w")).alias("cosine")))
    far = cosine.select("qid", "document_id", (F.lit(2.0) - 2 * F.col("cosine")).alias("score"))
    return rank_topk(far, k, ascending=True).select("qid", "rank", "document_id", "score")
