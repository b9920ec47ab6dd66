"""Evaluation: answer metrics as Column expressions
and dataset-level aggregates.

Per-pair metrics are higher-order array functions (JVM-side); dataset scores
are single aggregates. Predictions missing for a ground-truth row score 0
(left join), and the missing ids are reported by an anti join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

# SQuAD answer normalisation removes these English articles.
ARTICLES = ("a", "an", "the")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def exact_match(pred, truth) -> Column:
    """P11(pred) = P11(truth)."""
    return T.normalize_answer(_c(pred)) == T.normalize_answer(_c(truth))


def _chars(c: Column) -> Column:
    """Code points of a string without spaces, as an array (empty for '')."""
    return F.filter(F.split(F.replace(c, F.lit(" "), F.lit("")), ""), lambda x: x != "")


def _counted(x: Column) -> Column:
    """Each element with its number among its equals (a, a, b -> a 1, a 2,
    b 1), as strings: sorted, cut at the ends of runs, numbered within them."""
    def numbered(st: Column) -> Column:
        n = F.size(st)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.element_at(st, i) != F.try_element_at(st, i + 1)))
        sizes = lambda e: F.zip_with(e, F.slice(F.concat(F.array(F.lit(0)), e), 1, F.size(e)), lambda a, b: a - b)
        spelled = lambda e: F.flatten(F.zip_with(e, sizes(e), lambda at, size: F.transform(
            F.sequence(F.lit(1), size), lambda j: F.concat(F.element_at(st, at), F.lit("\x00"), j.cast("string")))))
        return F.when(n > 0, T.let(ends, spelled)).otherwise(F.array().cast("array<string>"))
    return T.let(F.sort_array(x), numbered)


def _multiset_overlap(p: Column, g: Column) -> Column:
    """sum over distinct x of min(count_p(x), count_g(x)): the numbered
    elements that both have, a hash intersection (linear but for the sorts)."""
    return F.size(F.array_intersect(_counted(p), _counted(g)))


def _f1_from(p: Column, g: Column) -> Column:
    # bound first: the arrays are normalised and split texts
    def f1(x: Column) -> Column:
        def of(same: Column) -> Column:
            prec = same / F.size(x["p"])
            rec = same / F.size(x["g"])
            return F.when(same == 0, F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec))
        return T.let(_multiset_overlap(x["p"], x["g"]), of)
    return T.let(F.struct(p.alias("p"), g.alias("g")), f1)


def char_f1(pred, truth) -> Column:
    """F1 over the character multisets of the normalised strings."""
    return _f1_from(_chars(T.normalize_answer(_c(pred))),
                    _chars(T.normalize_answer(_c(truth))))


def max_over_truths(metric, pred, truths) -> Column:
    """Max of ``metric(pred, g)`` over an array of ground truths
    (null/empty array -> 0)."""
    scores = F.transform(_c(truths), lambda g: metric(_c(pred), g).cast("double"))
    return F.coalesce(F.array_max(scores), F.lit(0.0))


def squad_normalize(c) -> Column:
    """E5 normalisation: lower, drop ASCII punctuation, drop articles, collapse."""
    x = F.translate(F.lower(_c(c)), T.ASCII_PUNCTUATION, "")
    x = F.regexp_replace(x, "(?U)\\b(" + "|".join(ARTICLES) + ")\\b", " ")
    return T.collapse_ws(x)


def squad_em(pred, truth) -> Column:
    return squad_normalize(pred) == squad_normalize(truth)


def squad_f1(pred, truth) -> Column:
    """E5: token-multiset F1 of the normalised strings."""
    p = T.whitespace_tokens(squad_normalize(pred), normalized=True)
    g = T.whitespace_tokens(squad_normalize(truth), normalized=True)
    return _f1_from(p, g)


def fmt_percent(x) -> Column:
    """``f"{x:.2%}"`` (rounding as Python: see ``report.fixed2``)."""
    from quarry.operators.report import fixed2
    return F.concat(fixed2(_c(x) * 100), F.lit("%"))


def dataset_scores(truth: DataFrame, preds: DataFrame, id_col: str = "id",
                   answers: str = "answers", pred_col: str = "prediction_text") -> DataFrame:
    """EM and char-F1 over a ground-truth table (``id, answers[]``) and a
    prediction table (``id, prediction_text``). Sums are divided by the
    number of ground-truth rows; unanswered ids score 0."""
    j = truth.select(id_col, answers).join(preds.select(id_col, pred_col), id_col, "left")
    em = F.when(F.col(pred_col).isNull(), 0.0).otherwise(
        max_over_truths(exact_match, F.col(pred_col), F.col(answers)))
    f1 = F.when(F.col(pred_col).isNull(), 0.0).otherwise(
        max_over_truths(char_f1, F.col(pred_col), F.col(answers)))
    agg = j.agg(F.avg(em).alias("em"), F.avg(f1).alias("f1"),
                F.count(F.lit(1)).alias("n_total"),
                F.sum(F.col(pred_col).isNull().cast("int")).alias("n_unanswered"))
    return agg.select(F.round("em", 6).alias("em"), F.round("f1", 6).alias("f1"),
                      fmt_percent("em").alias("em_str"), fmt_percent("f1").alias("f1_str"),
                      "n_total", "n_unanswered")


def report_json(em_str, f1_str) -> Column:
    """E4 report string, as the scorer prints it (Python ``json.dumps``
    spacing): EM ranks and F1 does not; both are descending-better."""
    return F.concat(
        F.lit('{"EM": {"value": "'), _c(em_str), F.lit('", "rank": true, "decs": true}, '),
        F.lit('"F1": {"value": "'), _c(f1_str), F.lit('", "rank": false, "decs": true}}'))


def scores_json(scores: DataFrame) -> DataFrame:
    """E4 report string of a ``dataset_scores`` row."""
    return scores.select(report_json("em_str", "f1_str").alias("report"))


def unanswered(truth: DataFrame, preds: DataFrame, id_col: str = "id") -> DataFrame:
    """J10 report: ground-truth ids without a prediction."""
    return truth.select(id_col).join(preds.select(id_col), id_col, "left_anti")


def squad_scores(truth: DataFrame, preds: DataFrame, id_col: str = "id",
                 answers: str = "answers", pred_col: str = "prediction_text") -> DataFrame:
    """E5: SQuAD exact_match and f1 (x100) over all reference ids; an id
    without a prediction scores 0."""
    j = truth.select(id_col, answers).join(preds.select(id_col, pred_col), id_col, "left")
    em = F.when(F.col(pred_col).isNull(), 0.0).otherwise(
        max_over_truths(squad_em, F.col(pred_col), F.col(answers)))
    f1 = F.when(F.col(pred_col).isNull(), 0.0).otherwise(
        max_over_truths(squad_f1, F.col(pred_col), F.col(answers)))
    return j.agg(F.round(100 * F.avg(em), 6).alias("exact_match"),
                 F.round(100 * F.avg(f1), 6).alias("f1"))


def topk_accuracy(ranked: DataFrame, gold: DataFrame, questions: DataFrame,
                  ks=(10, 20, 50, 100), qid: str = "qid") -> DataFrame:
    """Share of questions whose first relevant document ranks <= k.

    ``ranked``: ``(qid, rank, document_id)``; ``gold``: relevant
    ``(qid, document_id)`` pairs; the denominator is every question.
    """
    first = (ranked.join(gold, ["qid", "document_id"], "left_semi")
                   .groupBy("qid").agg(F.min("rank").alias("first_rank")))
    return _accuracy_at(first, questions.select(F.col(qid).alias("qid")), ks)


def _accuracy_at(first: DataFrame, questions: DataFrame, ks) -> DataFrame:
    """Share of questions whose first hit (``qid, first_rank``) is <= k."""
    per_q = questions.select("qid").join(first, "qid", "left")
    kk = F.explode(F.array(*[F.lit(int(k)) for k in sorted(ks)])).alias("k")
    x = per_q.select("first_rank", kk)
    return (x.groupBy("k").agg(
                F.sum(F.when(F.col("first_rank") <= F.col("k"), 1).otherwise(0)).alias("hits"),
                F.count(F.lit(1)).alias("n_questions"))
             .withColumn("accuracy", F.round(F.col("hits") / F.col("n_questions"), 6)))


def topk_accuracy_by_context(ranked: DataFrame, corpus: DataFrame, questions: DataFrame,
                             ks=(10, 20, 50, 100), qid: str = "qid",
                             original_context: str = "context") -> DataFrame:
    """E6 as the source scores it: a question is answered at rank r when the
    r-th retrieved document's text equals the question's original context,
    both cleaned with P6. Equality is a hash join on the cleaned texts (the
    texts themselves are compared for the matched pairs, so a hash collision
    cannot count)."""
    from quarry.plans.sizing import broadcast_limit
    from quarry.session import materialize
    # stored before they are cleaned: what makes the questions runs once, and no
    # cleaning (or a null check of its result) is pushed down to all texts behind them
    q = materialize(questions.select(F.col(qid).alias("qid"), F.col(original_context).alias("_raw")), "question-contexts")
    q = q.withColumn("_oc", T.preprocess(F.col("_raw"))).drop("_raw")
    q = q.withColumn("_k", F.sha2("_oc", 256))
    # ranked has at most questions x max(ks) rows: broadcast it on that bound
    bound = q.count() * max(ks) * 64
    side = ranked.select("qid", "rank", "document_id")
    if bound <= broadcast_limit(ranked.sparkSession):
        side = F.broadcast(side)
    # likewise only the texts of ranked documents are cleaned, once
    r = materialize(corpus.select("document_id", "text").join(side, "document_id")
                    .select("qid", "rank", T.preprocess(F.col("text")).alias("_rc")), "ranked-texts")
    r = r.withColumn("_k", F.sha2("_rc", 256))
    first = (r.join(q, ["qid", "_k"]).filter(F.col("_rc") == F.col("_oc"))
              .groupBy("qid").agg(F.min("rank").alias("first_rank")))
    return _accuracy_at(first, q.select("qid"), ks)


def strict_match(pred_text, pred_start, answer_text, answer_start) -> Column:
    """Same start and same text."""
    return (_c(pred_start) == _c(answer_start)) & (_c(pred_text) == _c(answer_text))


def _logsumexp(arr: Column) -> Column:
    m = F.array_max(arr)
    return m + F.log(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))


def span_loss(start_logits, end_logits, start_pos, end_pos) -> Column:
    """E19 per row: (CE(start) + CE(end)) / 2; positions clamped to [0, L],
    where L = sequence length is the ignore index (row contributes null)."""
    def ce(logits, pos):
        L = F.size(logits)
        p = F.least(F.greatest(_c(pos), F.lit(0)), L)
        return F.when(p == L, F.lit(None).cast("double")).otherwise(
            _logsumexp(logits) - F.element_at(logits, p + 1))
    return (ce(_c(start_logits), start_pos), ce(_c(end_logits), end_pos))


CONTRASTIVE_BLOCK = 1024  # questions and passages of one tile


def _tile_sums(batches):
    """Rows sorted by (batch, qb, pb), each a question, a passage or both:
    per question of a tile the largest logit, the sum of exp(logit - largest)
    and, where its own passage is in the tile, its logit."""
    import numpy as np
    import pyarrow as pa

    names = ["batch", "qb", "pb"]

    def matrix(rows, name):
        column = rows.column(name).combine_chunks()
        at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        x = column.drop_null()
        return at, x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, 1))

    def tile(rows):
        ids = rows.column("id").combine_chunks()
        q_at, Q = matrix(rows, "q")
        p_at, P = matrix(rows, "p")
        if not len(q_at) or not len(p_at):
            return
        S = Q @ P.T
        high = S.max(axis=1)
        total = np.exp(S - high[:, None]).sum(axis=1)
        place = {i: j for j, i in enumerate(ids.take(pa.array(p_at)).to_pylist())}
        mine = [place.get(i, -1) for i in ids.take(pa.array(q_at)).to_pylist()]
        own = [float(S[i, j]) if j >= 0 else None for i, j in enumerate(mine)]
        yield pa.record_batch([rows.column("batch").combine_chunks().take(pa.array(q_at)), ids.take(pa.array(q_at)),
                               pa.array(high), pa.array(total), pa.array(own, pa.float64())],
                              names=["batch", "id", "high", "total", "own"])

    waiting = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        waiting = table if waiting is None else pa.concat_tables([waiting, table]).combine_chunks()
        if not len(waiting):
            continue
        edge = np.zeros(len(waiting) - 1, bool)
        for name in names:
            x = waiting.column(name).combine_chunks()
            edge |= np.asarray([a != b for a, b in zip(x[1:].to_pylist(), x[:-1].to_pylist())], bool)
        cuts = [0, *(np.flatnonzero(edge) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield from tile(waiting.slice(a, b - a))
        waiting = waiting.slice(cuts[-1])
    if waiting is not None and len(waiting):
        yield from tile(waiting)


def inbatch_contrastive(pairs: DataFrame, batch: str = "batch_id", qid: str = "qid",
                        qvec: str = "qvec", pvec: str = "pvec", block: int = CONTRASTIVE_BLOCK) -> DataFrame:
    """In-batch softmax NLL of the matching passage, per batch.

    ``pairs``: one (question vector, passage vector) per row with a batch id
    (``qid`` unique). For question i the logits are its dot products with every
    passage of the batch, and the loss is ``logsumexp(logits) - logits[i]``,
    averaged over the batch.

    A batch of up to ``block`` rows is one tile; a larger one is dealt into
    parts, and every (part of questions, part of passages) is a tile with a
    partition key of its own. A tile gives, per question, the largest logit
    and the sum of the others relative to it; these pairs are merged, so no
    task holds more than a tile, and no pair rows are made.
    """
    sizes = pairs.groupBy(batch).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nb"))
    rows = pairs.select(F.col(batch).alias("batch"), F.col(qid).alias("id"), F.col(qvec).cast("array<double>").alias("q"),
                        F.col(pvec).cast("array<double>").alias("p"))
    rows = rows.join(sizes.withColumnRenamed(batch, "batch"), "batch").withColumn(
        "own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    nothing = F.lit(None).cast("array<double>")
    one = rows.filter("nb = 1").select("batch", F.lit(0).alias("qb"), F.lit(0).alias("pb"), "id", "q", "p")
    more = rows.filter("nb > 1")
    tiles = (one.unionByName(more.select("batch", F.col("own").alias("qb"), other.alias("pb"), "id", "q", nothing.alias("p")))
             .unionByName(more.select("batch", other.alias("qb"), F.col("own").alias("pb"), "id", nothing.alias("q"), "p")))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    keys = ["batch", "qb", "pb"]
    sums = tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        _tile_sums, f"batch {kinds['batch']}, id {kinds['id']}, high double, total double, own double")
    parts = sums.groupBy("batch", "id").agg(F.max("high").alias("high"), F.max("own").alias("own"),
                                            F.collect_list(F.struct("high", "total")).alias("parts"))  # one a tile
    whole = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["total"] * F.exp(x["high"] - F.col("high")))
    nll = F.col("high") + F.log(whole) - F.col("own")
    return (parts.withColumn("nll", nll).groupBy(F.col("batch").alias(batch))
            .agg(F.round(F.avg("nll"), 6).alias("loss"), F.count(F.lit(1)).alias("n")))
