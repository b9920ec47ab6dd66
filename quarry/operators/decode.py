"""Reader post-processing: per-token start/end scores -> n-best
answers, best answer, null odds.

Shape of the plan:

1. per feature (window) row, the top-n start and end positions are array
   expressions, and the valid (start, end) pairs - at most n x n, a
   parameter - are built and filtered inside the row, then exploded;
2. ``row_number() <= n`` per example keeps the n best candidates (a partial
   limit runs before the shuffle by example);
3. the survivors (bounded by n + 1 per example) are joined to their example
   for the answer text and gathered into one sorted array per example, where
   the fallback answer, the softmax and the best-answer rule are array
   expressions.

Tie rule: score descending, then window, start position, end position; the
null candidate sorts after regular candidates of equal score (it is appended
last in the reference's stable sort).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_DIGITS = 6


def top_positions(logits: Column, n: int) -> Column:
    """Indexes (0-based) of the n largest values, largest first; equal
    values by index ascending."""
    ranked = F.sort_array(F.transform(logits, lambda v, i: F.struct(
        (-v).alias("nv"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, n), lambda x: x["i"])


def check_features(features: DataFrame, offsets: str = "offsets",
                   start: str = "start_logits", end: str = "end_logits") -> DataFrame:
    """Rows whose logit arrays do not align with their offsets."""
    return features.filter((F.size(start) != F.size(offsets)) | (F.size(end) != F.size(offsets)))


def candidates(features: DataFrame, n_best: int = 10, max_answer_length: int = 30,
               example: str = "example_id", window: str = "window_index",
               offsets: str = "offsets", start: str = "start_logits",
               end: str = "end_logits", context_index: str = "context_index",
               max_context: str | None = None) -> DataFrame:
    """Valid answer spans of every feature, one row each."""
    offs = F.col(offsets)
    sl, el = F.col(start), F.col(end)
    L = F.size(offs)

    def valid(s, e):
        ok = ((s < L) & (e < L) & F.element_at(offs, s + 1).isNotNull()
              & F.element_at(offs, e + 1).isNotNull() & (e >= s)
              & (e - s + 1 <= max_answer_length))
        if max_context:
            ok = ok & F.coalesce(F.element_at(F.col(max_context), s.cast("string")), F.lit(False))
        return ok

    # both lists are columns first: inside the lambda the second would be
    # sorted again for every start
    features = (features.withColumn("_ts", top_positions(sl, n_best))
                        .withColumn("_te", top_positions(el, n_best)))
    pairs = F.flatten(F.transform("_ts", lambda s: F.transform(
        "_te", lambda e: F.struct(
            (-(F.element_at(sl, s + 1) + F.element_at(el, e + 1))).alias("ns"),
            s.alias("s"), e.alias("e")))))
    # only a feature's n_best best spans can reach its example's n-best list:
    # keep them in the row (same order: score desc, start, end) before exploding
    kept = F.slice(F.sort_array(F.filter(pairs, lambda p: valid(p["s"], p["e"]))), 1, n_best)
    ci = F.col(context_index) if context_index in features.columns else F.lit(0)
    x = features.select(F.col(example).alias("example_id"), F.col(window).alias("window_index"),
                        ci.alias("context_index"), offs.alias("_o"), sl.alias("_sl"),
                        el.alias("_el"), F.explode_outer(kept).alias("_p")).filter(
        F.col("_p").isNotNull())
    s, e = F.col("_p.s"), F.col("_p.e")
    return x.select(
        "example_id", "window_index", "context_index", s.alias("s"), e.alias("e"),
        F.element_at("_sl", s + 1).alias("start_logit"),
        F.element_at("_el", e + 1).alias("end_logit"),
        F.element_at("_o", s + 1)["s"].alias("char_s"),
        F.element_at("_o", e + 1)["e"].alias("char_e"),
        F.lit(0).alias("kind"))


def null_candidates(features: DataFrame, example: str = "example_id",
                    window: str = "window_index", start: str = "start_logits",
                    end: str = "end_logits") -> DataFrame:
    """Per example, the feature with the smallest ``start[0] + end[0]``."""
    s0, e0 = F.element_at(start, 1), F.element_at(end, 1)
    best = features.groupBy(F.col(example).alias("example_id")).agg(
        F.min_by(F.struct(s0.alias("sl"), e0.alias("el"), F.col(window).alias("w")),
                 F.struct((s0 + e0).alias("sc"), F.col(window).alias("w"))).alias("m"))
    return best.select("example_id", F.col("m.w").alias("window_index"),
                       F.lit(None).cast("int").alias("context_index"),
                       F.lit(0).alias("s"), F.lit(0).alias("e"),
                       F.col("m.sl").alias("start_logit"), F.col("m.el").alias("end_logit"),
                       F.lit(0).alias("char_s"), F.lit(0).alias("char_e"), F.lit(1).alias("kind"))


def _context_at(ctx: Column, ci: Column, is_array: bool) -> Column:
    return F.element_at(ctx, ci + 1) if is_array else ctx


def nbest(features: DataFrame, examples: DataFrame, n_best: int = 10,
          max_answer_length: int = 30, version_2_with_negative: bool = False,
          null_score_diff_threshold: float = 0.0, id_col: str = "id",
          context: str = "context", answers: str | None = None,
          **cand_kw) -> DataFrame:
    """N6-N12 (N13 = this whole operator): one row per example with

    ``nbest`` array<struct<rank, text, start_logit, end_logit, probability,
    prediction_start, context_index>>, ``prediction_text``,
    ``prediction_start``, ``score_diff`` (negative mode, else null) and
    ``label`` (first ground-truth text when ``answers`` is given).
    """
    c = candidates(features, n_best, max_answer_length, **cand_kw)
    if version_2_with_negative:
        c = c.unionByName(null_candidates(features, **{k: v for k, v in cand_kw.items()
                                                       if k in ("example", "window", "start", "end")}))
    c = c.withColumn("score", F.col("start_logit") + F.col("end_logit"))
    order = Window.partitionBy("example_id").orderBy(
        F.col("score").desc(), F.col("kind"), F.col("window_index"), F.col("s"), F.col("e"))
    ranked = c.withColumn("_r", F.row_number().over(order))
    keep = F.col("_r") <= n_best
    if version_2_with_negative:
        keep = keep | (F.col("kind") == 1)     # the null candidate is re-added if cut
    ranked = ranked.filter(keep)

    ctx_is_array = dict(examples.dtypes)[context].startswith("array")
    ex_cols = [F.col(id_col).alias("example_id"), F.col(context).alias("_ctx")]
    if answers:
        ex_cols.append(F.element_at(F.col(answers + ".text"), 1).alias("label"))
    ex = examples.select(*ex_cols)
    j = ranked.join(ex.select("example_id", "_ctx"), "example_id")
    text = F.when(F.col("kind") == 1, F.lit("")).otherwise(F.substring(
        _context_at(F.col("_ctx"), F.col("context_index"), ctx_is_array),
        F.col("char_s") + 1, F.col("char_e") - F.col("char_s")))
    item = F.struct(F.col("_r").alias("r"), F.col("kind").alias("kind"),
                    F.col("score").alias("score"), F.col("start_logit").alias("start_logit"),
                    F.col("end_logit").alias("end_logit"), text.alias("text"),
                    F.col("char_s").alias("prediction_start"),
                    F.col("context_index").alias("context_index"))
    grouped = j.groupBy("example_id").agg(F.sort_array(F.collect_list(item)).alias("_a"))
    out = ex.join(grouped, "example_id", "left")

    empty_item = F.struct(F.lit(0).alias("r"), F.lit(0).alias("kind"), F.lit(0.0).alias("score"),
                          F.lit(0.0).alias("start_logit"), F.lit(0.0).alias("end_logit"),
                          F.lit("empty").alias("text"), F.lit(0).alias("prediction_start"),
                          F.lit(None).cast("int").alias("context_index"))
    a = F.coalesce(F.col("_a"), F.array().cast(grouped.schema["_a"].dataType))
    need_fallback = (F.size(a) == 0) | ((F.size(a) == 1) & (F.element_at(a, 1)["text"] == ""))
    a2 = F.when(need_fallback, F.concat(F.array(empty_item), a)).otherwise(a)
    out = out.withColumn("_a", a2)
    m = F.array_max(F.transform("_a", lambda x: x["score"]))
    z = F.aggregate(F.transform("_a", lambda x: F.exp(x["score"] - m)), F.lit(0.0),
                    lambda acc, v: acc + v)
    nb = F.transform("_a", lambda x, i: F.struct(
        (i + 1).alias("rank"), x["text"].alias("text"), x["start_logit"].alias("start_logit"),
        x["end_logit"].alias("end_logit"),
        F.round(F.exp(x["score"] - m) / z, SCORE_DIGITS).alias("probability"),
        x["prediction_start"].alias("prediction_start"),
        x["context_index"].alias("context_index")))
    out = out.withColumn("nbest", nb)
    first = F.try_element_at("_a", F.lit(1))
    if not version_2_with_negative:
        out = out.withColumn("prediction_text", first["text"]).withColumn(
            "prediction_start", first["prediction_start"]).withColumn(
            "score_diff", F.lit(None).cast("double"))
    else:
        best = F.try_element_at(F.filter("_a", lambda x: x["text"] != ""), F.lit(1))
        null_sc = F.try_element_at(F.filter("_a", lambda x: x["kind"] == 1), F.lit(1))["score"]
        diff = null_sc - best["start_logit"] - best["end_logit"]
        out = (out.withColumn("score_diff", F.round(diff, SCORE_DIGITS))
                  .withColumn("prediction_text", F.when(diff > null_score_diff_threshold, F.lit(""))
                              .otherwise(best["text"]))
                  .withColumn("prediction_start", F.when(diff > null_score_diff_threshold, F.lit(0))
                              .otherwise(best["prediction_start"])))
    cols = ["example_id", "prediction_text", "prediction_start", "score_diff", "nbest"]
    if answers:
        cols.append("label")
    return out.select(*cols)


def nbest_long(decoded: DataFrame) -> DataFrame:
    """N12 in long form: one row per (example, rank)."""
    return decoded.select("example_id", F.explode_outer("nbest").alias("n")).filter(
        F.col("n").isNotNull()).select(
        "example_id", "n.rank", "n.text", "n.start_logit", "n.end_logit",
        "n.probability", "n.prediction_start", "n.context_index")
