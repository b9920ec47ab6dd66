"""Corpus profiling.

All profiles are aggregates or semi/anti joins over whole tables; the
"top/bottom n" reports are ``orderBy().limit(n)`` (the limit is the feature)
and plan as a per-task top-n followed by one merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T


def substring_search(df: DataFrame, needle: str, text: str = "text") -> DataFrame:
    """Rows whose text contains the literal ``needle``."""
    return df.filter(F.col(text).contains(F.lit(needle)))


def length_outliers(df: DataFrame, threshold: int = 20000, text: str = "text") -> DataFrame:
    """Rows longer than ``threshold`` characters."""
    return df.filter(F.length(text) > threshold)


def token_overlap(q_tokens: Column, c_tokens: Column) -> tuple[Column, Column]:
    """Question tokens found in the context (duplicates in the question
    count) and their share of the question."""
    # array_intersect is hash based (linear); each question token is then
    # looked up in the (at most |q|) common tokens, not in the whole context
    common = F.array_intersect(q_tokens, c_tokens)
    shared = F.filter(q_tokens, lambda t: F.array_contains(common, t))
    ratio = F.when(F.size(q_tokens) > 0, F.size(shared) / F.size(q_tokens))
    return shared, ratio


def length_histogram(df: DataFrame, bins: int = 30, lo: int = 0, hi: int = 5000,
                     text: str = "text") -> DataFrame:
    """Equal-width histogram of text lengths on [lo, hi] (the right edge
    belongs to the last bin; lengths outside are not counted). Every bin has a
    row, empty ones too."""
    n = F.length(text)
    b = F.when(n == hi, F.lit(bins - 1)).otherwise(
        F.floor((n - lo) * bins / (hi - lo))).cast("int")
    x = df.select(b.alias("bin")).filter((F.col("bin") >= 0) & (F.col("bin") < bins))
    found = x.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(found), "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"))


def length_summary(df: DataFrame, outlier: int = 20000, text: str = "text") -> DataFrame:
    """Min and max length and the outlier count."""
    n = F.length(text)
    return df.agg(F.count(F.lit(1)).alias("n_docs"), F.min(n).alias("min_len"),
                  F.max(n).alias("max_len"),
                  F.sum((n > outlier).cast("long")).alias("n_outliers"))


def joined_length(df: DataFrame, text: str = "text") -> DataFrame:
    """Length of all texts joined by one space = sum(length) + count - 1."""
    return df.agg((F.sum(F.length(text)) + F.count(F.lit(1)) - 1).alias("total_chars"))


def special_chars(df: DataFrame, text: str = "text") -> DataFrame:
    """E16 + J11: distinct characters that are not word characters,
    whitespace or Hangul, with their corpus frequency."""
    x = df.select(F.explode_outer(F.regexp_extract_all(F.col(text), F.lit(T.SPECIAL_CHAR), 0))
                  .alias("ch")).filter(F.col("ch").isNotNull())
    return x.groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


def special_chars_in_answers(chars: DataFrame, answers: DataFrame,
                             answer: str = "answer_text") -> DataFrame:
    """Each corpus special character and whether any answer contains
    it. Answers are exploded into characters and semi-joined on equality
    (no substring theta join)."""
    a = (answers.select(F.explode_outer(F.split(F.col(answer), "")).alias("ch"))
                .filter(F.col("ch").isNotNull() & (F.col("ch") != "")).distinct())
    present = chars.select("ch").join(a, "ch", "left_semi").withColumn("in_answer", F.lit(True))
    absent = chars.select("ch").join(a, "ch", "left_anti").withColumn("in_answer", F.lit(False))
    return present.unionByName(absent)


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows in the given order (a top-n report)."""
    return df.orderBy(*order).limit(n)


def micro_f1(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Micro-averaged F1 with one label per row (= accuracy)."""
    return df.agg(F.round(F.avg((F.col(pred) == F.col(label)).cast("double")), 6).alias("micro_f1"),
                  F.count(F.lit(1)).alias("n"))
