"""Exact deduplication.

``keep first`` is made deterministic by an explicit order key: the row with the
smallest ``order_col`` survives for each distinct key text.

Plan shape: one hash aggregate on a 256-bit content hash of the key text.
``min_by`` is a declarative aggregate, so Spark combines map-side before the
shuffle: a text repeated in a third of all rows still sends at most one row per
map task to the reducer, which is what keeps a hot duplicate from landing on
one task. The output stays hash-partitioned by ``dkey``; downstream operators
that group per document (postings, scores) reuse that partitioning instead of
shuffling again, as long as ``dkey`` is carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_key(col) -> "F.Column":
    """SHA-256 of the key text; equal texts <=> equal keys (collisions of a
    256-bit hash are not a practical concern at any corpus size)."""
    return F.sha2(col, 256)


def dedup_keep_first(df: DataFrame, key_col: str, order_col: str,
                     key_name: str = "dkey") -> DataFrame:
    """One row per distinct ``key_col`` value, the one with min ``order_col``.

    Returns the surviving rows with all their columns plus ``key_name``.
    """
    cols = [c for c in df.columns]
    packed = F.struct(*[F.col(c) for c in cols])
    out = (df.withColumn(key_name, content_key(F.col(key_col)))
             .groupBy(key_name)
             .agg(F.min_by(packed, F.col(order_col)).alias("_row")))
    return out.select(key_name, *[F.col("_row." + c).alias(c) for c in cols])


def dedup_counts(df: DataFrame, key_col: str) -> DataFrame:
    """before/after row counts of an exact dedup on ``key_col``."""
    return df.agg(F.count(F.lit(1)).alias("n_before"),
                  F.count_distinct(content_key(F.col(key_col))).alias("n_after"))
