"""Measured broadcast decisions.

A side is broadcast only after its size has been measured and found under a
limit; otherwise the caller's shuffle strategy is used. The measurement is one
aggregate over the (small) side itself: the driver receives two numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT_KEY = "quarry.broadcast.maxBytes"
DEFAULT_LIMIT = 64 * 1024 * 1024
ROW_OVERHEAD = 32  # UnsafeRow header + fixed-width fields, a generous bound


def broadcast_limit(spark: SparkSession) -> int:
    v = spark.conf.get(LIMIT_KEY, None)
    return int(v) if v else DEFAULT_LIMIT


def measured_bytes(df: DataFrame, var_width: list[Column] | None = None) -> int:
    """Upper estimate of the in-memory size of ``df``: rows x overhead plus
    the byte length of the variable-width columns given."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if var_width:
        total = None
        for c in var_width:
            total = c if total is None else total + c
        aggs.append(F.sum(total).alias("w"))
    r = df.agg(*aggs).first()
    n = r["n"] or 0
    w = (r["w"] or 0) if var_width else 0
    return int(n * ROW_OVERHEAD + w)


def maybe_broadcast(df: DataFrame, var_width: list[Column] | None = None,
                    limit: int | None = None) -> tuple[DataFrame, bool]:
    """Return (df with a broadcast hint, True) when it measures under the
    limit, else (df, False) so Spark shuffles both sides (AQE may still
    convert at run time, and splits skewed partitions)."""
    spark = df.sparkSession
    lim = broadcast_limit(spark) if limit is None else limit
    if measured_bytes(df, var_width) <= lim:
        return F.broadcast(df), True
    return df, False
