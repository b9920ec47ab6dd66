"""Chunking: overlapping token windows as array expressions.

Window arithmetic is closed-form, so one input row becomes its windows through
``sequence`` + ``transform`` + ``posexplode``; no Python and no per-row loop.

Dense passage ids (C2) need a global running count in document order. A
single ordered window would pull every row into one task; instead rows are
range-partitioned and sorted by the order key (of any orderable type), numbered
within their partition as they are written, and the partitions' sizes (one tiny
table) are summed up and added on reading. Texts are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize


def window_count(n: Column, W, S) -> Column:
    """Number of windows of ``W`` tokens with overlap ``S`` over ``n`` tokens:
    ``1 + ceil(max(n - W, 0) / (W - S))`` (an empty text gives one window)."""
    step = W - S
    return (F.lit(1) + F.ceil(F.greatest(n - W, F.lit(0)) / step)).cast("int")


def _check(W: int, S: int) -> None:
    if not W > S >= 0:
        raise ValueError(f"window {W} must exceed overlap {S} >= 0")


def token_windows(tokens: Column, W: int, S: int) -> Column:
    """``array<array<string>>`` of windows; the last runs to the end."""
    _check(W, S)
    n = F.size(tokens)
    idx = F.sequence(F.lit(0), window_count(n, W, S) - 1)
    return F.transform(idx, lambda i: F.slice(tokens, i * (W - S) + 1, W))


def passages(df: DataFrame, tokens_col: str, W: int = 150, S: int = 50,
             keep: tuple[str, ...] = ("document_id", "title")) -> DataFrame:
    """One row per window: ``keep..., window_index, text`` (tokens joined)."""
    wins = token_windows(F.col(tokens_col), W, S)
    # always >= 1 window; _outer avoids an inferred size() filter that would
    # inline the tokens expression into the window lambda
    return df.select(*keep, F.posexplode_outer(wins).alias("window_index", "_w")).select(
        *keep, "window_index", F.array_join("_w", " ").alias("text"))


_ROW_BITS = 33  # of monotonically_increasing_id: the row within its partition


def _sorted_by(df: DataFrame, order_col: str, n_ranges: int | None) -> DataFrame:
    n = n_ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, order_col).sortWithinPartitions(order_col)


def _with_numbers(ordered: DataFrame, name: str, label: str) -> DataFrame:
    """``ordered`` (rows in order within and across partitions) with their
    dense number from 0. The rows are written once with their place in the
    partition; the number of rows of each partition is counted from that table."""
    stored = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("_at", _ROW_BITS)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row a partition: the ordered window over them is one small task
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (stored.withColumn("_part", part).join(F.broadcast(start), "_part")
            .withColumn(name, F.col("_start") + place).drop("_part", "_start", "_at"))


def number_rows(df: DataFrame, order_col: str, name: str = "row_index", n_ranges: int | None = None) -> DataFrame:
    """``df`` with the dense number (from 0) of each row in ``order_col`` order
    (any orderable type, unique). One range exchange of the rows, one write."""
    return _with_numbers(_sorted_by(df, order_col, n_ranges), name, "numbered-rows")


def numbered_passages(df: DataFrame, tokens: str | Column, W: int = 150, S: int = 50,
                      order_col: str = "document_id",
                      keep: tuple[str, ...] = ("document_id", "title"),
                      n_ranges: int | None = None) -> DataFrame:
    """Passages with a dense global ``passage_id`` in (order_col, window)
    order, starting at 0. The documents are exchanged by ranges of
    ``order_col`` (any orderable type, unique), cut into windows in their
    sorted partitions and written once, with the windows' places. ``tokens``
    is a column of ``df`` or an expression over its columns, which is computed
    after the exchange, so that texts move instead of token arrays."""
    _check(W, S)
    toks = F.col(tokens) if isinstance(tokens, str) else tokens
    docs = _sorted_by(df, order_col, n_ranges).select(*keep, toks.alias("_t"))
    wins = docs.select(*keep, F.posexplode_outer(token_windows(F.col("_t"), W, S)).alias("window_index", "_w"))
    made = wins.select(*keep, "window_index", F.array_join("_w", " ").alias("text"))
    return _with_numbers(made, "passage_id", "passages").select("passage_id", *keep, "window_index", "text")


def reader_window_count(n_ctx: Column, max_len: int, q_len: Column, stride: int,
                        n_special: int = 3) -> Column:
    """Context tokens per window = max_len - q_len - specials; windows
    overlap by ``stride`` tokens."""
    W = F.lit(max_len) - q_len - F.lit(n_special)
    return window_count(n_ctx, W, F.lit(stride))
