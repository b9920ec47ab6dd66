"""Shared helpers for the operators of this subpackage.

Row keys. An operator that must find a row again uses the pair
(``doc_id``, ``tag``), where ``tag`` is Spark's 64-bit hash of the text, so
rows that repeat a ``doc_id`` with another text stay apart and rows that
repeat both are the same document. A null ``doc_id`` becomes one of two
reserved values (the smallest or the largest long) inside an operator and is
null again in its result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWEST = -(1 << 63)
HIGHEST = (1 << 63) - 1


def text_tag(text: str | Column = "text") -> Column:
    """64-bit hash of a text; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(F.coalesce(c, F.lit("")))


def keyed(docs: DataFrame, null_id: int, text: bool = True) -> DataFrame:
    """(doc_id, tag, text) of ``docs``; other columns are left behind, so
    their names cannot clash. Null ids become ``null_id``, null texts ''."""
    cols = [F.coalesce(F.col("doc_id").cast("long"), F.lit(null_id)).alias("doc_id"),
            text_tag().alias("tag")]
    if text:
        cols.append(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return docs.select(*cols)


def restore_null(null_id: int, name: str = "doc_id") -> Column:
    """The id column with the reserved value turned back into null."""
    return F.when(F.col(name) != F.lit(null_id), F.col(name)).alias(name)


def rows_by_key(docs: DataFrame, null_id: int) -> DataFrame:
    """``doc_id, tag, row``: the key of every row of ``docs`` and the whole row
    as one struct, so that none of its names can clash with others."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(null_id)).alias("doc_id"),
                       text_tag().alias("tag"), whole.alias("row"))


def whole_rows(keyed_rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from the structs of :func:`rows_by_key`."""
    return keyed_rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def keep_rows(docs: DataFrame, keys: DataFrame, null_id: int) -> DataFrame:
    """The rows of ``docs`` (all columns, in their order) whose (doc_id, tag)
    is in ``keys``; a key that several rows share keeps one of them.

    The join and the deduplication use the same two columns, so the texts are
    shuffled once.
    """
    out = rows_by_key(docs, null_id).join(keys.select("doc_id", "tag"), ["doc_id", "tag"], "left_semi")
    return whole_rows(out.dropDuplicates(["doc_id", "tag"]), docs)


def partitions(df: DataFrame) -> int:
    """The session's shuffle width, used where an operator deals rows out by
    a number that it computes itself."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def release(spark) -> None:
    """To call when a written table replaces what its job has shuffled: the
    driver collects its garbage, so that Spark's cleaner removes the shuffle
    files that nothing refers to any more, instead of at some later time."""
    import gc
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(batches_of):
    """For functions given to ``mapInArrow``: when a task ends, freed memory
    goes back to the system. Workers live on between tasks, and an executor
    holds the leftovers of all of them."""
    def run(batches):
        try:
            yield from batches_of(batches)
        finally:
            trim()
    return run


def trim() -> None:
    import ctypes
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if give_back is not None:
        give_back(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow column, without a copy
    per row; text i is ``bytes[offsets[i]:offsets[i + 1]]``."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int):
    """Row ranges (i, j) of up to ``most`` bytes, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
