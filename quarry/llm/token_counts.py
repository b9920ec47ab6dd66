"""Token counts of the documents in flat, unindexed token files.

A token file is a run of fixed-width ids in which an end id closes each
document; nothing says where documents begin. It is read in blocks of a fixed
number of ids. Each block is searched for end ids at once (numpy); what lies
between two of them in a block is a document's length, and a prefix scan over
the blocks' summaries stitches the documents that cross block boundaries and
numbers them.

The scan runs in two levels (blocks within a run of blocks, runs within a
file), so that one very large file is not scanned in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import frames, tokens
from quarry.session import materialize

BLOCK_IDS = 1 << 16
RUN_BLOCKS = 1024
CHUNK_BYTES = 1 << 20

_FLAT = "file long, block long, ids binary, doc_ids array<long>"
_SUMMARY = "file long, block long, n long, ends long, head long, last long, inner array<long>"


def _flatten(path: str, block_ids: int, end: int):
    def run(batches):
        tokenizer = tokens.load(path, special_as_text=True)
        file = TaskContext.get().partitionId()
        width = block_ids * tokenizer.dtype.itemsize
        held, block = b"", 0

        def batch(blocks: list[bytes], docs):
            nonlocal block
            numbers = list(range(block, block + len(blocks)))
            block += len(blocks)
            rows = len(blocks) + (docs is not None)
            return pa.record_batch(
                [pa.array([file] * rows, pa.int64()), pa.array(numbers + [None] * (docs is not None), pa.int64()),
                 pa.array(blocks + [None] * (docs is not None), pa.binary()),
                 pa.array([None] * len(blocks) + ([docs] if docs is not None else []), pa.list_(pa.int64()))],
                names=["file", "block", "ids", "doc_ids"])

        for b in batches:
            _, offsets = frames.utf8(b.column("text"))
            for i, j in frames.chunks(offsets, CHUNK_BYTES):
                ids, _ = tokenizer.encode(b.column("text").slice(i, j - i).to_pylist(), end)
                held += ids.tobytes()
                whole = len(held) // width
                yield batch([held[k * width:(k + 1) * width] for k in range(whole)],
                            b.column("doc_id").slice(i, j - i).to_pylist())
                held = held[whole * width:]
        if held:
            yield batch([held], None)
        tokenizer.rest()
    return frames.lean(run)


def write_flat(docs: DataFrame, tokenizer: str, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, DataFrame, int, int]:
    """Tokenise ``docs`` into flat files, one per task, kept in the shared
    folder as blocks of ``block_ids`` ids that do not respect documents.

    Returns (blocks, order, end id, bytes per id): blocks is ``file, block,
    ids``; order says which documents went into each file one after the other
    (``file, row, doc_ids``, rows ascending), nothing about where.
    """
    loaded = tokens.load(tokenizer, special_as_text=True)
    end = loaded.tokenizer.token_to_id("<|endoftext|>")
    if end is None:
        raise ValueError("the tokenizer has no end-of-text id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    flat = materialize(rows.mapInArrow(_flatten(tokenizer, block_ids, end), _FLAT)
                       .withColumn("row", F.monotonically_increasing_id()), "token-files")
    return (flat.filter("ids is not null").select("file", "block", "ids"),
            flat.filter("doc_ids is not null").select("file", "row", "doc_ids"), end, loaded.dtype.itemsize)


def _read_ranges(size: int):
    def run(batches):
        from pyarrow import fs
        for batch in batches:
            for path, name, block in zip(*(batch.column(c).to_pylist() for c in ("path", "file", "block"))):
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_file(place) as f:
                    ids = f.read_at(size, block * size)  # the last range of a file is shorter
                yield pa.record_batch([pa.array([name], pa.int64()), pa.array([block], pa.int64()), pa.array([ids], pa.binary())],
                                      names=["file", "block", "ids"])
    return run


def read_flat(spark: SparkSession, path: str, width: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``file, block, ids`` of the raw token files under ``path``, of any size.

    The files are listed with their lengths only and cut into byte ranges of
    ``block_ids`` ids; each range is opened and read at its place by the task
    that needs it, so a large file is read by many tasks and none holds more
    than a range. The store must be one that Arrow opens (file, hdfs, s3, gs).
    Empty files give no blocks, no files no rows; a length that is no multiple
    of ``width`` is an error.
    """
    size = width * block_ids
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    odd = F.when(F.col("length") % width != 0, F.raise_error(F.concat(F.lit("not a token file: "), "path")).cast("long"))
    last = F.coalesce(odd, F.floor((F.col("length") - 1) / size))
    ranges = files.select("path", F.xxhash64("path").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    return ranges.repartition(frames.partitions(files), "path", "block").mapInArrow(
        _read_ranges(size), "file long, block long, ids binary")


def _search(end: int, width: int):
    def run(batches):
        for batch in batches:
            n, ends, head, last, inner = [], [], [], [], []
            for data in batch.column("ids"):
                ids = np.frombuffer(data.as_buffer(), f"<u{width}")
                at = np.flatnonzero(ids == end)
                n.append(len(ids))
                ends.append(len(at))
                head.append(int(at[0]) if len(at) else len(ids))
                last.append(int(at[-1]) if len(at) else None)
                inner.append(np.diff(at) - 1)
            yield pa.record_batch(
                [batch.column("file"), batch.column("block"), pa.array(n, pa.int64()), pa.array(ends, pa.int64()),
                 pa.array(head, pa.int64()), pa.array(last, pa.int64()), pa.array(inner, pa.list_(pa.int64()))],
                names=["file", "block", "n", "ends", "head", "last", "inner"])
    return run


def _before(frame: DataFrame, aggregate, value: str, name: str, run_blocks: int) -> DataFrame:
    """``frame`` (file, run, block, ...) with ``name``: the aggregate of
    ``value`` over all earlier blocks of the file, null for none."""
    inside = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    runs = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    combine = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest}
    function = {"sum": F.sum, "max": F.max}[aggregate]
    totals = (frame.groupBy("file", "run").agg(function(value).alias("__run"))
              .select("file", "run", function("__run").over(runs).alias("__earlier")))
    return (frame.withColumn("__inside", function(value).over(inside)).join(totals, ["file", "run"])
            .withColumn(name, combine[aggregate](F.col("__inside"), F.col("__earlier")))
            .drop("__inside", "__earlier"))


def count_tokens(blocks: DataFrame, end: int, width: int, run_blocks: int = RUN_BLOCKS) -> DataFrame:
    """``file, document, n_tokens`` for the documents of flat token files,
    numbered from 0 in each file; n_tokens is without the end id.

    ``blocks`` is ``file, block, ids`` with blocks numbered 0, 1, 2, ... in
    each file, of any lengths, ids little-endian of ``width`` bytes. Two end
    ids in a row enclose an empty document. Ids after a file's last end id are
    a document if there are any. No blocks give no rows.
    """
    found = materialize(blocks.select("file", "block", "ids").mapInArrow(_search(end, width), _SUMMARY), "token-blocks")
    placed = found.withColumn("run", F.floor(F.col("block") / run_blocks))
    placed = _before(placed, "sum", "n", "begin", run_blocks)
    placed = _before(placed, "sum", "ends", "documents", run_blocks)
    placed = placed.withColumn("last_end", F.col("begin") + F.col("last"))
    placed = materialize(_before(placed, "max", "last_end", "end_before", run_blocks), "token-scan")
    size = placed.groupBy("file").agg(F.max("block").alias("final"))
    carried = F.col("begin") - F.coalesce(F.col("end_before") + 1, F.lit(0))
    rest = F.when(F.col("ends") > 0, F.col("n") - F.col("last") - 1).otherwise(carried + F.col("n"))
    none = F.array().cast("array<bigint>")
    lengths = F.concat(F.when(F.col("ends") > 0, F.array(carried + F.col("head"))).otherwise(none), F.col("inner"),
                       F.when((F.col("block") == F.col("final")) & (rest > 0), F.array(rest)).otherwise(none))
    return (placed.join(size, "file").select("file", "documents", F.posexplode(lengths).alias("k", "n_tokens"))
            .select("file", (F.col("documents") + F.col("k")).alias("document"), "n_tokens"))


def document_token_counts(docs: DataFrame, tokenizer: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``doc_id, n_tokens, file, document`` for every row of ``docs``, counted
    in flat token files that are written first.

    A null or empty text has no tokens. Rows that repeat a doc_id count one by
    one, null ids stay null. An empty table gives no rows; other columns of
    ``docs`` are not read.
    """
    blocks, order, end, width = write_flat(docs, tokenizer, block_ids)
    counts = count_tokens(blocks, end, width)
    # the documents of a file, numbered over the runs in which they were written
    before = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    sizes = order.select("file", "row", F.size("doc_ids").alias("n")).withColumn(
        "first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    names = (order.join(sizes, ["file", "row"]).select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id"))
             .select("file", (F.col("first") + F.col("k")).alias("document"), "doc_id"))
    return names.join(counts, ["file", "document"]).select("doc_id", "n_tokens", "file", "document")
