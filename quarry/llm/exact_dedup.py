"""Exact deduplication by deterministic block naming.

Each text is cut into blocks of a fixed number of bytes. Spark sorts the
blocks and gives equal blocks one integer name, different blocks different
names. Adjacent names are then named in pairs, round after round, until every
document has one name: two documents have the same (round, name) exactly when
their texts are equal. No hash of a text decides anything.

Scale. Equal blocks of a batch of documents are merged before the shuffle, so
a block that very many documents share reaches its partition once per batch.
The text is shuffled once; the rounds move integers only and halve each time.
A document's row key is (doc_id, 64-bit text hash), see ``frames``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import frames
from quarry.session import materialize

BLOCK_BYTES = 4096
BATCH_BYTES = 8 << 20

_BLOCKS = "block binary, doc_id array<long>, tag array<long>, pos array<int>, n array<int>, sha array<binary>"
_NAMED = "doc_id long, tag long, pos int, n int, sha binary, name long"


def _cut(block_bytes: int):
    def cut(batches):
        for batch in batches:
            raw, offsets = frames.utf8(pc.ascii_lower(batch.column("text")))
            ids, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
            data = memoryview(raw)
            for i, j in frames.chunks(offsets, BATCH_BYTES):
                found: dict[bytes, list] = {}
                for row in range(i, j):
                    a, b = int(offsets[row]), int(offsets[row + 1])
                    n = max(1, -(-(b - a) // block_bytes))
                    sha = hashlib.sha256(data[a:b]).digest()
                    for k in range(n):
                        block = bytes(data[a + k * block_bytes:min(b, a + (k + 1) * block_bytes)])
                        found.setdefault(block, []).append(
                            (int(ids[row]), int(tags[row]), k, n, sha if k == 0 else None))
                if found:
                    cols = [list(zip(*seen)) for seen in found.values()]
                    yield pa.record_batch(
                        [pa.array(list(found), pa.binary())]
                        + [pa.array([c[k] for c in cols], pa.list_(t)) for k, t in enumerate(
                            (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                        names=["block", "doc_id", "tag", "pos", "n", "sha"])
    return frames.lean(cut)


def _name(batches):
    """Rows of one partition, sorted by block: each new block gets the next
    number of this partition."""
    number, last = TaskContext.get().partitionId() << 33, None
    for batch in batches:
        blocks = batch.column("block")
        names = np.empty(len(blocks), np.int64)
        for i, block in enumerate(blocks.to_pylist()):
            if block != last:
                number, last = number + 1, block
            names[i] = number
        lists = [batch.column(c) for c in ("doc_id", "tag", "pos", "n", "sha")]
        name = pa.array(names).take(pc.list_parent_indices(lists[0]))
        yield pa.record_batch([x.flatten() for x in lists] + [name],
                              names=["doc_id", "tag", "pos", "n", "sha", "name"])


def name_texts(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per distinct (doc_id, tag): ``doc_id, tag, rows, sha, level,
    name``. Texts are equal (A-Z lower-cased) exactly when (level, name) are;
    ``rows`` counts the input rows, ``sha`` is the SHA-256 of the text.
    A null id is ``frames.LOWEST``, a null text the empty one.
    """
    parts = frames.partitions(docs)
    blocks = frames.keyed(docs, frames.LOWEST).mapInArrow(_cut(block_bytes), _BLOCKS)
    named = materialize(
        blocks.repartition(parts, "block").sortWithinPartitions("block")
              .mapInArrow(_name, _NAMED), "block-names")
    heads = (named.filter("pos = 0").groupBy("doc_id", "tag", "n")
             .agg(F.count(F.lit(1)).alias("rows"), F.max("sha").alias("sha"),
                  F.max("name").alias("name")))
    done = [heads.filter("n = 1").select("doc_id", "tag", F.lit(0).alias("level"), "name")]
    longest = named.agg(F.max("n")).first()[0] or 1
    now, level = named.filter("n > 1").select("doc_id", "tag", "pos", "n", "name"), 0
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        left = F.max(F.when(F.col("pos") % 2 == 0, F.col("name")))
        right = F.max(F.when(F.col("pos") % 2 == 1, F.col("name")))
        pairs = materialize(
            now.groupBy("doc_id", "tag", ((F.col("n") + 1) / 2).cast("int").alias("n"),
                        F.floor(F.col("pos") / 2).cast("int").alias("pos"))
               .agg(left.alias("a"), F.coalesce(right, F.lit(-1)).alias("b")), "block-pairs")
        names = (pairs.select("a", "b").distinct().sortWithinPartitions("a", "b")
                 .withColumn("name", F.monotonically_increasing_id()))
        now = materialize(pairs.join(names, ["a", "b"]).drop("a", "b"), "pair-names")
        done.append(now.filter("n = 1").select("doc_id", "tag", F.lit(level).alias("level"), "name"))
        now = now.filter("n > 1")
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return heads.drop("name", "n").join(every, ["doc_id", "tag"])


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, tag, rows, sha, keep_id, keep_tag, group_size`` per distinct
    (doc_id, tag): the row that stays in its group of equal texts (of the
    largest id, a null id being the smallest, and among texts that differ in
    case under that id of the largest tag) and the rows of the group."""
    named = materialize(name_texts(docs, block_bytes), "text-names")
    # a table of its own, so that the join can split the rows of a large group
    groups = materialize(named.groupBy("level", "name").agg(
        F.max(F.struct("doc_id", "tag")).alias("keep"), F.sum("rows").alias("group_size")).select(
            "level", "name", F.col("keep.doc_id").alias("keep_id"), F.col("keep.tag").alias("keep_tag"),
            "group_size"), "text-groups")
    return named.join(groups, ["level", "name"]).drop("level", "name")


def _stays():
    return (F.col("doc_id") == F.col("keep_id")) & (F.col("tag") == F.col("keep_tag"))


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The decision for every row of ``docs`` (doc_id, text, ...).

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row per
    input row. Null text counts as empty. Of rows that repeat both id and
    text, whatever its case, one is kept. Null ids group like others; one is kept only where the
    whole group has none. An empty table gives no rows; other columns of
    ``docs`` are not used.
    """
    g = exact_groups(docs, block_bytes)
    copy = F.posexplode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("copy", "_")
    return g.select("doc_id", _stays().alias("stays"), "keep_id", "group_size", "sha", copy).select(
        frames.restore_null(frames.LOWEST),
        frames.restore_null(frames.LOWEST, "keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("stays") & (F.col("copy") == 0)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` does not keep, with all
    columns, whatever their names. Nulls and empty tables as there."""
    kept = exact_groups(docs, block_bytes).filter(_stays())
    return frames.keep_rows(docs, kept, frames.LOWEST)
