"""SimHash near-duplicate linking with pigeonring filtering.

A document's fingerprint has 64 bits; bit b is 1 if it is set in over half of
the XXH64 hashes of the document's shingles. Fingerprints that differ in at
most ``distance`` bits link, and the connected components of the links are the
groups.

Candidates. The 64 bits form a ring of segments. If the whole ring has at most
t differences on m segments, some start has every chain of l segments from it
within l * t / m differences (pigeonring). For the segments that the chain's
budget leaves no difference Spark joins on equal bits; where the next two
segments may share one difference, one of the two is equal, which gives two
join keys per start. The pairs that meet are pruned by all chain budgets and
then by the full Hamming distance.

Hot buckets. Exact copies meet as one fingerprint. A bucket with more than
``bucket_limit`` distinct fingerprints is not paired: its fingerprints are
linked through the points of the Hamming cube around them, which is exact too
(see ``ball_links``), linear, and bounded at 65 fingerprints a point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import frames
from quarry.llm.components import components
from quarry.llm.xxh import xxh64
from quarry.session import materialize

SEGMENTS = 5
BUCKET_LIMIT = 64
CHUNK_BYTES = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def fingerprints_of(raw: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """Fingerprints (uint64) of the texts in ``raw``, A-Z already lower."""
    docs = len(offsets) - 1
    space = SPACE[raw]
    inside = ~space
    # one space after each word, words of one text next to each other
    starts_text = np.zeros(len(raw) + 1, bool)
    starts_text[offsets[:-1]] = True
    before = np.ones(len(raw), bool)
    before[1:] = space[:-1]
    first = np.flatnonzero(inside & (before | starts_text[:-1]))
    last = np.ones(len(raw), bool)
    last[:-1] = space[1:]
    last |= starts_text[1:]
    ends = np.flatnonzero(inside & last) + 1
    bits = np.zeros(docs, np.uint64)
    if not len(first):
        return bits
    lengths = ends - first
    place = np.zeros(len(first) + 1, np.int64)
    np.cumsum(lengths + 1, out=place[1:])
    packed = np.full(int(place[-1]) + 8, 32, np.uint8)
    packed[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(first)), lengths)] = raw[inside]
    words = np.searchsorted(first, offsets)  # words before each text
    n = np.diff(words)
    shingles = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    total = np.zeros(docs + 1, np.int64)
    np.cumsum(shingles, out=total[1:])
    doc = np.repeat(np.arange(docs), shingles)
    at = words[:-1][doc] + np.arange(total[-1]) - total[:-1][doc]
    end = at + np.minimum(shingle, n)[doc]
    h = xxh64(packed, place[at], place[end] - 1 - place[at], 42)
    some = np.flatnonzero(shingles)
    for low in range(0, 64, 8):
        byte = ((h >> np.uint64(low)) & np.uint64(255)).astype(np.uint8)
        ones = np.add.reduceat(np.unpackbits(byte[:, None], axis=1, bitorder="little"),
                               total[:-1][some], axis=0, dtype=np.int64)
        is_set = 2 * ones > shingles[some][:, None]
        packed8 = np.packbits(is_set, axis=1, bitorder="little")[:, 0]
        bits[some] |= packed8.astype(np.uint64) << np.uint64(low)
    return bits


def _fingerprint(shingle: int):
    def run(batches):
        import pyarrow.compute as pc
        for batch in batches:
            raw, offsets = frames.utf8(pc.ascii_lower(batch.column("text")))
            out = np.zeros(len(offsets) - 1, np.uint64)
            for i, j in frames.chunks(offsets, CHUNK_BYTES):
                out[i:j] = fingerprints_of(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], shingle)
            yield pa.record_batch([batch.column("doc_id"), batch.column("tag"),
                                   pa.array(out.view(np.int64))], names=["doc_id", "tag", "fp"])
    return frames.lean(run)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, tag, fp`` per row; fp is the fingerprint as a signed long."""
    return frames.keyed(docs, frames.HIGHEST).mapInArrow(
        _fingerprint(shingle), "doc_id long, tag long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def segment_masks(segments: int) -> list[int]:
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]


def join_masks(segments: int, distance: int) -> list[int]:
    """Bits on which two fingerprints within ``distance`` agree for at least
    one of the masks: from each start the segments without a budget, and,
    where the chain's next two may differ in one bit, either of the two."""
    seg = segment_masks(segments)
    budget = [(length * distance) // segments for length in range(segments + 1)]
    free = max(length for length in range(segments + 1) if budget[length] == 0)
    masks = []
    for start in range(segments):
        fixed = 0
        for k in range(free):
            fixed |= seg[(start + k) % segments]
        if free + 2 <= segments and budget[free + 2] == 1:
            masks += [fixed | seg[(start + free) % segments],
                      fixed | seg[(start + free + 1) % segments]]
        else:
            masks.append(fixed)
    return sorted(set(masks))


def pigeonring(a: Column, b: Column, segments: int, distance: int) -> Column:
    """Whether some start keeps every chain within its budget."""
    diff = a.bitwiseXOR(b)
    x = [F.bit_count(diff.bitwiseAND(F.lit(_signed(m)))) for m in segment_masks(segments)]
    viable = None
    for start in range(segments):
        total, ok = None, None
        for k in range(segments):
            step = x[(start + k) % segments]
            total = step if total is None else total + step
            c = total <= F.lit(((k + 1) * distance) // segments)
            ok = c if ok is None else ok & c
        viable = ok if viable is None else viable | ok
    return viable


def _flips() -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(63)),
                       lambda i: F.col("fp").bitwiseXOR(
                           F.call_function("shiftleft", F.lit(1).cast("long"), i)))


def ball_links(fps: DataFrame, distance: int) -> DataFrame:
    """``a, b`` links whose components are those of all pairs within
    ``distance`` (at most 2), without pairing a bucket.

    Two fingerprints are within two bits exactly when a point of the cube is
    within one bit of both. Each fingerprint visits its 65 points; those that
    meet at a point link to the least of them. Within one bit, one of the two
    is a neighbour of the other.
    """
    if distance == 1:
        near = fps.select("fp", F.explode(_flips()).alias("point"))
        return (near.join(fps.select(F.col("fp").alias("point")), "point")
                .filter("fp > point").select(F.col("fp").alias("a"), F.col("point").alias("b")))
    points = fps.select("fp", F.explode(F.concat(F.array("fp"), _flips())).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("most"))
    return (points.join(least.filter("b < most"), "point").filter("fp > b")
            .select(F.col("fp").alias("a"), "b").distinct())


def links(fps: DataFrame, distance: int = 2, segments: int = SEGMENTS,
          bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``a, b`` links over distinct fingerprints ``fp``; their components are
    those of all pairs within ``distance`` (1 or 2)."""
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2: large buckets are linked exactly only so far")
    masks = join_masks(segments, distance)
    keys = F.array(*[F.struct(F.lit(i).alias("mask"),
                              F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                     for i, m in enumerate(masks)])
    dealt = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.mask", "k.key")
    sizes = dealt.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = materialize(dealt.join(sizes, ["mask", "key"]), "simhash-buckets")
    small = met.filter(F.col("n") <= bucket_limit)
    a, b = small.select("mask", "key", F.col("fp").alias("a")), small.select("mask", "key", F.col("fp").alias("b"))
    pairs = (a.join(b, ["mask", "key"]).filter("a > b")
             .filter(pigeonring(F.col("a"), F.col("b"), segments, distance))
             .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
             .select("a", "b").distinct())
    large = met.filter(F.col("n") > bucket_limit).select("fp").distinct()
    return pairs.unionByName(ball_links(large, distance))


def near_groups(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """``doc_id, tag, fp, component_id, first_tag`` per row: the smallest id
    reachable over links, and the tag of the row that holds it (the least,
    where rows repeat that id)."""
    fps = materialize(fingerprints(docs, shingle), "simhash")
    nodes = fps.groupBy("fp").agg(F.min(F.struct("doc_id", "tag")).alias("first"))
    nodes = materialize(nodes, "simhash-nodes")
    joined = components(links(nodes.select("fp"), distance))  # node, root; linked nodes only
    rooted = (nodes.join(joined, nodes["fp"] == joined["node"], "left")
              .select("fp", F.coalesce("root", "fp").alias("root"), "first"))
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    where = rooted.join(best, "root").select("fp", F.col("best.doc_id").alias("component_id"),
                                             F.col("best.tag").alias("first_tag"))
    return fps.join(where, "fp")


def simhash_dedup(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer
    words than a shingle is one shingle, a text without words (null too) has
    fingerprint zero and links like any other. Repeated rows give repeated
    results. A null id counts as the largest and comes back as null. An empty
    table gives no rows; other columns of ``docs`` are not read.
    """
    return near_groups(docs, shingle, distance).select(
        frames.restore_null(frames.HIGHEST),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        frames.restore_null(frames.HIGHEST, "component_id"))


def drop_near_copies(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """``docs`` with one row of each group, the one with the smallest id, and
    all columns, whatever their names. Nulls, repeated rows and empty tables as
    in ``simhash_dedup``; of repeated rows one stays."""
    firsts = near_groups(docs, shingle, distance).filter(
        "doc_id = component_id and tag = first_tag")
    return frames.keep_rows(docs, firsts, frames.HIGHEST)
