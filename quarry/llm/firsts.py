"""Which strings of a document also start in a document with a smaller id.

Shared by the two operators that remove repeated passages. Strings are known
by 64-bit hashes, dealt into buckets by a second, independent hash. Three
kinds of tasks exchange packed rows ``(p, kind, blob)``:

* a scan gathers the strings of a batch of documents. A string that a smaller
  document of the batch has is settled there; of each other string only the
  batch's smallest document goes to the string's bucket, so a string that very
  many documents share costs one entry a batch;
* a bucket compares its entries and reports the positions of those that a
  smaller document has, dealt out by document;
* ``with_texts`` brings each document's text together with its positions.

Blobs hold numpy columns; positions are differences, split into byte planes,
which the shuffle's compression shrinks. A document is (doc_id, 64-bit hash of
its text): of n different texts under one id, or without one, about n * n / 2**65
pairs share their reports.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import frames, rolling

ROW = "p int, kind int, blob binary"
TEXT = 9
BATCH_BYTES = 8 << 20
PARTITION_BYTES = 16 << 20
U = np.uint64


def partitions_for(docs: DataFrame) -> int:
    """How many partitions the texts of ``docs`` are dealt out over: one for
    ``PARTITION_BYTES`` of text, at most the session's shuffle width. Every
    task sends a row to every partition, so there should not be more of them
    than the texts need. Costs a scan of the text column."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(1, min(frames.partitions(docs), -(-size // PARTITION_BYTES)))


def planes(a: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as four byte planes."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(4, -1).T).view("<u4")[:, 0]


def differences(pos: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Ascending positions per document as steps; ``first`` are the indexes
    at which a document begins."""
    step = np.diff(pos, prepend=0)
    step[first] = pos[first]
    return step


def positions(step: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.cumsum(step.astype(np.int64))
    return total - np.repeat(total[first] - step[first].astype(np.int64), counts)


def write_blob(ids, tags, doc, pos, *columns: np.ndarray) -> bytes:
    """Entries in order of (doc, pos): the documents, entries per document,
    positions, then the given columns."""
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    counts = np.diff(np.r_[first, len(doc)])
    own = doc[first]
    head = np.array([len(own), len(doc)], "<u4").tobytes()
    return b"".join([head, ids[own].astype("<i8").tobytes(), tags[own].astype("<u8").tobytes(), planes(counts),
                     planes(differences(pos, first)), *[c.tobytes() for c in columns]])


class Blob:
    """The columns of a blob; ``key`` and ``more`` follow the positions of entries."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        docs, n = np.frombuffer(data, "<u4", 2).astype(int).tolist()
        at = 8
        self.ids = raw[at:at + 8 * docs].view("<i8")
        at += 8 * docs
        self.tags = raw[at:at + 8 * docs].view("<u8")
        at += 8 * docs
        self.counts = unplanes(raw[at:at + 4 * docs]).astype(np.int64)
        at += 4 * docs
        first = np.cumsum(self.counts) - self.counts
        self.pos = positions(unplanes(raw[at:at + 4 * n]), first, self.counts)
        self.n = n
        rest = raw[at + 4 * n:]
        half = len(rest) == 12 * n  # 32 bits of the key before a further column
        self.key = rest[:4 * n].view("<u4") if half else rest[:8 * n].view("<u8")
        self.more = rest[4 * n:].copy().view("<u8") if half else rest[:0].view("<u8")


def row(p: int, kind: int, blob: bytes) -> tuple[int, int, bytes]:
    return int(p), kind, blob


def to_batches(rows: Iterator[tuple[int, int, bytes]], most: int = 8 << 20):
    """Arrow batches of up to ``most`` bytes of the rows."""
    held: list = []
    size = 0

    def batch():
        p, kind, blob = zip(*held)
        return pa.record_batch([pa.array(p, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())],
                               names=["p", "kind", "blob"])

    for r in rows:
        held.append(r)
        size += len(r[2])
        if size >= most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def home(ids: np.ndarray, tags: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each document."""
    known = rolling.mix(ids.astype(np.int64).view(U) + U(0x51ED270B))
    return (rolling.mix(known + tags.astype(U)) % U(parts)).astype(np.int64)


def flags(ids, tags, doc, pos, parts: int, kind: int):
    """Rows that report entries (in order of (doc, pos)) to their documents'
    partitions."""
    if not len(doc):
        return
    to = home(ids, tags, parts)[doc]
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(to[order]) > 0])
    for a, b in zip(cuts, np.r_[cuts[1:], len(order)]):
        part = order[a:b]
        yield row(to[part[0]], kind, write_blob(ids, tags, doc[part], pos[part]))


class Batch:
    """Entries of a batch of documents, added in order of (doc, pos)."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.tags: list[np.ndarray] = []
        self.docs = 0
        self.bytes = 0
        self.columns: list[tuple] = []

    def add_docs(self, ids: np.ndarray, tags: np.ndarray, size: int) -> int:
        """Returns the number of the first of these documents."""
        before = self.docs
        self.ids.append(ids)
        self.tags.append(tags)
        self.docs += len(ids)
        self.bytes += size
        return before

    def add(self, doc, pos, key, spread, *more) -> None:
        self.columns.append((doc.astype(np.int32), pos.astype(np.int32), key,
                             (spread >> U(32)).astype(np.uint32), *more))

    def rows(self, buckets: int, parts: int, settled: int):
        """Entries for the buckets, and reports of kind ``settled``. Entries
        are equal if key and further columns are."""
        if not self.columns:
            return
        ids, tags = np.concatenate(self.ids), np.concatenate(self.tags)
        doc, pos, key, spread, *more = (np.concatenate(c) for c in zip(*self.columns))
        same = key
        for c in more:
            same = rolling.mix(same + c)
        rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)[doc]
        order = np.argsort(same, kind="stable")
        new = np.r_[True, np.zeros(len(order) - 1, bool)]
        for c in (key, *more):
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
        least = np.minimum.reduceat(rank[order], np.flatnonzero(new))
        later = np.empty(len(same), bool)
        later[order] = rank[order] > least[np.cumsum(new) - 1]
        known = np.flatnonzero(later)
        yield from flags(ids, tags, doc[known], pos[known], parts, settled)
        send = np.flatnonzero(~later)
        to = spread[send] % np.uint32(buckets)
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(to[order]) > 0])
        for a, b in zip(cuts, np.r_[cuts[1:], len(order)]):
            part = send[order[a:b]]
            # beside a further column the key only groups: half of it will do,
            # as a chance meeting there costs work, not correctness
            yield row(to[order[a]], ENTRIES, write_blob(
                ids, tags, doc[part], pos[part], key[part].astype("<u4" if more else "<u8"),
                *[c[part].astype("<u8") for c in more]))


ENTRIES = 8


def buckets(rows: DataFrame, parts: int, judge: Callable, homes: int) -> DataFrame:
    """Deal ``rows`` out by bucket and judge each bucket; reports pass
    through. ``judge(key, ids, more)`` gives pairs (kind, mask) of entries to
    report; more holds the further 64-bit column, if any."""
    def run(batches):
        found = defaultdict(list)

        def passed():
            for batch in batches:
                for p, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("p", "kind", "blob"))):
                    if kind == ENTRIES:
                        found[p].append(blob)
                    else:
                        yield p, kind, blob
            for p in sorted(found):
                blobs = [Blob(b) for b in found.pop(p)]
                ids = np.concatenate([b.ids for b in blobs])
                tags = np.concatenate([b.tags for b in blobs])
                counts = np.concatenate([b.counts for b in blobs])
                doc = np.repeat(np.arange(len(ids)), counts)
                pos = np.concatenate([b.pos for b in blobs])
                key = np.concatenate([b.key for b in blobs])
                more = np.concatenate([b.more for b in blobs])
                for kind, mask in judge(key, ids[doc], more if len(more) else None):
                    at = np.flatnonzero(mask)
                    yield from flags(ids, tags, doc[at], pos[at], homes, kind)

        yield from to_batches(passed())

    return deal(rows, parts).mapInArrow(frames.lean(run), ROW)


def deal(rows: DataFrame, parts: int) -> DataFrame:
    """Rows to the partition whose number is p modulo ``parts``."""
    return rows.repartitionById(parts, F.pmod("p", F.lit(parts)).cast("int"))


def seen_before(kind: int) -> Callable:
    """Judge: entries whose key a smaller id has."""
    def judge(key, ids, _):
        order = np.argsort(key, kind="stable")
        new = np.r_[True, key[order][1:] != key[order][:-1]]
        least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
        mask = np.empty(len(key), bool)
        mask[order] = ids[order] > least[np.cumsum(new) - 1]
        return [(kind, mask)]
    return judge


def _texts(parts: int):
    def run(batches):
        def rows():
            for batch in batches:
                raw, offsets = frames.utf8(batch.column("text"))
                ids = batch.column("doc_id").to_numpy()
                tags = batch.column("tag").to_numpy().view(U)
                for i, j in frames.chunks(offsets, BATCH_BYTES):
                    to = home(ids[i:j], tags[i:j], parts)
                    order = np.argsort(to, kind="stable")
                    cuts = np.flatnonzero(np.r_[True, np.diff(to[order]) > 0])
                    for a, b in zip(cuts, np.r_[cuts[1:], len(order)]):
                        part = order[a:b] + i
                        size = offsets[part + 1] - offsets[part]
                        head = np.array([len(part)], "<u4").tobytes()
                        data = b"".join([head, ids[part].astype("<i8").tobytes(), tags[part].astype("<u8").tobytes(),
                                         size.astype("<i8").tobytes(),
                                         *[raw[offsets[k]:offsets[k + 1]].tobytes() for k in part]])
                        yield row(to[order[a]], TEXT,
                                  np.array([len(data)], "<i8").tobytes() + pa.compress(data, "zstd", asbytes=True))
        yield from to_batches(rows())
    return run


def with_texts(docs: DataFrame, reports: DataFrame, parts: int, work: Callable, schema: str) -> DataFrame:
    """``work(groups)`` over every partition of documents, where groups yields
    (ids, tags, raw, offsets, found) and found maps (doc_id, tag) to
    {kind: positions}. ``docs`` is keyed; texts travel compressed."""
    def run(batches):
        found: dict = defaultdict(lambda: defaultdict(list))

        def groups():
            # reports sort before texts
            for batch in batches:
                for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist()):
                    if kind != TEXT:
                        b = Blob(blob)
                        for i, t, part in zip(b.ids.tolist(), b.tags.tolist(),
                                              np.split(b.pos, np.cumsum(b.counts)[:-1])):
                            found[i, t][kind].append(part)
                        continue
                    size = int(np.frombuffer(blob, "<i8", 1)[0])
                    data = pa.decompress(blob[8:], size, "zstd", asbytes=True)
                    n = int(np.frombuffer(data, "<u4", 1)[0])
                    ids = np.frombuffer(data, "<i8", n, 4)
                    tags = np.frombuffer(data, "<u8", n, 4 + 8 * n)
                    sizes = np.frombuffer(data, "<i8", n, 4 + 16 * n)
                    raw = np.frombuffer(data, np.uint8, offset=4 + 24 * n)
                    yield ids, tags, raw, np.concatenate([[0], np.cumsum(sizes)]), found
        yield from work(groups())

    texts = docs.mapInArrow(frames.lean(_texts(parts)), ROW)
    return (deal(texts.unionByName(reports), parts).sortWithinPartitions("kind")
            .mapInArrow(frames.lean(run), schema))


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Mask of n places that windows of ``width`` from ``starts`` cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0
