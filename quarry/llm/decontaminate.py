"""Benchmark decontamination by winnowing.

Words are hashed, k consecutive words make a gram, and of every window of w
consecutive grams the least hash is kept as a fingerprint. A shared passage of
k + w - 1 words or more contains a whole window, and the window's content
alone decides what is kept, so both sides keep the same gram of it: no shared
passage of that length is missed. Fingerprints of documents and benchmark
items are joined, and every hit is extended word by word on both sides to the
shared run. Items shorter than that length are looked up by their whole word
sequence (grams of that many words, windows of one gram).

Scale. One pass over the texts. What leaves it are the fingerprints that pass
a Bloom filter of the benchmark's, with the few words around each; the filter
has a fixed number of bits, whatever the size of the benchmark. The join picks
broadcast or shuffle by the stored size of the benchmark's fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import frames, rolling
from quarry.session import materialize

WINDOW_WORDS = 10
GRAM_WORDS = 5
FILTER_BITS = 1 << 22
CHUNK_BYTES = 1 << 19

# Word bytes are 0-9, a-z (A-Z lower-cased) and all above 127.
LOWERED = np.zeros(256, np.uint8)
LOWERED[48:58] = np.arange(48, 58)
LOWERED[97:123] = np.arange(97, 123)
LOWERED[65:91] = np.arange(97, 123)
LOWERED[128:] = np.arange(128, 256)

_ANCHORS = "array<struct<cls:int,h:long,pos:array<int>,lead:int,ctx:binary>>"


class Words:
    """The words of some texts: their bytes, bounds, text and hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        low = LOWERED[raw]
        inside = low > 0
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.bounds)
        self.text = np.repeat(np.arange(len(self.count)), self.count)
        self.data = low.tobytes()
        values = rolling.Slices(rolling.byte_values(low)).of(self.start, self.end)
        self.grams = rolling.Slices(values)

    def whole(self, width: int) -> np.ndarray:
        """Which windows of ``width`` words lie in one text, by start."""
        n = len(self.text) - width + 1
        return self.text[:n] == self.text[width - 1:] if n > 0 else np.zeros(0, bool)

    def join(self, i: int, j: int) -> bytes:
        return b" ".join([self.data[a:b] for a, b in zip(self.start[i:j].tolist(), self.end[i:j].tolist())])


def _fingerprints(words: Words, window: int, gram: int):
    """(hash, position) of the grams that winnowing keeps."""
    valid = words.whole(window)
    if not valid.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words.grams.every(gram)
    keep = np.flatnonzero(rolling.selected(h, valid, window - gram + 1))
    return h[keep], keep


def _in_filter(bits: np.ndarray | None, h: np.ndarray, cls: int) -> np.ndarray:
    if bits is None:
        return np.ones(len(h), bool)
    out = np.ones(len(h), bool)
    size = np.uint64(len(bits) * 64)
    for probe in (0, 32):
        at = ((h >> np.uint64(probe)) + np.uint64(cls)) % size
        out &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    return out


def _anchors(words: Words, window: int, gram: int, shorts: list[int], bits, item: bool):
    """Per text: the fingerprints with the words that a window around them can
    reach, as dicts of the output struct."""
    out: list[dict] = [{} for _ in words.count]

    def add(cls, h, at, reach, width):
        for value, p in zip(h.view(np.int64).tolist(), at.tolist()):
            t = int(words.text[p])
            i = max(int(words.bounds[t]), p - reach)
            j = min(int(words.bounds[t + 1]), p + width + reach)
            key = (cls, value, p - i, words.join(i, j))
            out[t].setdefault(key, []).append(p - int(words.bounds[t]))

    h, at = _fingerprints(words, window, gram)
    keep = _in_filter(bits, h, 0)
    add(0, h[keep], at[keep], window - gram, gram)
    for width in shorts:
        valid = words.whole(width)
        if item:
            valid = valid & (words.count[words.text[:len(valid)]] == width)
        at = np.flatnonzero(valid)
        h = words.grams.every(width)[at] if len(at) else np.zeros(0, np.uint64)
        keep = _in_filter(bits, h, width)
        add(width, h[keep], at[keep], 0, width)
    return [[{"cls": c, "h": v, "pos": pos, "lead": lead, "ctx": ctx}
             for (c, v, lead, ctx), pos in found.items()] for found in out]


def _scan(id_names: list[str], window: int, gram: int, shorts: list[int], bits, item: bool):
    anchors_type = pa.list_(pa.struct([("cls", pa.int32()), ("h", pa.int64()), ("pos", pa.list_(pa.int32())),
                                       ("lead", pa.int32()), ("ctx", pa.binary())]))

    def scan(batches):
        table = None if bits is None else bits.value
        for batch in batches:
            raw, offsets = frames.utf8(batch.column("text"))
            for i, j in frames.chunks(offsets, CHUNK_BYTES):
                words = Words(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                found = _anchors(words, window, gram, shorts, table, item)
                yield pa.record_batch(
                    [batch.column(c).slice(i, j - i) for c in id_names]
                    + [pa.array(words.count.astype(np.int64)), pa.array(found, anchors_type)],
                    names=[*id_names, "n_words", "anchors"])
    return frames.lean(scan)


def _bloom(anchors: DataFrame, bits: int) -> np.ndarray:
    """Bloom filter words of the anchors' hashes, made by an aggregate: the
    driver receives at most bits / 64 rows."""
    h, size = F.col("h"), F.lit(bits)
    # the hash as an unsigned number modulo the (power of two) size
    low = F.pmod(F.pmod(h, size) + F.col("cls"), size)
    high = F.pmod(F.shiftrightunsigned(h, 32) + F.col("cls"), size)
    one = F.lit(1).cast("long")
    rows = (anchors.select(F.explode(F.array(low, high)).alias("at"))
            .groupBy(F.shiftright("at", 6).alias("word"))
            .agg(F.bit_or(F.call_function("shiftleft", one, F.col("at").bitwiseAND(63).cast("int"))).alias("set"))
            .collect())
    out = np.zeros(bits // 64, np.uint64)
    for r in rows:
        out[r["word"]] = np.uint64(r["set"] & ((1 << 64) - 1))
    return out


def shared_run(a: list[bytes], i: int, b: list[bytes], j: int, gram: int) -> tuple[int, int]:
    """(words before, words in all) of the run that a and b share around the
    gram at i in a and j in b; (0, 0) if the gram differs."""
    if a[i:i + gram] != b[j:j + gram]:
        return 0, 0
    left, right = 0, gram
    while left < i and left < j and a[i - left - 1] == b[j - left - 1]:
        left += 1
    while i + right < len(a) and j + right < len(b) and a[i + right] == b[j + right]:
        right += 1
    return left, left + right


def _extend(window: int, gram: int):
    def extend(batches):
        for batch in batches:
            rows = []
            known: dict[tuple, tuple[int, int]] = {}
            for r in batch.to_pylist():
                if r["cls"]:
                    left, length = (0, r["cls"]) if r["ctx"] == r["item_ctx"] else (0, 0)
                else:
                    key = (r["ctx"], r["lead"], r["item_ctx"], r["item_lead"])
                    if key not in known:
                        known[key] = shared_run(r["ctx"].split(b" "), r["lead"],
                                                r["item_ctx"].split(b" "), r["item_lead"], gram)
                    left, length = known[key]
                if length >= (r["cls"] or window):
                    rows += [(r["doc_id"], r["tag"], r["item_id"], p - left, p - left + length)
                             for p in r["pos"]]
            if rows:
                cols = list(zip(*rows))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (
                    pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                    names=["doc_id", "tag", "item_id", "start", "end"])
    return frames.lean(extend)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS,
                  gram: int = GRAM_WORDS, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): ``doc_id, tag, n_words`` per row of ``docs`` and
    ``doc_id, tag, item_id, start, end`` of shared word runs. A null doc_id is
    ``frames.HIGHEST``."""
    if not 1 <= gram < window or filter_bits & (filter_bits - 1):
        raise ValueError("needs gram < window and a power of two of filter bits")
    spark = docs.sparkSession
    # lengths of items under the window: at most window - 1 of them
    every_short = list(range(1, window))
    item_rows = items.select(F.col("item_id").cast("long").alias("item_id"),
                             F.coalesce("text", F.lit("")).alias("text"))
    item_anchors = materialize(
        item_rows.mapInArrow(_scan(["item_id"], window, gram, every_short, None, True),
                             f"item_id long, n_words long, anchors {_ANCHORS}")
        .select("item_id", F.explode("anchors").alias("a"))
        .select("item_id", "a.cls", "a.h", F.col("a.lead").alias("item_lead"),
                F.col("a.ctx").alias("item_ctx")).distinct(), "benchmark-fingerprints")
    shorts = [r[0] for r in item_anchors.filter("cls > 0").select("cls").distinct().collect()]
    bits = spark.sparkContext.broadcast(_bloom(item_anchors, filter_bits))
    scanned = materialize(
        frames.keyed(docs, frames.HIGHEST).mapInArrow(
            _scan(["doc_id", "tag"], window, gram, sorted(shorts), bits, False),
            f"doc_id long, tag long, n_words long, anchors {_ANCHORS}"), "document-fingerprints")
    hits = (scanned.select("doc_id", "tag", F.explode("anchors").alias("a"))
            .select("doc_id", "tag", "a.*").join(item_anchors, ["cls", "h"])
            .select("doc_id", "tag", "cls", "pos", "lead", "ctx", "item_id", "item_lead", "item_ctx"))
    spans = hits.mapInArrow(_extend(window, gram), "doc_id long, tag long, item_id long, start int, end int")
    return scanned.select("doc_id", "tag", "n_words"), spans


def _by_document(spans: DataFrame) -> DataFrame:
    covered = F.aggregate(
        F.sort_array(F.collect_set(F.struct("start", "end"))),
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda at, s: F.struct(
            F.greatest(at["upto"], s["end"]).alias("upto"),
            (at["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(at["upto"], s["start"]))).alias("n")))
    names = F.array_sort(F.transform(F.collect_set("item_id"), lambda x: x.cast("string")))
    return spans.groupBy("doc_id", "tag").agg(covered["n"].alias("n_hit"), names.alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS,
                  gram: int = GRAM_WORDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``doc_id, n_words, n_hit, items, contaminated`` for every row of
    ``docs``: its words, those inside an occurrence of a benchmark window, and
    the ids of the items concerned (sorted as strings).

    Null texts have no words; items without words have no windows. Rows that
    repeat a doc_id are judged by their own text. An item without an id marks
    words but is not listed. Empty tables on either side give no hits.
    """
    texts, spans = contamination(docs, items, window, gram, filter_bits)
    found = _by_document(spans)
    none = F.array().cast("array<string>")
    return texts.join(found, ["doc_id", "tag"], "left").select(
        frames.restore_null(frames.HIGHEST), "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that share a window with ``items``, with all
    columns, whatever their names. Null texts and rows without words stay."""
    _, spans = contamination(docs, items)
    hit = materialize(spans.select("doc_id", "tag").distinct(), "contaminated")
    left = frames.rows_by_key(docs, frames.HIGHEST)
    return frames.whole_rows(left.join(hit, ["doc_id", "tag"], "left_anti"), docs)
