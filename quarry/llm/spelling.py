"""Spelling variant grouping by dense prefix-suffix tiling.

Words are the runs of Latin letters of all texts. Two words are near if one
inserted, deleted or replaced code point makes one of the other, that is if
they differ and their common prefix and suffix together reach the longer
length minus one.

Tiling. The words of a partition are sorted and cut into blocks; a block is a
matrix of code points, a row a word, padded with zeros, once from the left and
once from the right. A pair of blocks is compared whole: the lengths of common
prefix and suffix of all its pairs of rows are counted in numpy, and only near
pairs leave the task. Which blocks meet follows from where an edit can lie:
of a pair with longer length m, either the first m // 2 code points agree or
the last m - m // 2 do (an edit before place m // 2 leaves that ending whole).
So a word is sent, for m its own length and one more, under both of these
keys, and blocks are compared where they hold the same key; a pair found by its
ending counts only if its beginnings differ, so that each pair is found once.

Hot keys. The rows of a key above ``GROUP_ROWS`` are dealt to numbered parts by
a hash, and every pair of parts is a tile of its own with a partition key of
its own; the rows are sent to the tiles of their part. No tile holds more than
about two parts, however many words share a key; the number of a key's tiles
grows with the square of its parts.

Scale. Occurrences are counted per task before they are shuffled, so a hot word
moves once a flush. Only words that pass ``least_count`` meet in tiles.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import frames
from quarry.session import materialize

FLUSH_WORDS = 100_000
CHUNK_BYTES = 1 << 20
BLOCK_ROWS = 128
GROUP_ROWS = 2048
ROUNDS = 64


def drop_point(word: str, doc_id: int | None) -> str:
    """The contract's input: in one of 199 (document, word) pairs, chosen by
    CRC-32 of ``<doc_id>:<word>``, one code point goes. A null id is empty."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % 199:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1:]


def _count(least_points: int, alter):
    def run(batches):
        letters = re.compile("[a-zÀ-ÿ]{%d,}" % least_points)
        seen: dict[str, int] = {}

        def flush():
            out = pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                  names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            texts = pc.ascii_lower(batch.column("text"))
            ids = batch.column("doc_id")
            for i in range(len(batch)):
                text = texts[i].as_py()
                if not text:
                    continue
                own: dict[str, int] = {}
                for m in letters.finditer(text):  # a run at a time: long texts need no list of all
                    w = m.group()
                    own[w] = own.get(w, 0) + 1
                doc_id = ids[i].as_py()
                for w, n in own.items():
                    if alter is not None:
                        w = alter(w, doc_id)
                        if len(w) < least_points:
                            continue
                    seen[w] = seen.get(w, 0) + n
                if len(seen) >= FLUSH_WORDS:
                    yield flush()
        if seen:
            yield flush()
    return frames.lean(run)


def word_counts(docs: DataFrame, least_points: int = 6, alter=None) -> DataFrame:
    """``word, n``: occurrences over all texts of every run of
    ``[A-Za-z\\u00C0-\\u00FF]`` of at least ``least_points`` code points, A-Z
    lower-cased. ``alter(word, doc_id)`` may shorten the runs of a document
    before; what it makes too short is not counted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (rows.mapInArrow(_count(least_points, alter), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def split_place(m: int) -> int:
    """Of a near pair with longer length ``m`` the first ``split_place(m)``
    code points agree, or else all after that many of the longer one."""
    return m // 2


def _keyed(words: DataFrame) -> DataFrame:
    """``m, side, key, word, n``: a word once for each key under which it
    meets others; m is the longer length of the pairs looked for, side 0 a
    common beginning, side 1 a common ending."""
    own = F.char_length("word")
    place = F.floor(F.col("m") / 2).cast("int")
    sides = (words.select("word", "n", F.explode(F.array(own, own + 1)).alias("m"))
             .select("word", "n", "m", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")))
    key = F.when(F.col("side") == 0, F.substring("word", F.lit(1), place)).otherwise(
        F.right("word", F.col("m") - place))
    return sides.select("m", "side", key.alias("key"), "word", "n")


def _tiled(keyed: DataFrame, group_rows: int) -> DataFrame:
    """``keyed`` with the tile (a <= b, numbers of parts of a key's rows) and
    ``part``, the row's own. A key of up to ``group_rows`` rows is one tile."""
    hot = materialize(keyed.groupBy("m", "side", "key").count().filter(F.col("count") > group_rows), "hot-keys")
    parts = F.coalesce(F.ceil(F.col("count") / group_rows).cast("int"), F.lit(1))
    dealt = (keyed.join(hot, ["m", "side", "key"], "left")
             .withColumn("parts", parts)
             .withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    return (dealt.select("m", "side", "key", "word", "n", "part", other)
            .select("m", "side", "key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"),
                    "part", "word", "n"))


def matrices(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words, (words, width), padded with zeros: from their
    beginnings on, and from their ends backwards; and their lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    most = int(points.max()) if len(points) else 0
    points = points.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32)
    ends = np.cumsum(sizes)
    k = np.arange(width)[None, :]
    inside = k < sizes[:, None]
    last = max(len(points) - 1, 0)
    forward = np.where(inside, points[np.minimum((ends - sizes)[:, None] + k, last)], 0)
    backward = np.where(inside, points[np.maximum(ends[:, None] - 1 - k, 0)], 0)
    return forward, backward, sizes


def _common(x: np.ndarray, y: np.ndarray, alive: np.ndarray, known: int) -> np.ndarray:
    """Length of the common beginning of every row of ``x`` with every row of
    ``y``, for the pairs ``alive``, of which ``known`` places agree already."""
    out = np.where(alive, known, 0).astype(np.int32)
    for c in range(known, x.shape[1]):
        alive = alive & (x[:, c, None] == y[None, :, c])
        if not alive.any():
            break
        out += alive
    return out


def near_pairs(words: list[str], group: np.ndarray, part: np.ndarray, diagonal: np.ndarray,
               m: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of the near pairs with longer length ``m`` among sorted
    rows of one side, compared by blocks. Rows meet if they have the same
    ``group`` (tile of a key) and lie in different parts, or in a tile of one part."""
    place = split_place(m)
    forward, backward, sizes = matrices(words, m)
    known = (place, 0) if side == 0 else (0, m - place)
    left, right = [], []
    n = len(words)
    for a in range(0, n, BLOCK_ROWS):
        a_end = min(a + BLOCK_ROWS, n)
        for b in range(a, n, BLOCK_ROWS):
            if b > a and group[b] != group[a_end - 1]:
                break  # sorted: no later block holds a group of this one
            b_end = min(b + BLOCK_ROWS, n)
            alive = group[a:a_end, None] == group[None, b:b_end]
            alive &= (sizes[a:a_end, None] == m) | (sizes[None, b:b_end] == m)
            alive &= diagonal[a:a_end, None] | (part[a:a_end, None] != part[None, b:b_end])
            if b == a:
                alive &= np.arange(a, a_end)[:, None] < np.arange(b, b_end)[None, :]
            if not alive.any():
                continue
            front = _common(forward[a:a_end], forward[b:b_end], alive, known[0])
            if side == 1:
                alive = alive & (front < place)  # others are found by their beginnings
            back = _common(backward[a:a_end], backward[b:b_end], alive, known[1])
            i, j = np.nonzero(alive & (front + back >= m - 1))
            left.append(i + a)
            right.append(j + b)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


_PAIRS = "word string, other string, other_n long"


def _compare(batches):
    """Rows sorted by (m, side, key, a, b): whole tiles are compared together,
    those that may go on in the next batch wait for it."""
    def compared(table: pa.Table):
        names = ["m", "side", "key", "a", "b"]
        first = np.zeros(len(table), bool)
        first[0] = True
        for name in names:
            x = table.column(name).combine_chunks()
            first[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
        group = np.cumsum(first)
        m, side = table.column("m").to_numpy(), table.column("side").to_numpy()
        part = table.column("part").to_numpy()
        diagonal = table.column("a").to_numpy() == table.column("b").to_numpy()
        words, n = table.column("word").combine_chunks(), table.column("n").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero((m[1:] != m[:-1]) | (side[1:] != side[:-1])) + 1, [len(table)]])
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            i, j = near_pairs(words.slice(s, e - s).to_pylist(), group[s:e], part[s:e], diagonal[s:e],
                              int(m[s]), int(side[s]))
            if len(i):
                one, two = np.concatenate([i, j]) + s, np.concatenate([j, i]) + s
                yield pa.record_batch([words.take(pa.array(one)), words.take(pa.array(two)), pa.array(n[two])],
                                      names=["word", "other", "other_n"])

    def last_tile(table: pa.Table) -> int:
        """Where the last tile of the rows begins."""
        same = np.ones(len(table), bool)
        for name in ("m", "side", "key", "a", "b"):
            x = table.column(name).combine_chunks()
            same &= pc.equal(x, x[-1]).to_numpy(zero_copy_only=False)
        return int(np.flatnonzero(same)[0])

    waiting = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        waiting = table if waiting is None else pa.concat_tables([waiting, table])
        at = last_tile(waiting)
        if at:
            yield from compared(waiting.slice(0, at))
            waiting = waiting.slice(at).combine_chunks()
    if waiting is not None and len(waiting):
        yield from compared(waiting)


def near_words(words: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``word, other, other_n``: every pair of near words of ``words`` (word,
    n; each word once), in both directions."""
    keys = ["m", "side", "key", "a", "b"]
    tiles = _tiled(_keyed(words), group_rows)
    return (tiles.repartition(frames.partitions(words), *keys).sortWithinPartitions(*keys)
            .mapInArrow(frames.lean(_compare), _PAIRS))


def with_roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms`` (word, form): the end of the chain of forms.
    Chains are halved in every round; n grows along a chain, so they end."""
    now = materialize(forms.select("word", F.col("form").alias("at")), "form-chains")
    for _ in range(ROUNDS):
        step = now.select(F.col("word").alias("at"), F.col("at").alias("next"))
        longer = materialize(now.join(step, "at", "left")
                             .select("word", F.coalesce("next", "at").alias("at"), F.col("next").isNotNull().alias("moved")),
                             "form-chains")
        if longer.filter("moved").isEmpty():
            return longer.select("word", F.col("at").alias("root"))
        now = longer.drop("moved")
    raise RuntimeError("chains of forms did not end")


def group_variants(docs: DataFrame, least_points: int = 6, least_count: int = 5, ratio: int = 5,
                   alter=None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Spelling variants among the words of ``docs`` (doc_id, text).

    Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased
    (after ``alter``, see ``word_counts``), of at least ``least_points`` code
    points and ``least_count`` occurrences in the whole table. Returns per
    word ``word, n, n_near`` (number of near words), ``form, form_n`` (the near
    word of the largest n, of equals the smallest; null if its n is below
    ``ratio`` times the word's) and ``root`` (the end of the chain of forms,
    the word itself without a form). Null and empty texts have no words;
    repeated rows count as often as they stand; other columns are not read; an
    empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that chains of forms end")
    words = materialize(word_counts(docs, least_points, alter).filter(F.col("n") >= least_count), "words")
    near = near_words(words, group_rows).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("k"), "other")).alias("best"))
    found = materialize(
        words.join(near, "word", "left")
        .withColumn("has", F.coalesce(-F.col("best.k") >= F.lit(ratio) * F.col("n"), F.lit(False)))
        .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                F.when(F.col("has"), F.col("best.other")).alias("form"),
                F.when(F.col("has"), -F.col("best.k")).alias("form_n")), "word-forms")
    roots = with_roots(found.filter("form IS NOT NULL"))
    return (found.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
