"""Exact, near, substring and suffix deduplication against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from quarry.llm import exact_dedup, firsts, simhash, substring_dedup, suffix_dedup
from tests.llm.conftest import edge_rows, make_docs, words


def low(text):
    return (text or "").encode().lower()


# ------------------------------------------------------------------ exact

def exact_model(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[low(t)].append(d)
    out = []
    for text, ids in groups.items():
        some = [i for i in ids if i is not None]
        keep = max(some) if some else None
        left = 1
        for d in sorted(ids, key=lambda i: (i is None, i or 0)):
            kept = d == keep and left == 1
            left -= kept
            out.append((d, keep, len(ids), kept, hashlib.sha256(text).hexdigest()))
    return out


def as_set(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_exact_matches_model(edge, block):
    rows, docs = edge
    out = exact_dedup.exact_dedup(docs, block_bytes=block)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out.collect()]
    assert as_set(got) == as_set(exact_model(rows))


def test_exact_empty(nothing):
    assert exact_dedup.exact_dedup(nothing).collect() == []
    assert exact_dedup.drop_exact_copies(nothing).columns == nothing.columns


def test_exact_names_do_not_confuse_block_order(llm_spark):
    rows = [(1, "abab"), (2, "abba"), (3, "ab"), (4, "abab"), (5, "aba"), (6, "abababab"), (7, "ababab")]
    out = exact_dedup.exact_dedup(make_docs(llm_spark, rows), block_bytes=2).collect()
    assert {r.doc_id: r.group_size for r in out} == {1: 2, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1, 7: 1}


def test_exact_filter_keeps_one_row_of_each_text(edge):
    rows, docs = edge
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    assert sorted(low(t) for _, t in got) == sorted({low(t) for _, t in rows})
    assert sorted(map(repr, (d for d, _ in got))) == sorted(repr(r[0]) for r in exact_model(rows) if r[3])


def test_exact_keeps_one_of_texts_that_differ_in_case_under_one_id(llm_spark):
    rows = [(7, "Same Text"), (7, "same text"), (7, "same text"), (3, "SAME TEXT"),
            (None, "Alone"), (None, "alone"), (None, "ALONE"), (None, None), (None, "")]
    docs = make_docs(llm_spark, rows)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()]
    assert as_set(got) == as_set(exact_model(rows))
    kept = exact_dedup.drop_exact_copies(docs).collect()
    assert sorted((repr(r.doc_id), low(r.text)) for r in kept) == [("7", b"same text"), ("None", b""), ("None", b"alone")]


# ------------------------------------------------------------------ simhash

def fingerprint_model(text, n=3):
    import xxhash
    w = low(text).split()
    shingles = [b" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def group_model(values, distance):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_simhash_matches_model(edge):
    rows, docs = edge
    fps = [fingerprint_model(t) for _, t in rows]
    roots = group_model(fps, 2)
    best = {}
    for (d, _), root in zip(rows, roots):
        best[root] = min(best.get(root, 1 << 63), (1 << 63) - 1 if d is None else d)
    want = [(d, f"{f:016x}", None if best[r] == (1 << 63) - 1 else best[r]) for (d, _), f, r in zip(rows, fps, roots)]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_dedup(docs).collect()]
    assert as_set(got) == as_set(want)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))


def test_simhash_empty(nothing):
    assert simhash.simhash_dedup(nothing).collect() == []
    assert simhash.drop_near_copies(nothing).collect() == []


@pytest.mark.parametrize("distance", [1, 2])
@pytest.mark.parametrize("limit", [1, 64])
def test_links_find_every_group(llm_spark, distance, limit):
    """Clusters around a few centres, in buckets over and under the limit."""
    rng = random.Random(distance)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            v = centre
            for _ in range(rng.randrange(0, 5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = llm_spark.createDataFrame([(v,) for v in signed], "fp long")
    pairs = [(r.a, r.b) for r in simhash.links(fps, distance, bucket_limit=limit).collect()]
    where = {v: i for i, v in enumerate(signed)}
    assert all(a > b for a, b in pairs)
    from quarry.llm.components import components
    frame = llm_spark.createDataFrame(pairs, "a long, b long")
    root = {r.node: r.root for r in components(frame).collect()}
    got, want = [root.get(v, v) for v in signed], group_model(values, distance)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want)) and len(where) == len(values)


def test_join_masks_cover_every_difference():
    from itertools import combinations
    masks = simhash.join_masks(5, 2)
    for a, b in combinations(range(64), 2):
        assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def test_xxh64_matches_library():
    import numpy as np
    import xxhash

    from quarry.llm.xxh import xxh64
    rng = random.Random(5)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(0, 110), 500]]
    raw = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
    size = np.array([len(p) for p in parts])
    at = np.cumsum(size) - size
    for seed in (0, 42):
        assert xxh64(raw, at, size, seed).tolist() == [xxhash.xxh64_intdigest(p, seed) for p in parts]


# ------------------------------------------------------------------ repeats

def id_of(d):
    return (1 << 63) - 1 if d is None else d


def words_model(rows, window):
    first = {}
    split = [(id_of(d), re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t in rows]
    for d, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), (i, w) in zip(rows, split):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.mark.parametrize("window", [3, 13])
def test_substring_matches_model(edge, window):
    rows, docs = edge
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs, window).collect()]
    assert as_set(got) == as_set(words_model(rows, window))


def bytes_model(rows, length):
    first = {}
    texts = [(id_of(d), (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for k in range(len(b) - length + 1):
            first[b[k:k + length]] = min(first.get(b[k:k + length], d), d)
    out = []
    for (d, _), (i, b) in zip(rows, texts):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < i:
                gone[k:k + length] = b"\1" * length
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))),
                    bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("length", [7, 50])
def test_suffix_matches_model(edge, length):
    rows, docs = edge
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept))
           for r in suffix_dedup.remove_strings(docs, length).collect()]
    assert as_set(got) == as_set(bytes_model(rows, length))


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_on_few_letters(llm_spark, seed, monkeypatch):
    """Texts of few letters and words: overlapping, periodic, tied strings;
    tiny batches and chunks."""
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randrange(0, 120))) for _ in range(60)]
    rows = [(rng.randrange(40), t) for t in texts]
    docs = make_docs(llm_spark, rows).repartition(3)
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept))
           for r in suffix_dedup.remove_strings(docs, 9).collect()]
    assert as_set(got) == as_set(bytes_model(rows, 9))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs, 4).collect()]
    assert as_set(got) == as_set(words_model(rows, 4))


def edge_twins(number=1 << 18):
    """Two texts with the same 25 bytes in the middle, whose surroundings
    differ but agree in the upper 32 bits of their hash."""
    import numpy as np
    rng = np.random.default_rng(3)
    letters = rng.integers(97, 123, (1 << 18, 25), np.uint8)
    names = suffix_dedup.Suffixes(letters.reshape(-1), np.arange(0, letters.size + 1, 25), 50).names
    start = np.arange(0, letters.size, 25)
    texts = rng.integers(97, 123, (number, 75), np.uint8)
    texts[:, 25:50] = letters[np.argmin(names.of(start, start + 25))]
    s = suffix_dedup.Suffixes(texts.reshape(-1), np.arange(0, texts.size + 1, 75), 50)
    upper = s.surroundings(np.arange(25, texts.size, 75)) >> np.uint64(32)
    order = np.argsort(upper, kind="stable")
    twins = np.flatnonzero(upper[order][1:] == upper[order][:-1])
    return [texts[order[twins[0] + k]].tobytes().decode() for k in (0, 1)]


@pytest.mark.parametrize("tasks", [1, 2])
def test_suffix_judges_by_whole_surroundings(llm_spark, tasks):
    """In one batch, and over the buckets."""
    rows = list(enumerate(edge_twins()))
    assert rows[0][1] != rows[1][1] and rows[0][1][25:50] == rows[1][1][25:50]
    docs = llm_spark.createDataFrame(llm_spark.sparkContext.parallelize(rows, tasks), "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept))
           for r in suffix_dedup.remove_strings(docs).collect()]
    assert as_set(got) == as_set(bytes_model(rows, 50))


def tag_twins(passage, number=200_000):
    """A text that begins with ``passage`` and a short one without it, whose
    64-bit hashes agree in the lower 32 bits."""
    import numpy as np

    from quarry.llm.xxh import xxh64
    lower, texts = [], []
    for prefix in (passage + " ", "n"):
        some = [f"{prefix}{i:07d}" for i in range(number)]
        size = np.full(number, len(some[0]))
        raw = np.frombuffer("".join(some).encode() + bytes(8), np.uint8)
        lower.append(xxh64(raw, np.cumsum(size) - size, size, 42) & np.uint64(0xFFFFFFFF))
        texts.append(some)
    _, a, b = np.intersect1d(*lower, return_indices=True)
    return texts[0][a[0]], texts[1][b[0]]


def test_rows_without_id_have_reports_of_their_own(llm_spark):
    passage = words(random.Random(8), 30, 400)
    long, short = tag_twins(passage)
    rows = [(1, passage), (None, long), (None, short)]
    docs = make_docs(llm_spark, rows)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs).collect()]
    assert as_set(got) == as_set(words_model(rows, 13))
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept))
           for r in suffix_dedup.remove_strings(docs).collect()]
    assert as_set(got) == as_set(bytes_model(rows, 50))


def test_rows_without_id_are_dealt_over_all_partitions():
    import numpy as np
    ids = np.full(4000, (1 << 63) - 1)
    tags = np.random.default_rng(1).integers(0, 1 << 63, 4000).astype(np.uint64)
    rows = np.bincount(firsts.home(ids, tags, 8), minlength=8)
    assert rows.min() > 400 and rows.max() < 600
    assert (firsts.home(ids, tags[:1].repeat(4000), 8) == firsts.home(ids, tags, 8)[0]).all()


def test_repeats_empty(nothing):
    assert substring_dedup.remove_repeats(nothing).collect() == []
    assert suffix_dedup.remove_strings(nothing).collect() == []


def test_batches_send_a_hot_string_once():
    import numpy as np
    held = firsts.Batch()
    base = held.add_docs(np.arange(50), np.zeros(50, np.uint32), 10)
    key = np.full(50, 7, np.uint64)
    held.add(np.arange(50) + base, np.zeros(50, np.int64), key, key)
    rows = list(held.rows(4, 4, 0))
    sent = [firsts.Blob(b) for _, kind, b in rows if kind == firsts.ENTRIES]
    assert [b.n for b in sent] == [1] and sent[0].ids.tolist() == [0]
    assert sum(firsts.Blob(b).n for _, kind, b in rows if kind == 0) == 49


def test_edge_rows_have_repeats():
    assert any(r[2] for r in words_model(edge_rows(), 13)) and words(random.Random(1), 2)
