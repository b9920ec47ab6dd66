"""Decontamination, packing, language, sharding, url rules, token counts."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm import decontaminate, language, packing, sharding, token_counts, tokens, urlfilter
from quarry.llm.queries import RULES, word_tokenizer
from tests.llm.conftest import edge_rows, make_docs, words

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def as_set(rows):
    return sorted(map(repr, rows))


# ------------------------------------------------------------------ decontamination

def contamination_model(rows, items, window):
    where = defaultdict(set)
    for item, text in items:
        w = WORD.findall((text or "").encode().lower())
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            where[tuple(w[k:k + n])].add(item)
    sizes = {len(k) for k in where}
    out = []
    for d, text in rows:
        w = WORD.findall((text or "").encode().lower())
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in where:
                    hit |= set(range(k, k + n))
                    found |= where[tuple(w[k:k + n])]
        out.append((d, len(w), len(hit), sorted(str(i) for i in found if i is not None), bool(hit)))
    return out


def benchmark_items(rows):
    rng = random.Random(3)
    texts = [t for _, t in rows if t and len(t.split()) > 30]
    items = [(i, " ".join(t.split()[i:i + 10 + i])) for i, t in enumerate(texts[:8])]
    items += [(50, "w1x"), (51, "one TWO"), (52, None), (53, ""), (54, "?!"), (50, words(rng, 12, 6)), (50, "w1x"),
              (None, "w2x w3x"), (55, "Émile, été"), (56, " ".join(texts[0].split()[:9])), (10, words(rng, 30, 6))]
    return items


@pytest.mark.parametrize("window,gram", [(10, 5), (4, 2)])
def test_decontamination_matches_model(llm_spark, edge, window, gram):
    rows, docs = edge
    items = benchmark_items(rows)
    table = llm_spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, h long")
    out = decontaminate.decontaminate(docs, table, window, gram, filter_bits=1 << 12)
    got = [(r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated) for r in out.collect()]
    assert as_set(got) == as_set(contamination_model(rows, items, window))


def test_decontamination_filter_and_empty(llm_spark, edge, nothing):
    rows, docs = edge
    items = benchmark_items(rows)
    table = llm_spark.createDataFrame(items, "item_id long, text string")
    left = decontaminate.drop_contaminated(docs, table)
    clean = [r for r in contamination_model(rows, items, 10) if not r[4]]
    assert left.columns == docs.columns
    assert as_set(r.doc_id for r in left.select("doc_id").collect()) == as_set(r[0] for r in clean)
    assert decontaminate.decontaminate(nothing, table).collect() == []
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs, table.limit(0)).collect())


# ------------------------------------------------------------------ packing and tokens

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(word_tokenizer())


def test_word_tokenizer_equals_library(tokenizer):
    texts = ["", " ", "Hello  World\n\nfoo\tbar", "it's we're 123 4.5", "É é e\u0301 ΑΣ Σ", "a\u00a0b\u2003c\x0bd",
             "x<|endoftext|>y <|startoftext|>", "日本語 テキスト", "\u0301 x \u0301", "\x1c\x1d\x85 z", "🙂🙂 ok", "ﬁ İ I"]
    texts += [t or "" for _, t in edge_rows()]
    flat, at = tokens.load(word_tokenizer()).encode(texts, None)
    for i, t in enumerate(texts):
        assert flat[at[i]:at[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def check_packed(rows, pieces, tokenizer, sequence):
    """Round trip: pieces give back every document's ids; sequences are
    gapless and not too long. Returns the share that is filled."""
    want = sorted(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
                  for _, t in rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert len(r.ids) == 4 * r.length > 0
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= sequence
    # documents that share id and length are told apart by content
    got = []
    for (_, total), own in by_doc.items():
        heads = [r for r in own if r.start == 0]
        assert sum(r.length for r in own) == total * len(heads)
        if len(heads) == 1:
            got.append(b"".join(bytes(r.ids) for r in sorted(own, key=lambda r: r.start)))
        else:
            texts = [w for w in want if len(w) == 4 * total]
            assert all(any(w[4 * r.start:4 * (r.start + r.length)] == bytes(r.ids) for w in texts) for r in own)
            got += [None] * len(heads)
    assert len(got) == len(want) and {g for g in got if g} <= set(want)
    return sum(r.length for r in pieces) / sequence / len(by_sequence)


@pytest.mark.parametrize("sequence,group", [(2048, 1024), (32, 7)])
def test_packing_round_trip(edge, tokenizer, sequence, group):
    rows, docs = edge
    pieces = packing.pack_documents(docs, word_tokenizer(), sequence, group_docs=group, least_cut=4).collect()
    fill = check_packed(rows, pieces, tokenizer, sequence)
    assert fill > 0.8


def test_packing_empty(nothing):
    assert packing.pack_documents(nothing, word_tokenizer()).collect() == []


def test_pack_is_first_fit_decreasing():
    # 6 5 | 4 4 2 | 2 ... as first-fit decreasing puts them, without cuts
    bins = packing.pack([4, 6, 2, 5, 4, 2], 11, least_cut=100)
    assert [[p[0] for p in b] for b in bins] == [[1, 3], [0, 4, 2], [5]]
    assert packing.pack([], 8) == [] and packing.pack([8, 8], 8) == [[(0, 0, 8)], [(1, 0, 8)]]


def test_pack_cuts_nothing_twice():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.randrange(0, 65) for _ in range(rng.randrange(0, 60))]
        bins = packing.pack(sizes, 64, least_cut=rng.choice([1, 4, 16]))
        cover = defaultdict(list)
        for b in bins:
            assert 0 < sum(n for _, _, n in b) <= 64
            for item, start, n in b:
                cover[item] += range(start, start + n)
        assert all(sorted(cover[i]) == list(range(n)) for i, n in enumerate(sizes))


def test_tournament_finds_the_first_room():
    rng = random.Random(2)
    tree, room = packing.Tournament(13, 10), [10] * 16
    for _ in range(40):
        size = rng.randrange(1, 11)
        fits = [i for i, r in enumerate(room) if r >= size]
        if not fits:
            with pytest.raises(ValueError):
                tree.place(size)
            continue
        assert tree.place(size) == fits[0]
        room[fits[0]] -= size


def test_token_counts_match_tokenizer(llm_spark, edge, tokenizer):
    rows, docs = edge
    tokenizer.encode_special_tokens = True
    want = as_set((d, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    tokenizer.encode_special_tokens = False
    out = token_counts.document_token_counts(docs.repartition(3), word_tokenizer(), block_ids=16)
    assert as_set((r.doc_id, r.n_tokens) for r in out.collect()) == want


@pytest.mark.parametrize("run_blocks", [1, 3, 1000])
def test_separator_scan_stitches_blocks(llm_spark, run_blocks):
    rng = random.Random(run_blocks)
    blocks, want = [], []
    for file in range(4):
        ids = [9 if rng.random() < 0.15 else rng.randrange(8) for _ in range(rng.choice([0, 1, 60, 200]))]
        ids += [1, 2] if file == 1 else []
        at = k = 0
        while at < len(ids):  # blocks of any length, none of whose ends is a document's
            n = rng.randrange(1, 30)
            blocks.append((file, k, bytearray(np.array(ids[at:at + n], "<u2").tobytes())))
            at, k = at + n, k + 1
        sizes, run = [], 0
        for i in ids:
            if i == 9:
                sizes.append(run)
                run = 0
            else:
                run += 1
        want += [(file, k, n) for k, n in enumerate(sizes + [run] * (run > 0))]
    frame = llm_spark.createDataFrame(blocks, "file long, block long, ids binary")
    out = token_counts.count_tokens(frame, end=9, width=2, run_blocks=run_blocks).collect()
    assert sorted((r.file, r.document, r.n_tokens) for r in out) == sorted(want)


def test_token_files_are_read_in_blocks(llm_spark, tmp_path):
    ids = [5, 6, 9, 9, 7, 7, 7, 9, 1]
    (tmp_path / "a.bin").write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    blocks = token_counts.read_flat(llm_spark, str(tmp_path), 2, block_ids=2)
    assert blocks.count() == 5
    out = token_counts.count_tokens(blocks, 9, 2)
    assert [r.n_tokens for r in out.orderBy("document").collect()] == [2, 0, 3, 1]


def test_flat_file_beyond_two_gigabytes(llm_spark, tmp_path):
    """A sparse file above the size of one row: many ranges, one long document
    across them, then a short one."""
    n = (1 << 30) + 5
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(2 * n)
        f.seek(2 * (n - 4))
        f.write(np.array([9, 3, 3, 9], "<u2").tobytes())
    blocks = token_counts.read_flat(llm_spark, str(tmp_path), 2, block_ids=1 << 24)
    out = token_counts.count_tokens(blocks, 9, 2)
    assert [r.n_tokens for r in out.orderBy("document").collect()] == [n - 4, 2]
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="not a token file"):
        token_counts.read_flat(llm_spark, str(tmp_path), 2).count()


def test_token_counts_empty(nothing):
    assert token_counts.document_token_counts(nothing, word_tokenizer()).collect() == []


# ------------------------------------------------------------------ language

def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = language.fresh(["a", "b"], 3, rng)
    # float64 and small inputs, so that the piecewise linear parts are not at their corners
    net.table = [t.astype(np.float64) * 0.3 for t in net.table]
    steps = rng.integers(0, 257, (5, 4))
    label = np.array([0, 1, 1, 0])
    _, grads = language.gradients(net, steps, label)
    for w, g in zip(net.weights, grads):
        flat, slope = w.reshape(-1), g.reshape(-1)
        for i in np.argsort(-np.abs(slope))[:5]:
            keep, eps = flat[i], 1e-2
            flat[i] = keep + eps
            up = language.gradients(net, steps, label)[0]
            flat[i] = keep - eps
            down = language.gradients(net, steps, label)[0]
            flat[i] = keep
            assert abs((up - down) / (2 * eps) - slope[i]) < 2e-3 + 0.05 * abs(slope[i])


def two_languages(seed, n):
    rng = random.Random(seed)
    parts = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ung", "ein", "ver"]}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.randrange(2, 40))), lang))
    return rows


def test_language_learns_and_rejects(llm_spark):
    rows = two_languages(1, 400)
    extra = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 -- !", "aa"), (None, "katomi ruka", None),
             (7, rows[7][1], rows[7][2])]
    docs = llm_spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    out = language.identify(docs, sample_texts=300).collect()
    assert len(out) == len(rows) + len(extra)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.95
    und = {r.doc_id for r in out if r.lang_pred == "und"}
    assert und == {1000, 1001, 1002} and all(0 <= r.score <= 1 for r in out)
    kept = language.keep_identified(docs, sample_texts=300)
    assert kept.columns == docs.columns and kept.count() == len(out) - 3


def test_language_does_not_read_held_out_labels(llm_spark):
    rows = two_languages(2, 120)
    wrong = [(d, t, "cc" if zlib.crc32(str(d).encode()) % 5 == 0 else l) for d, t, l in rows]
    a, b = (language.fit(llm_spark.createDataFrame(r, "doc_id long, text string, lang string"), 100) for r in (rows, wrong))
    assert a.languages == b.languages == ["aa", "bb"]
    assert all((x == y).all() for x, y in zip(a.weights, b.weights))


def test_language_without_labels(llm_spark, nothing):
    docs = make_docs(llm_spark, [(1, "text"), (2, None)]).drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r.lang_pred for r in language.identify(docs).collect()} == {"und"}
    assert language.identify(nothing).collect() == []


def test_every_byte_counts():
    """Document probabilities are means over all windows of the whole text."""
    net = language.fresh(["a", "b", "c"], 4, np.random.default_rng(1))
    raw = np.random.default_rng(2).integers(0, 256, 300).astype(np.uint8)
    offsets = np.array([0, 130, 130, 300])
    got = language.document_probabilities(net, raw, offsets)
    for k in range(3):
        part = raw[offsets[k]:offsets[k + 1]]
        total = np.zeros(3)
        for a in range(0, len(part), language.WINDOW):
            piece = part[a:a + language.WINDOW]
            steps = np.full((language.WINDOW, 1), 256)
            steps[:len(piece), 0] = piece
            total += language.probabilities(net, language.states(net, steps))[:len(piece)].sum(axis=(0, 1))
        assert np.allclose(got[k], total / max(1, len(part)), atol=1e-5)


# ------------------------------------------------------------------ sharding

def test_sharding_laws(llm_spark):
    rows = edge_rows() + [(5000 + i, f"text {i}") for i in range(3000)]
    docs = make_docs(llm_spark, rows)
    out = sharding.shard_documents(docs, 16).collect()
    assert len(out) == len(rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = defaultdict(set)
    for r in out:
        by_id[r.doc_id].add((r.shard, r.grown_shard))
    assert all(len(s) == 1 for s in by_id.values())
    moved = sum(r.grown_shard == 16 for r in out) / len(out)
    assert abs(moved - 1 / 17) < 0.02 and max(map(len, slots.values())) < 1.4 * len(out) / 16
    want = as_set((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert as_set((r.doc_id, r.size, r.text_crc32) for r in out) == want


def test_sharding_ranges_are_gapless(llm_spark):
    rows = llm_spark.range(1000).selectExpr("id as doc_id", "cast(id % 3 as int) as shard")
    out = sharding.with_slots(rows, "shard", ["doc_id"], slot_rows=17).collect()
    for s in range(3):
        own = [r.slot for r in out if r.shard == s]
        assert sorted(own) == list(range(len(own)))


def test_growing_by_one_moves_only_into_the_new_shard(llm_spark):
    from pyspark.sql import functions as F
    frame = llm_spark.range(2000).select("id", *[sharding.jump_shard(F.col("id"), n).alias(f"n{n}") for n in range(1, 12)])
    for r in frame.collect():
        assert r.n1 == 0
        for n in range(2, 12):
            assert r[f"n{n}"] in (r[f"n{n - 1}"], n - 1)


def test_sharding_empty(nothing):
    assert sharding.shard_documents(nothing).collect() == []


def test_write_shards(llm_spark, tmp_path):
    docs = llm_spark.createDataFrame([(i, f"t{i}") for i in range(40)], "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = llm_spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 40 and {r[0] for r in back.select("shard").distinct().collect()} <= {0, 1, 2, 3}
    own = llm_spark.createDataFrame([(1, "a", 77), (None, "b", 78), (None, None, 79)], "doc_id long, text string, shard long")
    sharding.write_shards(own, str(tmp_path / "own"), 4)
    back = llm_spark.read.parquet(str(tmp_path / "own"))
    assert sorted(r.shard for r in back.collect()) == [77, 78, 79] and back.filter("_shard IS NULL").count() == 0


# ------------------------------------------------------------------ url rules

def url_model(url, rules, default="allow"):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest).group(0)
    path = re.match(r"[^?#]*", rest[len(host):]).group(0)
    host = re.sub("[A-Z]", lambda m: m.group(0).lower(), host)
    fits = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.key), len(r.host)), default=None)
    return host, path, best.key if best else None, best.verdict if best else default


def urls(seed):
    rng = random.Random(seed)
    out = [None, "", "no scheme", "://", "http://", "http:///en/", "http://NET", "http://net/", "http://net?x=/", "http://a.net#/",
           "http://a.NET/x", "http://example.net/en/1", "http://sub.Example.net/en", "http://example.netx/en/", "http://xexample.net/en/",
           "http://x.org/fr/a?b", "http://org/fr/", "http://.org/fr/", "http://x..org/fr/", "ftp://u://x.net/", "http://É.net/É", "http://a.b\n.net/"]
    names = ["net", "org", "com", "example", "a", "b", "EN"]
    for _ in range(300):
        host = ".".join(rng.choice(names) for _ in range(rng.randrange(1, 4)))
        path = "".join("/" + rng.choice(["en", "fr", "de", "x", ""]) for _ in range(rng.randrange(0, 3)))
        out.append(f"http://{host}{path}{rng.choice(['', '?q=/en/', '#/fr/'])}")
    return out


@pytest.mark.parametrize("many", [False, True])
def test_urls_match_model(llm_spark, many):
    rules = list(RULES)
    if many:  # more rules, some of which tie in length or fall on each other's false positives
        rng = random.Random(4)
        seen = {r.key for r in rules}
        for h in ("a", "b.a", "example.com", "com", "a.org", "b", "en.net", "é.net"):
            for p in ("", "/", "/en", "/en/", "/x/fr", "/fr/de"):
                if h + p not in seen:
                    rules.append(urlfilter.Rule(rng.choice(["block", "allow", "review"]), h, p))
    rows = list(enumerate(urls(7))) + [(3, "http://a.net/"), (None, "http://org/fr/")]
    pages = llm_spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, rule string, host string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, rules).collect()]
    assert as_set(got) == as_set((i, *url_model(u, rules)) for i, u in rows)


def test_cascade_is_exact(llm_spark):
    from pyspark.sql import functions as F
    universe = llm_spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("crc32(key) % 7 = 0")
    levels = urlfilter.cascade(listed, universe)
    assert len(levels) > 2
    got = {r.key for r in universe.filter(urlfilter.is_listed(levels, F.col("key"))).collect()}
    assert got == {r.key for r in listed.collect()}
    assert urlfilter.cascade(listed.limit(0), universe) == []


def test_urls_empty(llm_spark):
    pages = llm_spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge_urls(pages, RULES).collect() == []
    assert urlfilter.judge_urls(pages, []).collect() == []
    with pytest.raises(ValueError):
        urlfilter.judge_urls(pages, [urlfilter.Rule("block", "", "/")])


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


# ------------------------------------------------------------------ names, letters, order of rows

def test_clashing_key_columns_survive(llm_spark):
    from quarry.llm import exact_dedup, simhash
    rows = [(1, "One two three", 88, 99), (2, "one two three", 77, 66), (3, "w1x w2x w3x w4x", 5, 4), (4, "1 2", 3, 2)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string, __kept_id long, __hit_tag long").withColumnRenamed(
        "__hit_tag", "row").selectExpr("*", "'en' as lang", "7L as __kept_tag", "8L as __hit_id", "9L as tag", "'x' as letter")
    whole = {r.doc_id: tuple(r) for r in docs.collect()}
    items = llm_spark.createDataFrame([(1, "w1x w2x w3x w4x")], "item_id long, text string")
    kept = {"exact": exact_dedup.drop_exact_copies(docs), "near": simhash.drop_near_copies(docs, shingle=3, distance=2),
            "clean": decontaminate.drop_contaminated(docs, items)}
    for out in kept.values():
        assert out.columns == docs.columns
        assert all(whole[r.doc_id] == tuple(r) for r in out.collect())
    assert {r.doc_id for r in kept["exact"].collect()} == {2, 3, 4}
    assert {r.doc_id for r in kept["clean"].collect()} == {1, 2, 4}


@pytest.mark.parametrize("text,letter", [("½ ² ①", False), ("Ⅷ", False), ("́̈", False), ("१२", False), ("12 _", False),
                                         ("a", True), ("½é", True), ("漢", True), ("ʰ", True), ("", False), (None, False)])
def test_letters_are_category_l(llm_spark, text, letter):
    df = llm_spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert df.select(language.has_letter().alias("x")).first().x == letter


def test_language_stage_decides_by_score(llm_spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(("the", "of", "and", "thing") if i % 2 else ("der", "und", "schön", "nicht")) for _ in range(30)),
             "en" if i % 2 else "de", i) for i in range(200)]
    rows += [(900, "½ ²", "en", 1), (901, None, "en", 2), (902, "", "de", 3)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string, lang string, row long")
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} == set(rows[:200])
    assert language.keep_identified(docs, least_score=1.01).count() == 0
    scores = {r.doc_id: r.score for r in language.identify(docs).collect()}
    least = sorted(scores[i] for i in range(200))[100]
    assert {r.doc_id for r in language.keep_identified(docs, least_score=least).collect()} == {i for i in range(200) if scores[i] >= least}


def test_packing_groups_do_not_follow_row_order(llm_spark):
    rng = random.Random(6)
    rows = [(i % 40, words(rng, rng.randrange(0, 60))) for i in range(120)]
    rows += rows[:10] + [(None, "same text")] * 5 + [(7, words(rng, 5000))]
    def pieces(order):
        docs = llm_spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        out = packing.pack_documents(docs, word_tokenizer(), sequence=64, group_docs=16)
        return sorted((str(r.doc_id), r.start, r.length, bytes(r.ids), r.sequence_id >> 32) for r in out.collect())
    assert pieces(rows) == pieces(rows[::-1])
