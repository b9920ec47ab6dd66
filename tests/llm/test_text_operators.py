"""Periodic runs, toxicity, spelling variants."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import periodic_runs, queries, spelling, toxicity
from tests.llm.conftest import edge_rows, make_docs

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ periodic runs

def runs_model(words, least, power):
    """Every period by comparing all places."""
    found = []
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            size = i - start + q
            part = words[start:start + size]
            if size >= max(least, power * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                found.append((start, size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_text(rng):
    n, letters = rng.randrange(0, 70), rng.choice([1, 2, 2, 3, 6])
    words = [b"w%d" % rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n > 4:
            a, p = rng.randrange(n), rng.randrange(1, 7)
            for i in range(a + p, min(n, a + rng.randrange(50))):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize("least,power", [(6, 4), (2, 2), (4, 2), (6, 3), (10, 4)])
def test_runs_match_model(least, power):
    rng = random.Random(least * 10 + power)
    for _ in range(400):
        words = periodic_text(rng)
        expected = runs_model(words, least, power)
        code = {w: i for i, w in enumerate(dict.fromkeys(words))}
        whole = periodic_runs.runs([code[w] for w in words], least, power)
        assert sorted(whole, key=lambda r: (r[0], r[2])) == expected
        assert periodic_runs.document_runs(words, least, power) == expected


def test_automaton_paths_agree_with_the_text():
    rng = random.Random(5)
    words = [rng.randrange(2) for _ in range(60)]
    length, link, prefixes = periodic_runs.automaton(words)
    tree = periodic_runs.AccessTree(link)
    for i, state in enumerate(prefixes):
        last = {}
        for size in range(1, i + 2):  # every suffix and its last end before i
            ends = [j for j in range(size - 1, i) if words[j - size + 1:j + 1] == words[i - size + 1:i + 1]]
            if ends:
                last[max(ends)] = size
        assert {j: length[v] for j, v in tree.access(state, i) if length[v]} == last


def query_model(rows, least=6, power=4):
    out = []
    for d, t in rows:
        words = (t or "").encode().split()
        h = zlib.crc32(b"" if d is None else str(d).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found = runs_model(words, least, power)
        gone = {i for s, size, q in found for i in range(s + q, s + size)}
        best = sorted(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
        s, size, q = best[0] if best else (None, None, None)
        out.append((d, len(found), s, size, q, 1000 * size // q if best else None,
                    hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest(),
                    hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()))
    return sorted(out, key=repr)


def test_periodic_query_on_edge_rows(llm_spark, tmp_path, nothing):
    rng = random.Random(2)
    rows = [(d, t if t is None or len(t) < 4000 else t[:4000]) for d, t in edge_rows()]
    rows += [(900 + i, b" ".join(periodic_text(rng)).decode()) for i in range(60)]
    rows += [(990, "a " * 3000), (991, "a\x0bb\x0ca\x0bb a b a b a b")]
    docs = make_docs(llm_spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op11_periodic_runs(llm_spark, str(tmp_path)).collect()), key=repr)
    assert got == query_model(rows)
    assert periodic_runs.find_runs(nothing).collect() == []


def test_long_periodic_text(llm_spark):
    rng = random.Random(3)
    base = [f"x{rng.randrange(500)}" for _ in range(9000)]
    text = " ".join(base * 5 + ["end"])
    assert len(text) > 200_000
    row = periodic_runs.find_runs(make_docs(llm_spark, [(1, text)])).first()
    assert (row.start, row.length, row.period) == (0, 45000, 9000)
    assert bytes(row.collapsed).decode().split() == base + ["end"]


# ------------------------------------------------------------------ toxicity

def run_alone(machine, symbols):
    state, out = machine.start, []
    for x in symbols:
        state, y = machine.arcs[state, x]
        out.append(y)
    return out


def test_composition_equals_running_one_after_the_other():
    rng = random.Random(1)
    parts, inputs = [], toxicity.SYMBOLS
    for build in (toxicity.threats, toxicity.negation, toxicity.reported, toxicity.targets):
        parts.append(build(inputs))
        inputs = toxicity.written(parts[-1])
    whole = toxicity.grammar()
    for _ in range(500):
        symbols = [rng.choice(toxicity.SYMBOLS) for _ in range(rng.randrange(1, 15))]
        step = symbols
        for p in parts:
            step = run_alone(p, step)
        assert run_alone(whole, symbols) == step


@pytest.mark.parametrize("text,events", [
    ("You are an idiot.", ["insult+you"]),
    ("That idiot! You left", ["insult"]),
    ("idiot, you left", ["insult", "address"]),
    ("you are not an IDIOT", ["insult+no+you"]),
    ("you isn’t really an idiot", ["insult+no+you"]),
    ("he said you are an idiot", ["insult+said+you"]),
    ("He said so. You are an idiot", ["insult+you"]),
    ("I will kill you", ["menace", "menace+you"]),
    ("I kill time", []),
    ("I will not hurt anybody", ["menace+no"]),
    ("nice day", []), ("", []),
])
def test_clauses(text, events):
    counts = toxicity.Model().events(text)
    assert sorted(e for e, n in zip(toxicity.EVENTS, counts) for _ in range(n)) == sorted(events)


def test_scores_order_and_weights():
    model = toxicity.Model()
    score = {t: float(model.score(np.array([model.events(t)]))[0]) for t in (
        "you are an idiot", "an idiot", "not an idiot", "he said not an idiot", "a day")}
    assert list(score.values()) == sorted(score.values(), reverse=True)
    # a thousand rows of one plain insult, nine tenths of them toxic
    counts = np.zeros((3, len(toxicity.EVENTS)))
    counts[:2, toxicity.EVENTS.index("insult")] = 1
    w, always = toxicity.fit_weights(counts, np.array([1, 0, 0]), np.array([900.0, 100.0, 5000.0]))
    assert 1 - np.exp(-w[toxicity.EVENTS.index("insult")] - always) == pytest.approx(0.9, abs=0.01)
    assert always < 0.01


def test_stems_are_chosen_once():
    strong = {"path": (50, 300.0), "pathe": (50, 300.0), "pathet": (49, 300.0), "lowe": (90, 500.0), "lowei": (90, 500.0),
              "loweia": (20, 500.0), "mild": (30, 40.0)}
    assert toxicity.chosen_stems(strong) == {"pathet": "insult", "lowei": "insult", "mild": "hint"}
    model = toxicity.Model({"lowei": "insult", "loweiab": "hint"})
    assert model.events("loweixy")[toxicity.EVENTS.index("insult")] == 1
    assert model.events("loweiabc")[toxicity.EVENTS.index("hint")] == 1
    assert not any(model.events("lowe"))


def test_toxicity_learns_and_judges_every_row(llm_spark, nothing):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(900):
        words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(30)] = "grumpf" + chr(97 + rng.randrange(26))
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    docs = make_docs(llm_spark, rows + edge_rows()[1:5] + [(None, None), (3, rows[3][1])])
    labels = llm_spark.createDataFrame(marks + [(None, 1), (5000, 1), (7, None)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, labels).collect()
    assert len(out) == docs.count()
    bad = {d for d, t in rows if "grumpf" in t}
    seen = {r.doc_id: r for r in out}
    for d, _ in rows:
        assert seen[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        if d > 20:
            assert seen[d].predicted == int(d in bad)
    assert all(0 <= r.score <= 1 for r in out) and not any(r.held_out for r in out if r.doc_id is None)
    assert toxicity.score_toxicity(nothing, labels).collect() == []
    plain = toxicity.score_toxicity(docs, labels.limit(0)).collect()
    assert {r.predicted for r in plain} == {0}


def test_toxicity_on_held_out_labels(llm_spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op12_toxicity(llm_spark, sf).filter("held_out")
    rows = out.join(llm_spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("toxic", "predicted").collect()
    bad = [r.predicted for r in rows if r.toxic == 1]
    good = [r.predicted for r in rows if r.toxic == 0]
    assert sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.02 * len(good)


# ------------------------------------------------------------------ spelling variants

def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_model(rows, least_points, least_count, ratio, alter):
    n = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            w = alter(w, d) if alter else w
            if len(w) >= least_points:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= least_count}
    near = {w: [o for o in n if one_edit(w, o)] for w in n}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-n[o], o))
            if n[best] >= ratio * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out, key=repr)


def variant_rows():
    rng = random.Random(9)
    stems = ["colour", "colours", "éclairÿs", "aaaaaa", "abcdefgh", "Straße"]
    rows = []
    for d in range(150):
        words = []
        for _ in range(40):
            w = list(rng.choice(stems))
            for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w[k:k + rng.randrange(2)] = rng.choice(["", "a", "e", "é", "b"])
                w = w or ["x"]
            words.append("".join(w))
        rows.append((d, " ".join(words)))
    return rows + [(None, "colour COLOUR ÉCLAIRÿS"), (1, None), (1, ""), (2, "colour9colour_colour×colour÷x"), (2, "x" * 50_000)]


@pytest.mark.parametrize("group_rows", [2048, 3])
@pytest.mark.parametrize("least_points,least_count,ratio", [(6, 5, 5), (2, 1, 2)])
def test_variants_match_model(llm_spark, group_rows, least_points, least_count, ratio):
    rows = variant_rows()
    docs = make_docs(llm_spark, rows)
    for alter in (None, spelling.drop_point):
        got = spelling.group_variants(docs, least_points, least_count, ratio, alter, group_rows).collect()
        assert sorted((tuple(r) for r in got), key=repr) == variants_model(rows, least_points, least_count, ratio, alter)


def test_variants_blocks_and_empty(llm_spark, nothing, monkeypatch):
    assert spelling.group_variants(nothing).collect() == []
    monkeypatch.setattr(spelling, "BLOCK_ROWS", 4)  # several blocks a key
    words = sorted({f"stemmm{a}{b}" for a in "abcde" for b in "abcde"})
    flat = np.zeros(len(words), np.int64)
    i, j = spelling.near_pairs(words, flat, flat, np.ones(len(words), bool), 8, 0)
    got = {(words[a], words[b]) for a, b in zip(i, j)}
    assert got == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_contract_inputs():
    assert spelling.drop_point("abcdefg", None) in ("abcdefg", *("abcdefg"[:k] + "abcdefg"[k + 1:] for k in range(7)))
    hit = next((d, f"word{d}x") for d in range(10_000) if zlib.crc32(f"{d}:word{d}x".encode()) % 199 == 0)
    assert len(spelling.drop_point(hit[1], hit[0])) == len(hit[1]) - 1


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_toxicity", "op13_spelling_variants"])
def test_registered_columns(llm_spark, name):
    out = queries.QUERIES[name](llm_spark, SF)
    expected = {
        "op11_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
        "op12_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op13_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"]}[name]
    assert out.columns == expected
    kinds = dict(out.dtypes)
    assert all(kinds[c] == "bigint" for c in expected if c in ("n_runs", "start", "length", "period", "exponent_milli", "n", "n_near", "form_n"))
    assert out.filter(F.col(expected[-1]).isNotNull() | F.lit(True)).count() > 0
