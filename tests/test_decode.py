"""N1-N13 against a Python model of the decoding specification."""

import math
import random

import pytest

from quarry.operators import decode as N


def py_top(vals, n):
    return sorted(range(len(vals)), key=lambda i: (-vals[i], i))[:n]


def py_decode(feats, context, n_best, max_len, v2=False, thr=0.0):
    cands, null = [], None
    for w, offs, sl, el in feats:
        ns = sl[0] + el[0]
        if null is None or ns < null[0] or (ns == null[0] and w < null[1]):
            null = (ns, w, sl[0], el[0])
        for s in py_top(sl, n_best):
            for e in py_top(el, n_best):
                if offs[s] is None or offs[e] is None or e < s or e - s + 1 > max_len:
                    continue
                cands.append((sl[s] + el[e], 0, w, s, e, sl[s], el[e], offs[s][0], offs[e][1]))
    if v2 and null is not None:
        cands.append((null[0], 1, null[1], 0, 0, null[2], null[3], 0, 0))
    cands.sort(key=lambda c: (-c[0], c[1], c[2], c[3], c[4]))
    kept = cands[:n_best]
    if v2 and null is not None and not any(c[1] == 1 for c in kept):
        kept.append([c for c in cands if c[1] == 1][0])
    preds = [{"text": "" if c[1] else context[c[7]:c[8]], "score": c[0], "start": c[7],
              "sl": c[5], "el": c[6], "null": c[1] == 1} for c in kept]
    if not preds or (len(preds) == 1 and preds[0]["text"] == ""):
        preds.insert(0, {"text": "empty", "score": 0.0, "start": 0, "sl": 0.0, "el": 0.0, "null": False})
    m = max(p["score"] for p in preds)
    z = sum(math.exp(p["score"] - m) for p in preds)
    for p in preds:
        p["prob"] = round(math.exp(p["score"] - m) / z, 6)
    if not v2:
        return preds, preds[0]["text"], None
    best = [p for p in preds if p["text"] != ""][0]
    if null is None:                 # no feature at all: nothing to compare with
        return preds, best["text"], None
    diff = null[0] - best["sl"] - best["el"]
    return preds, ("" if diff > thr else best["text"]), round(diff, 6)


def make_case(rng, ex_id, n_windows):
    words = [f"w{ex_id}_{i}" for i in range(rng.randint(3, 25))]
    context = " ".join(words)
    starts, pos = [], 0
    for w in words:
        starts.append(pos)
        pos += len(w) + 1
    feats = []
    for w in range(n_windows):
        lo = min(w * 4, len(words) - 1)
        toks = list(range(lo, min(lo + 8, len(words))))
        offs = [None] + [(starts[t], starts[t] + len(words[t])) for t in toks]
        sl = [round(rng.uniform(-5, 5), 1) for _ in offs]
        el = [round(rng.uniform(-5, 5), 1) for _ in offs]
        feats.append((w, offs, sl, el))
    return context, feats


@pytest.mark.parametrize("v2", [False, True])
def test_decode_matches_model(spark, v2):
    rng = random.Random(5)
    ex_rows, feat_rows, model = [], [], {}
    for ex in range(25):
        context, feats = make_case(rng, ex, rng.randint(0, 3))
        ex_rows.append((ex, context))
        for w, offs, sl, el in feats:
            feat_rows.append((ex, w, 0, [None if o is None else {"s": o[0], "e": o[1]} for o in offs], sl, el))
        model[ex] = py_decode(feats, context, 4, 3, v2)
    examples = spark.createDataFrame(ex_rows, "id long, context string")
    feats = spark.createDataFrame(feat_rows, "example_id long, window_index int, context_index int, "
                                  "offsets array<struct<s:int,e:int>>, start_logits array<double>, "
                                  "end_logits array<double>")
    out = {r.example_id: r for r in N.nbest(feats, examples, n_best=4, max_answer_length=3,
                                            version_2_with_negative=v2).collect()}
    for ex, (preds, best, diff) in model.items():
        r = out[ex]
        assert [p.text for p in r.nbest] == [p["text"] for p in preds]
        assert [p.probability for p in r.nbest] == pytest.approx([p["prob"] for p in preds], abs=1e-6)
        assert r.prediction_text == best
        if v2 and diff is None:
            assert r.score_diff is None
        elif v2:
            assert r.score_diff == pytest.approx(diff, abs=1e-6)


def test_top_positions_ties(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 2.0],)], "x array<double>")
    assert list(df.select(N.top_positions(df.x, 3).alias("t")).first().t) == [1, 2, 3]
