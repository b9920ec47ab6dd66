"""C3-C14 against Python models and metamorphic checks."""

from pyspark.sql import functions as F

from quarry.operators import features as C


def test_span_labels_model(spark):
    # context tokens at positions 2..5 with offsets; CLS at 0
    offs = [None, None, {"s": 0, "e": 3}, {"s": 4, "e": 7}, {"s": 8, "e": 12}, {"s": 13, "e": 15}, None]
    cases = [(4, 7, True, (3, 3)), (4, 12, True, (3, 4)), (0, 3, True, (2, 2)), (13, 15, True, (5, 5)),
             (5, 9, True, (3, 4)), (14, 20, True, (0, 0)), (0, 0, True, (0, 0)), (4, 7, False, (0, 0))]
    df = spark.createDataFrame([(i, offs, sc, ec, h) for i, (sc, ec, h, _) in enumerate(cases)],
                               "i int, o array<struct<s:int,e:int>>, sc int, ec int, h boolean")
    s, e = C.span_labels(F.col("o"), F.col("sc"), F.col("ec"), F.col("h"))
    got = {r.i: (r.s, r.e) for r in df.select("i", s.alias("s"), e.alias("e")).collect()}
    for i, (_, _, _, exp) in enumerate(cases):
        assert got[i] == exp, (i, got[i], exp)


def test_reader_windows_layout(spark):
    df = spark.createDataFrame([(1, "who is it", " ".join(f"c{i}" for i in range(20)))],
                               "id long, question string, context string")
    w = C.reader_windows(df, max_seq_length=12, doc_stride=2).orderBy("window_index").collect()
    # 12 - 3 question tokens - 3 specials = 6 context tokens, step 4
    assert [len(r.input_ids) for r in w][:1] == [12]
    ctx = [[o.s for o in r.offset_mapping if o is not None] for r in w]
    assert all(len(c) <= 6 for c in ctx) and len(w) == 1 + -(-(20 - 6) // 4)
    assert all(r.input_ids[0] == C.CLS_ID and r.input_ids[-1] == C.SEP_ID for r in w)


def test_title_segment_merge(spark):
    df = spark.createDataFrame([(1, "q [SEP] ^title^", "a b c")], "id long, question string, context string")
    w = C.reader_windows(df, max_seq_length=32, doc_stride=2)
    w = w.withColumn("start_positions", F.lit(3)).withColumn("end_positions", F.lit(0))
    m = C.merge_title_segment(w).first()
    assert m.input_ids.count(C.SEP_ID) == 2
    assert list(m.token_type_ids) == [0, 0, 0, 1, 1, 1, 1, 1]
    assert (m.start_positions, m.end_positions) == (2, 0)


def test_mlm_deterministic_and_partition_independent(spark):
    rows = [(i, [C.CLS_ID] + [100 + j for j in range(30)] + [C.SEP_ID], [1] + [0] * 30 + [1],
             [False] + [j % 4 != 0 for j in range(30)] + [False]) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, input_ids array<int>, special_tokens_mask array<int>, "
                               "ner_map array<boolean>")
    a = {r.row_id: (list(r.input_ids), list(r.labels)) for r in C.mlm_mask(df).collect()}
    b = {r.row_id: (list(r.input_ids), list(r.labels)) for r in C.mlm_mask(df.repartition(7)).collect()}
    assert a == b
    for rid, (ids, labels) in a.items():
        assert labels[0] == -100 and labels[-1] == -100
    s = {r.row_id: r for r in C.mlm_mask(df, ner="ner_map", span_masking=True, mlm_probability=0.2).collect()}
    for rid, r in s.items():
        ner = rows[rid][3]
        drawn = [lab != -100 for lab in r.labels]
        # masked positions are entity positions, and runs are masked whole
        assert all(ner[p] for p in range(len(ner)) if drawn[p])
        for p in range(1, len(ner) - 1):
            if ner[p] and ner[p + 1]:
                assert drawn[p] == drawn[p + 1]


def test_batch_padding(spark):
    rows = [(i, list(range(1 + (i * 5) % 9))) for i in range(10)]
    df = spark.createDataFrame(rows, "row_id long, input_ids array<int>")
    out = {r.row_id: r for r in C.batch_pad(df, "row_id", batch_size=4, pad_to_multiple_of=4,
                                            n_ranges=3).collect()}
    for b in range(3):
        ids = [i for i in range(10) if i // 4 == b]
        longest = max(len(rows[i][1]) for i in ids)
        target = -(-longest // 4) * 4
        assert all(len(out[i].input_ids) == target for i in ids)


def py_answer_centred(ntok, ts, te, L):
    if ntok <= L:
        return 0
    mid = (ts + te) // 2
    return min(max(mid - (L // 2 + L % 2), 0), ntok - L)


def test_answer_centred_window(spark):
    words = [f"w{i}" for i in range(30)]
    ctx = " ".join(words)
    starts = [len(" ".join(words[:i])) + (1 if i else 0) for i in range(30)]
    cases = [(0, 1), (5, 2), (14, 1), (28, 2), (29, 1)]
    rows = [(i, ctx, {"text": [" ".join(words[a:a + n])], "answer_start": [starts[a]]})
            for i, (a, n) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, context string, "
                               "answers struct<text:array<string>,answer_start:array<int>>")
    got = {r.id: r for r in C.answer_centred(df, max_passage_length=12).collect()}
    for i, (a, n) in enumerate(cases):
        exp = py_answer_centred(30, a, a + n - 1, 10)
        assert got[i].window_start == exp
        assert len(got[i].p_input_ids) == 12 and got[i].p_input_ids[0] == C.CLS_ID
        assert sum(got[i].p_attention_mask) == 12


def test_left_padding(spark):
    df = spark.createDataFrame([(1, [7, 8]), (2, [9, 9, 9])], "row_id long, input_ids array<int>")
    out = {r.row_id: list(r.input_ids) for r in C.batch_pad(df, "row_id", batch_size=2,
                                                             padding_side="left", n_ranges=2).collect()}
    assert out == {1: [0, 7, 8], 2: [9, 9, 9]}


def py_labels(offsets, sc, ec, has_answer):
    """Loop model of C6 over the context positions only."""
    ctx = [i for i, o in enumerate(offsets) if o is not None]
    if not has_answer or (sc == 0 and ec == 0) or not ctx:
        return (0, 0)
    if not (offsets[ctx[0]][0] <= sc and offsets[ctx[-1]][1] >= ec):
        return (0, 0)
    k = 0
    while k < len(ctx) and offsets[ctx[k]][0] <= sc:
        k += 1
    start = ctx[k - 1]
    k = len(ctx) - 1
    while k >= 0 and offsets[ctx[k]][1] >= ec:
        k -= 1
    end = ctx[k + 1]
    return (start, end)


def test_span_labels_random(spark):
    import random
    rng = random.Random(7)
    rows, model = [], {}
    for i in range(300):
        n_q = rng.randint(1, 4)
        pos, offs = 0, [None] * (n_q + 2)
        for _ in range(rng.randint(0, 8)):
            pos += rng.randint(0, 2)
            w = rng.randint(1, 5)
            offs.append((pos, pos + w))
            pos += w
        offs.append(None)
        sc = rng.randint(0, pos + 2)
        ec = sc + rng.randint(0, 6)
        has = rng.random() > 0.1
        rows.append((i, [None if o is None else {"s": o[0], "e": o[1]} for o in offs], sc, ec, has))
        model[i] = py_labels(offs, sc, ec, has)
    df = spark.createDataFrame(rows, "i int, o array<struct<s:int,e:int>>, sc int, ec int, h boolean")
    s, e = C.span_labels(F.col("o"), F.col("sc"), F.col("ec"), F.col("h"))
    got = {r.i: (r.s, r.e) for r in df.select("i", s.alias("s"), e.alias("e")).collect()}
    assert got == model


def test_span_mask_rows_of_one_batch_stay_apart(spark):
    """Spans end with their row, a batch holds many rows, and positions that
    cannot be drawn are not hashed one by one in array lambdas."""
    import hashlib
    import random

    import pyarrow as pa

    from quarry.functions import text as T
    from quarry.operators import features as FT
    rng = random.Random(5)
    ids = [[rng.randrange(5, 90) for _ in range(rng.randrange(0, 30))] for _ in range(80)]
    special = [[int(rng.random() < 0.1) for _ in r] for r in ids]
    ner = [[rng.random() < 0.7 for _ in r] for r in ids]
    got = FT._masked(42, 0.2, True, True, 100)(pa.array([str(i) for i in range(80)]), pa.array(ids, pa.list_(pa.int32())),
                                              pa.array(special, pa.list_(pa.int32())), pa.array(ner, pa.list_(pa.bool_())))
    for r, out in enumerate(got.to_pylist()):
        def u(p, k):
            return int(hashlib.md5(f"42:{r}:{p}".encode()).hexdigest()[8 * k:8 * k + 8], 16) / 2 ** 32
        n = range(len(ids[r]))
        drawn = {p for p in n if special[r][p] == 0 and ner[r][p] and u(p, 0) < 0.2}
        for p in sorted(drawn):
            for step in (1, -1):
                i = p + step
                while i in n and ner[r][i]:
                    drawn.add(i)
                    i += step
        new = [FT.MASK_ID if u(p, 1) < 0.8 else int(u(p, 3) * 100) if u(p, 2) < 0.5 else ids[r][p] for p in n]
        assert out["labels"] == [ids[r][p] if p in drawn else FT.IGNORE for p in n]
        assert out["ids"] == [new[p] if p in drawn else ids[r][p] for p in n]
    df = spark.createDataFrame([(["a", "b", "a", "é"],), ([],)], "t array<string>")
    one, many = df.select(F.transform("t", lambda x: T.hashed_token_id(x, 90, 5)).alias("a"), T.hashed_token_ids("t", 90, 5).alias("b")).collect()
    assert one.a == one.b and many.a == many.b
