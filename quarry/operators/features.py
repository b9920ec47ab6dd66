"""Feature tables for readers and encoders.

Token model: the sub-word tokenizers of the reference are not rebuilt
(SURVEY "Not built"). Tokens here are whitespace tokens with code-point
offsets (T3), and a token id is a hash of the token text into the vocabulary
(``quarry.functions.text.hashed_token_id``). The special tokens below take the
first ids. Every operator is an array expression over one row, so a row's
windows, labels and masks never leave its task; the only cross-row operators
are batch padding (C10, a window over a bounded batch) and dense row numbers
(``chunk.number_rows``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.chunk import number_rows, window_count
from quarry.session import materialize

# Special token ids and ignore label (BERT-style layout).
PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID = 0, 1, 2, 3, 4
N_SPECIAL = 5
IGNORE = -100
SPECIAL_TEXT = {"[PAD]": PAD_ID, "[UNK]": UNK_ID, "[CLS]": CLS_ID, "[SEP]": SEP_ID,
                "[MASK]": MASK_ID}


def token_id(tok: Column, vocab_size: int = 30000) -> Column:
    """Special-token text -> its id; other tokens hash into [N_SPECIAL, vocab)."""
    e = T.hashed_token_id(tok, vocab_size - N_SPECIAL, N_SPECIAL)
    for text, i in SPECIAL_TEXT.items():
        e = F.when(tok == text, F.lit(i)).otherwise(e)
    return e


def _ids(toks: Column, vocab_size: int) -> Column:
    return F.transform(toks, lambda t: token_id(t, vocab_size))


# --------------------------------------------------------------------------
# Question-aware overflow windows with labels
# --------------------------------------------------------------------------

def reader_windows(df: DataFrame, max_seq_length: int = 384, doc_stride: int = 128,
                   id_col: str = "id", question: str = "question", context: str = "context",
                   context_index: str | None = None, vocab_size: int = 30000,
                   keep: tuple[str, ...] = (), status: str | None = None) -> DataFrame:
    """C3 (+C5): one row per window of the context that fits next to the
    question: ``[CLS] question [SEP] context-window [SEP]``.

    Context tokens per window = max_seq_length - |question| - 3; consecutive
    windows overlap by ``doc_stride``. Offsets are null outside the context
    (C5). Special-token texts count as such in the question (P9 puts a
    separator there), not in the context.

    A question that leaves no more than ``doc_stride`` context tokens has no
    windows. No row is lost over it: with ``status`` (a column name) it keeps
    one row with null arrays and status ``question_too_long`` (``ok``
    otherwise), without it the query fails.
    """
    qt = T.whitespace_tokens(F.col(question))
    co = T.token_offsets(F.col(context))
    ci = F.col(context_index) if context_index else F.lit(0)
    x = df.select(F.col(id_col).alias("example_id"), ci.alias("context_index"),
                  *keep, qt.alias("_qt"), co.alias("_co"))
    W = F.lit(max_seq_length) - F.size("_qt") - 3
    fits = W > doc_stride
    if status is None:
        x = x.withColumn("_W", F.when(fits, W).otherwise(F.raise_error(F.concat(
            F.lit("question too long: "), F.col("example_id").cast("string"))).cast("int")))
    else:
        # any width over the stride: the row's arrays become null below
        x = x.withColumn("_W", F.when(fits, W).otherwise(F.lit(doc_stride + 1))).withColumn("_fits", fits)
        x = x.withColumn("_co", F.when(F.col("_fits"), F.col("_co")).otherwise(F.slice("_co", 1, 0)))
    n = window_count(F.size("_co"), F.col("_W"), F.lit(doc_stride))
    x = x.withColumn("window_index", F.explode_outer(F.sequence(F.lit(0), n - 1)))
    win = F.slice("_co", F.col("window_index") * (F.col("_W") - doc_stride) + 1, F.col("_W"))
    x = x.withColumn("_win", win)
    nq = F.size("_qt")
    null_off = F.lit(None).cast("struct<s:int,e:int>")
    ids = F.concat(F.array(F.lit(CLS_ID)), _ids(F.col("_qt"), vocab_size), F.array(F.lit(SEP_ID)),
                   F.transform("_win", lambda t: T.hashed_token_id(t["tok"], vocab_size - N_SPECIAL, N_SPECIAL)),
                   F.array(F.lit(SEP_ID)))
    types = F.concat(F.array_repeat(F.lit(0), nq + 2), F.array_repeat(F.lit(1), F.size("_win") + 1))
    offs = F.concat(F.array_repeat(null_off, nq + 2),
                    F.transform("_win", lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"))),
                    F.array(null_off))
    out = x.select("example_id", "window_index", "context_index", *keep,
                   ids.alias("input_ids"), types.alias("token_type_ids"),
                   F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"),
                   offs.alias("offset_mapping"), *([F.col("_fits")] if status else []))
    if status is None:
        return out
    arrays = ("input_ids", "token_type_ids", "attention_mask", "offset_mapping")
    out = out.withColumns({c: F.when(F.col("_fits"), F.col(c)) for c in arrays})
    return out.withColumn(status, F.when(F.col("_fits"), "ok").otherwise("question_too_long")).drop("_fits")


def too_long_questions(df: DataFrame, max_seq_length: int = 384, doc_stride: int = 128,
                       id_col: str = "id", question: str = "question") -> DataFrame:
    """Audit for C3: questions too long to leave ``doc_stride`` context tokens."""
    n = F.size(T.whitespace_tokens(F.col(question)))
    return df.filter(F.lit(max_seq_length) - n - 3 <= doc_stride).select(id_col)


def span_labels(offsets: Column, start_char: Column, end_char: Column,
                has_answer: Column) -> tuple[Column, Column]:
    """Token span of the answer [start_char, end_char) in one window.

    Only context positions (non-null offsets) count. (CLS, CLS) = (0, 0)
    when there is no answer, the answer is (0, 0), or it is not fully inside
    the window; otherwise start = last context token starting at or before
    start_char, end = first context token ending at or after end_char.
    """
    pos = F.sequence(F.lit(0), F.size(offsets) - 1)
    ctx = F.filter(pos, lambda p: F.element_at(offsets, p + 1).isNotNull())
    first = F.element_at(offsets, F.element_at(ctx, 1) + 1)
    last = F.element_at(offsets, F.element_at(ctx, -1) + 1)
    inside = (F.size(ctx) > 0) & (first["s"] <= start_char) & (last["e"] >= end_char)
    ok = has_answer & ~((start_char == 0) & (end_char == 0)) & inside
    s = F.array_max(F.filter(ctx, lambda p: F.element_at(offsets, p + 1)["s"] <= start_char))
    e = F.array_min(F.filter(ctx, lambda p: F.element_at(offsets, p + 1)["e"] >= end_char))
    return (F.when(ok, s).otherwise(F.lit(0)).cast("int"),
            F.when(ok, e).otherwise(F.lit(0)).cast("int"))


def with_span_labels(features: DataFrame, examples: DataFrame, offsets: str = "offset_mapping",
                     id_col: str = "id", answers: str = "answers") -> DataFrame:
    """C6 for a feature table: join each window to its example's first
    answer and add ``start_positions``, ``end_positions``."""
    ex = examples.select(F.col(id_col).alias("example_id"),
                         F.element_at(F.col(answers + ".answer_start"), 1).alias("_sc"),
                         F.element_at(F.col(answers + ".text"), 1).alias("_at"))
    j = features.join(ex, "example_id", "left")
    sc = F.coalesce(F.col("_sc"), F.lit(0))
    ec = sc + F.coalesce(F.length("_at"), F.lit(0))
    s, e = span_labels(F.col(offsets), sc, ec, F.col("_sc").isNotNull())
    return j.withColumn("start_positions", s).withColumn("end_positions", e).drop("_sc", "_at")


def span_labels_from_offsets(features: DataFrame, examples: DataFrame) -> DataFrame:
    """C6 on a feature table whose offsets column is ``offsets``."""
    return with_span_labels(features, examples, offsets="offsets")


def merge_title_segment(df: DataFrame, labels: bool = True, status: str | None = None) -> DataFrame:
    """``[CLS] q [SEP] title [SEP] ctx [SEP]`` -> ``[CLS] q [SEP] title ctx [SEP]``.

    Drops the second separator from every parallel array, marks the title
    tokens as segment 1, and shifts span labels by -1 (never below 0).

    A row without exactly three separators (see :func:`bad_title_segments`)
    fails the query, or, with ``status`` (a column name, which C3 may have
    filled), stays as it is with status ``no_title_segment``.
    """
    ids = F.coalesce(F.col("input_ids"), F.array().cast("array<int>"))
    marks = F.transform(ids, lambda v, i: F.when(v == SEP_ID, i).otherwise(-1))
    x = df.withColumn("_seps", F.filter(marks, lambda i: i >= 0))
    good = F.size("_seps") == 3
    if status is None:
        x = x.withColumn("_seps", F.when(good, F.col("_seps")).otherwise(
            F.raise_error(F.lit("a row without exactly three separators")).cast("array<int>")))
    else:
        before = F.col(status) if status in df.columns else F.lit("ok")
        x = x.withColumn(status, F.when((before == "ok") & ~good, "no_title_segment").otherwise(before))
        # positions that no element has: nothing is dropped or shifted
        x = x.withColumn("_seps", F.when(good, F.col("_seps")).otherwise(F.array(F.lit(-1), F.lit(-1))))
    s1, s2 = F.element_at("_seps", 1), F.element_at("_seps", 2)

    def drop2(c):
        return F.filter(F.col(c), lambda v, i: i != s2)
    x = (x.withColumn("token_type_ids", F.filter(F.transform(
            "token_type_ids", lambda v, i: F.when((i > s1) & (i < s2), F.lit(1)).otherwise(v)),
            lambda v, i: i != s2))
          .withColumn("input_ids", drop2("input_ids"))
          .withColumn("attention_mask", drop2("attention_mask")))
    if "offset_mapping" in df.columns:
        x = x.withColumn("offset_mapping", drop2("offset_mapping"))
    if labels and "start_positions" in df.columns:
        x = x.withColumns({c: F.when(s2 < 0, F.col(c)).otherwise(F.greatest(F.col(c) - 1, F.lit(0)))
                           for c in ("start_positions", "end_positions")})
    return x.drop("_seps")


def bad_title_segments(df: DataFrame) -> DataFrame:
    """C7 audit: rows without exactly three separators."""
    ids = F.col("input_ids")
    n = F.size(F.filter(ids, lambda v: v == SEP_ID))
    return df.filter(n != 3)


def answerability(start_positions) -> Column:
    """1.0 when the start label is past CLS, else 0.0."""
    c = F.col(start_positions) if isinstance(start_positions, str) else start_positions
    return F.when(c > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def multi_context(df: DataFrame, title: str = "title", context: str = "context") -> DataFrame:
    """C4: each of the k retrieved (title, context) pairs becomes its own row
    with ``context_index``."""
    z = F.posexplode(F.arrays_zip(F.col(title).alias("t"), F.col(context).alias("c")))
    rest = [c for c in df.columns if c not in (title, context)]
    return df.select(*rest, z.alias("context_index", "_z")).select(
        *rest, "context_index", F.col("_z.t").alias(title), F.col("_z.c").alias(context))


# --------------------------------------------------------------------------
# Answer-centred encoder windows
# --------------------------------------------------------------------------

def answer_centred(df: DataFrame, max_passage_length: int = 512, context: str = "context",
                   answers: str = "answers", vocab_size: int = 30000) -> DataFrame:
    """C8 + C9: contexts longer than L = max_passage_length - 2 tokens are cut
    to L tokens around the answer's token midpoint (shifted back inside the
    text), then wrapped in [CLS] ... [SEP] and padded to max_passage_length.
    Adds ``p_input_ids``, ``p_attention_mask``, ``p_token_type_ids``,
    ``window_start``."""
    L = max_passage_length - 2
    co = T.token_offsets(F.col(context))
    x = df.withColumn("_co", co)
    n = F.size("_co")
    sc = F.element_at(F.col(answers + ".answer_start"), 1)
    ec = sc + F.length(F.element_at(F.col(answers + ".text"), 1))
    pos = F.sequence(F.lit(0), n - 1)
    ts = F.coalesce(F.array_max(F.filter(pos, lambda p: F.element_at("_co", p + 1)["s"] <= sc)), F.lit(0))
    te = F.coalesce(F.array_min(F.filter(pos, lambda p: F.element_at("_co", p + 1)["e"] >= ec)), n - 1)
    mid = F.floor((ts + te) / 2)
    start = F.when(n <= L, F.lit(0)).otherwise(
        F.least(F.greatest(mid - (L // 2 + L % 2), F.lit(0)), n - L)).cast("int")
    x = x.withColumn("window_start", start)
    win = F.slice("_co", F.col("window_start") + 1, L)
    ids = F.concat(F.array(F.lit(CLS_ID)), _ids(F.transform(win, lambda t: t["tok"]), vocab_size),
                   F.array(F.lit(SEP_ID)))
    pad = F.lit(max_passage_length) - F.size(ids)
    return (x.withColumn("p_input_ids", F.concat(ids, F.array_repeat(F.lit(PAD_ID), pad)))
             .withColumn("p_attention_mask", F.concat(F.array_repeat(F.lit(1), F.size(ids)),
                                                      F.array_repeat(F.lit(0), pad)))
             .withColumn("p_token_type_ids", F.array_repeat(F.lit(0), F.lit(max_passage_length)))
             .drop("_co"))


def pad_to_length(arr: Column, length: int, pad_value: int = PAD_ID) -> Column:
    """Truncate or right-pad an id array to a fixed length."""
    t = F.slice(arr, 1, length)
    return F.concat(t, F.array_repeat(F.lit(pad_value), F.lit(length) - F.size(t)))


# --------------------------------------------------------------------------
# Batch padding
# --------------------------------------------------------------------------

def batch_pad(df: DataFrame, order_col: str, batch_size: int, col: str = "input_ids",
              pad_to_multiple_of: int | None = None, padding_side: str = "right",
              pad_value: int = PAD_ID, n_ranges: int | None = None) -> DataFrame:
    """Rows in ``order_col`` order form batches of ``batch_size``; each
    array is padded to the longest in its batch, rounded up to a multiple.
    Row numbers come from ``chunk.number_rows`` (any orderable key) and the
    padding length from a window over one batch (a bounded group), both over
    keys and sizes only; the arrays are joined to them once."""
    stored = materialize(df, "batch-rows")
    sizes = stored.select(order_col, F.size(col).alias("_len"))
    rows = number_rows(sizes, order_col, "row_index", n_ranges).withColumn(
        "batch_id", F.floor(F.col("row_index") / batch_size).cast("long"))
    rows = rows.withColumn("_mx", F.max("_len").over(Window.partitionBy("batch_id")))
    x = stored.join(rows.drop("_len"), order_col)
    mx = F.col("_mx")
    if pad_to_multiple_of:
        mx = F.ceil(mx / pad_to_multiple_of) * pad_to_multiple_of
    x = x.withColumn("_len", mx.cast("int"))
    pad = F.array_repeat(F.lit(pad_value), F.col("_len") - F.size(col))
    padded = F.concat(F.col(col), pad) if padding_side == "right" else F.concat(pad, F.col(col))
    return x.withColumn(col, padded).drop("_len", "_mx")


# --------------------------------------------------------------------------
# C11-C14: language-model labels
# --------------------------------------------------------------------------

def mlm_mask(df: DataFrame, seed: int = 42, mlm_probability: float = 0.15,
             id_col: str = "row_id", ids: str = "input_ids",
             special: str = "special_tokens_mask", ner: str | None = None,
             span_masking: bool = False, vocab_size: int = 30000) -> DataFrame:
    """Masked-LM inputs and labels from seeded hash uniforms instead
    of a random generator, so results do not depend on partitioning or task
    retries.

    Per position, md5(seed:row:position) gives four uniforms (its four
    8-hex-digit slices): draw, mask-vs-other, random-vs-keep, random id. A
    non-special position (restricted to ``ner`` positions when given) is
    drawn with probability ``mlm_probability``; with ``span_masking`` a drawn
    entity position extends to its whole contiguous run of entity positions.
    Drawn positions: 80 % -> [MASK], 10 % -> random id, 10 % unchanged.
    Labels are the original ids at drawn positions, -100 elsewhere.
    """
    mask = F.arrow_udf(_masked(seed, mlm_probability, bool(ner), span_masking, vocab_size),
                       "struct<ids:array<int>,labels:array<int>>")
    own = F.col(ner).cast("array<boolean>") if ner else F.lit(None).cast("array<boolean>")
    x = df.withColumn("_m", mask(F.col(id_col).cast("string"), F.col(ids).cast("array<int>"),
                                 F.col(special).cast("array<int>"), own))
    return x.withColumn("labels", F.col("_m.labels")).withColumn(ids, F.col("_m.ids")).drop("_m")


def _masked(seed: int, probability: float, ner: bool, spans: bool, vocab_size: int):
    """:func:`mlm_mask` of Arrow columns: row ids, token ids, special and entity
    flags. Only positions that can be drawn are hashed."""
    def flat(lists, missing):
        return pc.fill_null(lists.flatten(), missing).to_numpy(zero_copy_only=False)

    def run(rows: pa.Array, ids: pa.Array, special: pa.Array, entity: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(size)])
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(start[-1]) - start[row]
        value = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        named = flat(entity, False).astype(bool) if ner else np.ones(len(value), bool)
        if len(named) != len(value):
            raise ValueError("every token id needs an entity flag")
        eligible = (flat(special, 1) == 0) & named
        whole = named if ner and spans else eligible
        # four uniforms a position, of md5(seed:row:position)
        at = np.flatnonzero(whole | eligible)
        heads = [f"{seed}:{r}:" if r is not None else f"{seed}:" for r in rows.to_pylist()]
        digests = b"".join([hashlib.md5(f"{heads[r]}{p}".encode(), usedforsecurity=False).digest()
                            for r, p in zip(row[at].tolist(), place[at].tolist())])
        u = np.frombuffer(digests, ">u4").reshape(-1, 4) / 4294967296.0
        drawn = eligible[at] & (u[:, 0] < probability)
        if ner and spans:
            # a run of entities: its row and the number of other positions before it
            key = np.cumsum(~named)[at] + row[at]
            drawn |= named[at] & np.isin(key, key[drawn])
        at, u = at[drawn], u[drawn]
        labels = np.full(len(value), IGNORE, np.int32)
        labels[at] = value[at]
        value = value.copy()
        other = np.where(u[:, 2] < 0.5, np.floor(u[:, 3] * vocab_size), value[at])
        value[at] = np.where(u[:, 1] < 0.8, MASK_ID, other)
        ends = pa.array(start.astype(np.int32))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(value)),
                                           pa.ListArray.from_arrays(ends, pa.array(labels))], ["ids", "labels"])
    return run


def causal_labels(ids: Column, pad_id: int = PAD_ID) -> Column:
    """C14: labels = inputs with padding -> -100."""
    return F.transform(ids, lambda v: F.when(v == pad_id, F.lit(IGNORE)).otherwise(v))
