"""Derived inputs over the driver tables (FIXTURES.md part C).

Every fixture is a lazy DataFrame over the parquet tables, so its size grows
with the tables. Oracle SQL for the same derivations lives in
``quarry.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans.sizing import maybe_broadcast


SHORT_KEY = 8  # characters
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Text-heavy tables read from fewer splits than cores
    (one file with one row group, as in the test data) are rebalanced so the
    per-row text work runs on every core; larger inputs pass unchanged."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name in TEXT_TABLES:
        from quarry.operators.index import spread
        df = spread(df)
    return df


def oracle_norm(c):
    """FIXTURES `norm`: the narrow ASCII whitespace class used by oracles."""
    return F.trim(F.regexp_replace(c, "[ \t\n\r]+", " "))


def oracle_tok(c):
    return F.filter(F.split(oracle_norm(c), " "), lambda t: t != "")


def corpus(spark, sf_dir) -> DataFrame:
    """`corpus`: document_id = doc_id, title = source, text."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("title"), "text")


def questions(spark, sf_dir) -> DataFrame:
    """`questions`: id = item_id, question = text."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("question"))


def gold(spark, sf_dir, anchor: int = 4) -> DataFrame:
    """`gold`: (qid, document_id) for every document containing the question
    text verbatim.

    Substring containment is a theta join; it is planned as an equi-join on
    an anchor instead. If a document contains question q, the interior tokens
    t2..t(n-1) of q (bounded by whitespace on both sides inside q) are whole
    whitespace tokens of the document, in sequence. So the join key is the
    run of up to ``anchor`` interior tokens starting at t2, matched against
    every token window of the documents; ``contains`` then verifies each
    candidate. Questions of fewer than 3 tokens have no interior token: their
    key is a run of characters. An empty question is contained in none.
    """
    from quarry.operators.index import spread
    docs = spread(table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), "text"))
    qs = questions(spark, sf_dir)
    qtok = qs.select("qid", "question", T.whitespace_tokens("question").alias("t"))
    n = F.size("t")
    alen = F.least(F.lit(anchor), n - 2)
    long_q = qtok.filter(n >= 3).select(
        "qid", "question", alen.alias("alen"),
        F.array_join(F.slice("t", 2, alen), " ").alias("akey"))
    lens = [r["alen"] for r in long_q.select("alen").distinct().collect()]  # <= anchor values
    side, _ = maybe_broadcast(long_q, [F.octet_length("question"), F.octet_length("akey")])
    dtok = docs.select("document_id", T.whitespace_tokens("text").alias("t"))
    cands = None
    for L in sorted(lens):
        # explode_outer: a plain explode makes Catalyst add size(..) > 0 below
        # the projection and re-run the tokenizer inside the lambda
        win = dtok.select("document_id", F.explode_outer(F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("t") - L + 1, F.lit(1))),
            lambda i: F.array_join(F.slice("t", i, L), " "))).alias("akey")).filter(
            F.col("akey") != "")
        m = win.join(side.filter(F.col("alen") == L), "akey").select(
            "qid", "document_id", "question")
        cands = m if cands is None else cands.unionByName(m)
    # questions of < 3 tokens have no anchor of whole tokens; their key is
    # their first characters, matched against the distinct runs of as many
    # characters of each document (only planned when such questions exist)
    short_q = qtok.filter((n < 3) & (F.length("question") > 0)).select(
        "qid", "question", F.least(F.length("question"), F.lit(SHORT_KEY)).alias("klen"))
    for L in sorted(r["klen"] for r in short_q.select("klen").distinct().collect()):  # <= SHORT_KEY values
        keyed = short_q.filter(F.col("klen") == L).select("qid", "question", F.left("question", F.lit(L)).alias("key"))
        runs = docs.select("document_id", F.explode_outer(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.greatest(F.length("text") - L + 1, F.lit(1))),
            lambda i: F.substring("text", i, F.lit(L))))).alias("key"))
        m = runs.join(keyed, "key").select("qid", "document_id", "question")
        cands = m if cands is None else cands.unionByName(m)
    if cands is None:
        return spark.createDataFrame([], "qid long, document_id long")
    # verify candidates (anchor hits, not all windows) against the full text;
    # the candidate set depends on the corpus, so it is not measured up front:
    # Spark plans the lookup join and AQE broadcasts it at run time when small
    cands = cands.distinct()
    verified = docs.join(cands, "document_id").filter(
        F.col("text").contains(F.col("question"))).select("qid", "document_id")
    return verified.distinct()


def qa(spark, sf_dir) -> DataFrame:
    """`qa`: benchmark items as extractive QA rows.

    t = tok(text); context = all tokens; question = tokens 1-5; answer =
    tokens 6-7 at zero-based ``answer_start = length(question) + 1``.
    """
    b = table(spark, sf_dir, "benchmark")
    t = oracle_tok(F.col("text"))
    x = b.select(F.col("item_id").alias("id"), t.alias("t"))
    question = F.array_join(F.slice("t", 1, 5), " ")
    answer = F.array_join(F.slice("t", 6, 2), " ")
    return x.select(
        "id",
        F.concat(F.lit("item "), F.col("id").cast("string")).alias("title"),
        F.array_join("t", " ").alias("context"),
        question.alias("question"),
        F.struct(F.array(answer).alias("text"),
                 F.array((F.length(question) + 1).cast("int")).alias("answer_start")
                 ).alias("answers"),
        F.col("id").alias("document_id"))


def predictions(spark, sf_dir) -> DataFrame:
    """`predictions` by id % 5: 0 the answer; 1 the answer upper-cased in
    parentheses; 2 tokens 6-8; 3 tokens 1-2; 4 no row. ``prediction_start``
    is the zero-based position of the text in the context (-1 if absent)."""
    q = qa(spark, sf_dir).withColumn("t", F.split("context", " "))
    m = F.pmod(F.col("id"), F.lit(5))
    ans = F.col("answers.text")[0]
    pred = (F.when(m == 0, ans)
             .when(m == 1, F.concat(F.lit("("), F.upper(ans), F.lit(")")))
             .when(m == 2, F.array_join(F.slice("t", 6, 3), " "))
             .when(m == 3, F.array_join(F.slice("t", 1, 2), " ")))
    return (q.filter(m != 4)
             .select("id", pred.alias("prediction_text"), "context")
             .select("id", "prediction_text",
                     (F.instr("context", F.col("prediction_text")) - 1).cast("int")
                     .alias("prediction_start")))


def vectors(spark, sf_dir):
    """`vectors`: every embedding is a question (qid = vec_id) and every
    embedding is a passage of document vec_id div 5, so the work grows with
    the table on both sides. Returns (queries, passages)."""
    e = table(spark, sf_dir, "embeddings")
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    p = e.select(
        F.col("vec_id").alias("pid"), F.floor(F.col("vec_id") / 5).cast("long").alias("document_id"),
        F.col("embedding").alias("vec"), "label")
    return q, p


def pairs(spark, sf_dir):
    """`pairs`: embedding i as question and i+1 as passage, batch = i div 8."""
    e = table(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    b = e.select((F.col("vec_id") - 1).alias("qid"), F.col("embedding").alias("pvec"))
    return a.join(b, "qid").withColumn("batch_id", F.floor(F.col("qid") / 8).cast("long"))


def reader_features(spark, sf_dir, W: int = 32, S: int = 8) -> DataFrame:
    """`windows` + `logits`: C1 windows of W tokens (overlap S) over the qa
    contexts, context_index 0. Position 0 is the null (CLS) position with a
    null offset; position p >= 1 is window token p. Start/end logit at each
    position = round(10 u - 5, 3), u the portable uniform of
    (seed, example id, window, position) with seeds 's' and 'e'."""
    from quarry.operators.chunk import window_count
    q = qa(spark, sf_dir)
    x = q.select("id", T.token_offsets(F.col("context")).alias("o"))
    x = x.select("id", "o", F.explode_outer(F.sequence(
        F.lit(0), window_count(F.size("o"), W, S) - 1)).alias("w"))
    win = F.slice("o", F.col("w") * (W - S) + 1, W)
    null_off = F.lit(None).cast("struct<s:int,e:int>")
    offsets = F.concat(F.array(null_off), F.transform(win, lambda t: F.struct(
        t["s"].alias("s"), t["e"].alias("e"))))
    pos = F.sequence(F.lit(0), F.size(win))

    def logits(seed):
        return F.transform(pos, lambda p: F.round(
            10 * T.portable_uniform(F.lit(seed), F.col("id"), F.col("w"), p) - 5, 3))
    return x.select(F.col("id").alias("example_id"), F.col("w").alias("window_index"),
                    F.lit(0).alias("context_index"), offsets.alias("offsets"),
                    logits("s").alias("start_logits"), logits("e").alias("end_logits"))


def mlm_rows(spark, sf_dir, max_tokens: int = 128, vocab_size: int = 30000) -> DataFrame:
    """`mlm`: tok(documents.text) cut into consecutive windows of
    max_tokens - 2 tokens (the whole text, no overlap), ids hashed into the
    vocabulary, [CLS]/[SEP] around each window, ner_map = token length >= 6.
    row_id = doc_id * 1,000,000 + window (a document has far fewer windows)."""
    from quarry.operators import chunk as C
    from quarry.operators import features as FT
    W = max_tokens - 2
    d = table(spark, sf_dir, "documents").select("doc_id", oracle_tok(F.col("text")).alias("t"))
    # always >= 1 window; the _outer form avoids an inferred size() filter that
    # would re-run the tokenizer inside the window lambda
    w = d.select("doc_id", F.posexplode_outer(C.token_windows(F.col("t"), W, 0)).alias("w", "t"))
    ids = F.concat(F.array(F.lit(FT.CLS_ID)),
                   T.hashed_token_ids("t", vocab_size - FT.N_SPECIAL, FT.N_SPECIAL),
                   F.array(F.lit(FT.SEP_ID)))
    n = F.size("t")
    special = F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), n), F.array(F.lit(1)))
    ner = F.concat(F.array(F.lit(False)), F.transform("t", lambda x: F.length(x) >= 6),
                   F.array(F.lit(False)))
    return w.select((F.col("doc_id") * 1000000 + F.col("w")).alias("row_id"),
                    ids.alias("input_ids"), special.alias("special_tokens_mask"),
                    ner.alias("ner_map"))


def overlap_pairs(spark, sf_dir) -> DataFrame:
    """`overlap`: a user turn as question, the next assistant turn as context."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context"))
    return u.join(a, ["conv_id", "turn"])


def titles(spark, sf_dir) -> DataFrame:
    """`titles`: page title (text between <title> and </title>) and the page
    text (tags replaced by spaces, whitespace collapsed)."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id",
                    F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
                    T.collapse_ws(F.regexp_replace("html", "<[^>]*>", " ")).alias("text"))


def common_terms(spark, sf_dir):
    """`common_terms`: the documents' texts with the letters a, e, i, o, t as
    their only words (each is in most documents), and one question per
    benchmark item: the first two of these letters in its text."""
    letters = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[aeiot]"), F.lit(0))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    docs = d.select(F.sha2(F.col("document_id").cast("string"), 256).alias("dkey"), "document_id",
                    F.lit("").alias("title"), F.array_join(letters(F.col("text")), " ").alias("ptext"))
    q = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), F.array_join(F.slice(letters(F.col("text")), 1, 2), " ").alias("question"))
    return docs, q
