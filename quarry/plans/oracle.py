"""DuckDB SQL fragments that state the same derivations as the Spark
operators, for the oracle comparison (``__spark_entry__.oracle_sql``).

Nothing here is taken from the operators: character classes and constants are
stated again, in RE2's form, so that a wrong one in the engine shows.
"""

from __future__ import annotations

# Fixed values of SURVEY §2.2.
# White space: what Python's str.split() splits at.
SPACE = (r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
SPACE_RUN = "[" + SPACE + "]+"
ESCAPED_NEWLINE = r"\\+n"
EMPTY_BRACKETS = r"\(\)|\[\]"
# Hangul letters and syllables, ASCII letters, decimal digits, white space, symbols.
NOT_ALLOWED = (r"[^ㄱ-ㅎㅏ-ㅣ가-힣a-zA-Z\p{Nd}" + SPACE
               + r""".,'"<>!@#$%^&*()\[\]_+\-’‘“”《》〈〉~]""")
CURLY_QUOTES = "’‘“”"
ANSWER_SYMBOLS = "'\"《》<>〈〉()‘’"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPECIAL_CHAR = r"[^\p{L}\p{N}_" + SPACE + "ㄱ-ㅎㅏ-ㅣ가-힣]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def p1(x): return f"regexp_replace({x}, {lit(ESCAPED_NEWLINE)}, ' ', 'g')"
def p2(x): return f"regexp_replace({x}, {lit(NOT_ALLOWED)}, '', 'g')"
def p3(x): return f"translate({x}, {lit(CURLY_QUOTES)}, {lit(chr(39) * len(CURLY_QUOTES))})"
def p4(x): return f"regexp_replace({x}, {lit(EMPTY_BRACKETS)}, '', 'g')"
def p5(x): return f"trim(regexp_replace({x}, {lit(SPACE_RUN)}, ' ', 'g'))"


def p6(x, no_other_languages=False, quote_normalize=True):
    y = p1(x)
    if no_other_languages:
        y = p2(y)
    if quote_normalize:
        y = p3(y)
    return p5(p4(y))


def p7(x):
    return p5(p2(f"regexp_replace({p1(x)}, '#', ' ', 'g')"))


def p11(x):
    y = f"translate({x}, {lit(ANSWER_SYMBOLS)}, {lit(' ' * len(ANSWER_SYMBOLS))})"
    y = f"translate(lower({y}), {lit(PUNCTUATION)}, '')"
    return p5(y)


def toks(x):
    """T1 on already-collapsed text."""
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def tok_raw(x):
    return toks(p5(x))


def norm(x):
    """FIXTURES `norm` (oracle-only narrow whitespace)."""
    return f"trim(regexp_replace({x}, '[ \\t\\n\\r]+', ' ', 'g'))"


def tok(x):
    return f"list_filter(string_split({norm(x)}, ' '), lambda t: t <> '')"


def uniform(*parts):
    """SURVEY §2.12 portable uniform of concat_ws(':', parts)."""
    key = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0)"


def corpus_ctes() -> str:
    """P6 + P8 + J1 -> `docs(document_id, title, text, ptext)`."""
    return f"""
docs0 AS (
  SELECT doc_id AS document_id, source AS title, text,
         coalesce(source, '') || ' ' || {p6('text')} AS ptext
  FROM documents),
docs AS (
  SELECT min(document_id) AS document_id, arg_min(title, document_id) AS title,
         arg_min(text, document_id) AS text, ptext
  FROM docs0 GROUP BY ptext)"""


def questions_cte(name="qs") -> str:
    return f"{name} AS (SELECT item_id AS qid, text AS question FROM benchmark)"


def bm25_ctes(k1=1.5, b=0.75, eps=0.25) -> str:
    return corpus_ctes() + f""",
toks AS (SELECT document_id, {toks('ptext')} AS t FROM docs),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
post AS (
  SELECT document_id, dl, term, count(*) AS tf
  FROM (SELECT document_id, len(t) AS dl, unnest(t) AS term FROM toks)
  GROUP BY document_id, dl, term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf_raw FROM dfs, stats),
eps AS (SELECT {eps} * avg(idf_raw) AS e FROM raw),
terms AS (SELECT term, df, CASE WHEN idf_raw < 0 THEN e ELSE idf_raw END AS idf FROM raw, eps),
{questions_cte()},
qt AS (
  SELECT qid, term, count(*) AS qtf
  FROM (SELECT qid, unnest({toks(p6('question'))}) AS term FROM qs)
  GROUP BY qid, term),
bm25 AS (
  SELECT qid, document_id,
         sum(qtf * idf * tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))) AS score
  FROM qt JOIN terms USING (term) JOIN post USING (term), stats
  GROUP BY qid, document_id)"""


def topk_select(src: str, k: int, extra: str = "") -> str:
    return f"""
SELECT qid, rank, document_id, score{extra} FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, document_id) AS INTEGER) AS rank
  FROM (SELECT qid, document_id, round(score, 6) AS score FROM {src}))
WHERE rank <= {k}"""


def gold_cte() -> str:
    return """gold AS (
  SELECT DISTINCT b.item_id AS qid, d.doc_id AS document_id
  FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def tfidf_ctes(ngram_max=2, max_features=50000) -> str:
    assert ngram_max == 2
    grams = ("list_concat(t, CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), "
             "lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)")
    qgrams = grams.replace("t[", "u[").replace("len(t)", "len(u)").replace("(t,", "(u,")
    return corpus_ctes() + f""",
toks AS (SELECT document_id, {toks('lower(ptext)')} AS t FROM docs),
grams AS (SELECT document_id, {grams} AS g FROM toks),
nd AS (SELECT count(*) AS n FROM grams),
tf AS (
  SELECT document_id, term, count(*) AS tf
  FROM (SELECT document_id, unnest(g) AS term FROM grams)
  GROUP BY document_id, term),
cf AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY term),
vocab AS (
  SELECT term, CAST(cf AS BIGINT) AS cf, df, ln((n + 1.0) / (df + 1.0)) + 1.0 AS idf
  FROM (SELECT * FROM cf ORDER BY cf DESC, term LIMIT {max_features}), nd),
w0 AS (SELECT document_id, term, tf * idf AS w FROM tf JOIN vocab USING (term)),
w AS (SELECT document_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY document_id)) AS w FROM w0),
{questions_cte()},
qtok AS (SELECT qid, {toks('lower(' + p6('question') + ')')} AS u FROM qs),
qg AS (SELECT qid, {qgrams} AS g FROM qtok),
qt AS (
  SELECT qid, term, count(*) AS qtf
  FROM (SELECT qid, unnest(g) AS term FROM qg) GROUP BY qid, term),
qw0 AS (SELECT qid, term, qtf * idf AS wq FROM qt JOIN vocab USING (term)),
qw AS (SELECT qid, term, wq / sqrt(sum(wq * wq) OVER (PARTITION BY qid)) AS wq FROM qw0),
cosine AS (
  SELECT qid, document_id, sum(wq * w) AS score
  FROM qw JOIN w USING (term) GROUP BY qid, document_id)"""


def qa_cte(name="qa") -> str:
    q = "array_to_string(t[1:5], ' ')"
    a = "array_to_string(t[6:7], ' ')"
    return f"""{name} AS (
  SELECT item_id AS id, 'item ' || CAST(item_id AS VARCHAR) AS title,
         array_to_string(t, ' ') AS context, {q} AS question,
         {{'text': [{a}], 'answer_start': [CAST(length({q}) + 1 AS INTEGER)]}} AS answers,
         item_id AS document_id
  FROM (SELECT item_id, {tok('text')} AS t FROM benchmark))"""


def predictions_cte(name="preds") -> str:
    # Python and Java upper-case 'ß' to 'SS' (full case mapping); DuckDB keeps
    # one character, so the oracle spells that mapping out
    return f"""{name} AS (
  SELECT id, p AS prediction_text, CAST(instr(context, p) - 1 AS INTEGER) AS prediction_start
  FROM (
    SELECT id, context,
      CASE id % 5
        WHEN 0 THEN answers.text[1]
        WHEN 1 THEN '(' || upper(replace(answers.text[1], 'ß', 'ss')) || ')'
        WHEN 2 THEN array_to_string(string_split(context, ' ')[6:8], ' ')
        WHEN 3 THEN array_to_string(string_split(context, ' ')[1:2], ' ')
      END AS p
    FROM qa WHERE id % 5 <> 4))"""


def chars(x):
    return f"list_filter(string_split(replace({x}, ' ', ''), ''), lambda c: c <> '')"


def multiset_f1(p, g):
    same = (f"list_sum(list_transform(list_distinct({p}), lambda c: least("
            f"len(list_filter({p}, lambda y: y = c)), len(list_filter({g}, lambda y: y = c)))))")
    return (f"(CASE WHEN coalesce({same}, 0) = 0 THEN 0.0 ELSE "
            f"2.0 * ({same} / len({p})) * ({same} / len({g})) / "
            f"(({same} / len({p})) + ({same} / len({g}))) END)")


def char_f1(p, g):
    return multiset_f1(chars(p11(p)), chars(p11(g)))


def squad_norm(x):
    y = f"translate(lower({x}), {lit(PUNCTUATION)}, '')"
    return (f"array_to_string(list_filter({toks(p5(y))}, "
            f"lambda w: w NOT IN ('a', 'an', 'the')), ' ')")


def squad_f1(p, g):
    return multiset_f1(toks(squad_norm(p)), toks(squad_norm(g)))


def features_cte(W=32, S=8) -> str:
    """`windows` + `logits` (needs `qa`)."""
    step = W - S
    sl = f"list_transform(range(0, m + 1), lambda p: round(10 * {uniform(chr(39) + 's' + chr(39), 'id', 'w', 'p')} - 5, 3))"
    el = sl.replace("'s'", "'e'")
    return f"""ft0 AS (
  SELECT id, context, t,
         list_transform(range(1, len(t) + 1),
           lambda j: length(array_to_string(t[1:j - 1], ' ')) + CASE WHEN j > 1 THEN 1 ELSE 0 END) AS st
  FROM (SELECT id, context, string_split(context, ' ') AS t FROM qa)),
ft1 AS (
  SELECT id, context, t, st, CAST(w AS INTEGER) AS w, CAST(least({W}, len(t) - w * {step}) AS INTEGER) AS m
  FROM (SELECT *, unnest(range(0, CAST(1 + ceil(greatest(len(t) - {W}, 0) / {step}.0) AS BIGINT))) AS w FROM ft0)),
feats AS (
  SELECT id AS example_id, w AS window_index, 0 AS context_index, context,
         list_concat([NULL::STRUCT(s INTEGER, e INTEGER)],
           list_transform(range(1, m + 1), lambda p: {{'s': CAST(st[w * {step} + p] AS INTEGER),
                                                      'e': CAST(st[w * {step} + p] + length(t[w * {step} + p]) AS INTEGER)}})) AS offsets,
         {sl} AS start_logits, {el} AS end_logits
  FROM ft1)"""


def nbest_ctes(n_best=10, max_len=30, v2=False) -> str:
    null_c = ""
    if v2:
        null_c = """,
nul AS (
  SELECT example_id, window_index, s, e, start_logit, end_logit, score, cs, ce, 1 AS kind FROM (
    SELECT example_id, window_index, 0 AS s, 0 AS e, start_logits[1] AS start_logit, end_logits[1] AS end_logit,
           start_logits[1] + end_logits[1] AS score, 0 AS cs, 0 AS ce,
           row_number() OVER (PARTITION BY example_id ORDER BY start_logits[1] + end_logits[1], window_index) AS q
    FROM feats) WHERE q = 1)"""
    union = "SELECT * FROM cand" + (" UNION ALL SELECT * FROM nul" if v2 else "")
    keep = f"r <= {n_best}" + (" OR kind = 1" if v2 else "")
    return f"""{features_cte()},
sp AS (SELECT example_id, window_index, unnest(range(0, len(start_logits))) AS p, unnest(start_logits) AS v FROM feats),
ep AS (SELECT example_id, window_index, unnest(range(0, len(end_logits))) AS p, unnest(end_logits) AS v FROM feats),
stp AS (SELECT example_id, window_index, p AS s, v AS sv FROM (
          SELECT *, row_number() OVER (PARTITION BY example_id, window_index ORDER BY v DESC, p) AS q FROM sp) WHERE q <= {n_best}),
etp AS (SELECT example_id, window_index, p AS e, v AS ev FROM (
          SELECT *, row_number() OVER (PARTITION BY example_id, window_index ORDER BY v DESC, p) AS q FROM ep) WHERE q <= {n_best}),
cand AS (
  SELECT example_id, window_index, s, e, sv AS start_logit, ev AS end_logit, sv + ev AS score,
         f.offsets[s + 1].s AS cs, f.offsets[e + 1].e AS ce, 0 AS kind
  FROM stp JOIN etp USING (example_id, window_index) JOIN feats f USING (example_id, window_index)
  WHERE f.offsets[s + 1] IS NOT NULL AND f.offsets[e + 1] IS NOT NULL AND e >= s AND e - s + 1 <= {max_len}){null_c},
allc AS ({union}),
nb AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY score DESC, kind, window_index, s, e) AS r FROM allc),
kept AS (
  SELECT example_id, r, kind, score, start_logit, end_logit,
         CASE WHEN kind = 1 THEN '' ELSE substring(qa.context, cs + 1, ce - cs) END AS text,
         cs AS prediction_start, CASE WHEN kind = 1 THEN NULL ELSE 0 END AS context_index
  FROM nb JOIN qa ON qa.id = nb.example_id WHERE {keep}),
cnt AS (SELECT qa.id AS example_id, count(kept.example_id) AS n, max(CASE WHEN r = 1 THEN text END) AS t1
        FROM qa LEFT JOIN kept ON kept.example_id = qa.id GROUP BY qa.id),
allp AS (
  SELECT example_id, CAST(row_number() OVER (PARTITION BY example_id ORDER BY r) AS INTEGER)
           + CASE WHEN n = 0 OR (n = 1 AND t1 = '') THEN 1 ELSE 0 END AS rank,
         kind, score, start_logit, end_logit, text, prediction_start, context_index
  FROM kept JOIN cnt USING (example_id)
  UNION ALL
  SELECT example_id, 1, 0, 0.0, 0.0, 0.0, 'empty', 0, NULL FROM cnt WHERE n = 0 OR (n = 1 AND t1 = '')),
prob AS (
  SELECT *, round(exp(score - mx) / sum(exp(score - mx)) OVER (PARTITION BY example_id), 6) AS probability
  FROM (SELECT *, max(score) OVER (PARTITION BY example_id) AS mx FROM allp))"""
