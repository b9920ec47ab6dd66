"""Report fragments: highlighted answers and text
reports, as string expressions per row (no driver-side loops)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The HTML pieces and templates of the reference's viewer.
RED_START = '<span style="color: red;">'
BLUE_START = '<span style="color: blue;">'
SPAN_END = "</span>"
EVAL_PARAGRAPH_TEMPLATE = """
    <h1>$id</h1>
    <h2>exact match : $is_match</h2>
    <h2>question : $question</h2>
    <p>
        $paragraph
    </p>
"""
PRED_PARAGRAPH_TEMPLATE = """
    <h1>$id</h1>
    <h2>question : $question</h2>
    <p>
        $paragraph
    </p>
"""


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sub(ctx: Column, a: Column, b: Column) -> Column:
    """Python ``ctx[a:b]`` for 0 <= a, clamped like Python slicing."""
    a2 = F.least(F.greatest(a, F.lit(0)), F.length(ctx))
    b2 = F.least(F.greatest(b, a2), F.length(ctx))
    return F.substring(ctx, a2 + 1, b2 - a2)


def _wrap(ctx, a, b, start):
    return F.concat(_sub(ctx, F.lit(0), a), F.lit(start), _sub(ctx, a, b), F.lit(SPAN_END))


def highlight_eval(context, pred_start, pred_text, answer_start, answer_text) -> Column:
    """Prediction in red, answer in blue.

    Prediction not in the context (negative start) or exact match -> the
    answer in blue. Answer inside the prediction -> the
    prediction only. Overlaps are trimmed as the reference does (answer end
    moved before the prediction, or answer start moved after it); then a
    prediction entirely before or after the answer gets both spans. A
    prediction strictly inside the answer -> the answer only.
    """
    ctx, ps, pt = _c(context), _c(pred_start), _c(pred_text)
    a0, at = _c(answer_start), _c(answer_text)
    pe = ps + F.length(pt)
    ae0 = a0 + F.length(at)
    ae = F.when((ps < ae0) & (ae0 < pe), ps - 1).otherwise(ae0)
    as_ = F.when(~((ps < ae0) & (ae0 < pe)) & (ps < a0) & (a0 < pe), pe + 1).otherwise(a0)
    n = F.length(ctx)
    tail = lambda x: _sub(ctx, x, n)
    exact = (ps == a0) & (pt == at)
    contained = (ps <= a0) & (ae0 <= pe)
    red_first = F.concat(_wrap(ctx, ps, pe, RED_START), _sub(ctx, pe, as_), F.lit(BLUE_START),
                         _sub(ctx, as_, ae), F.lit(SPAN_END), tail(ae))
    blue_first = F.concat(_wrap(ctx, as_, ae, BLUE_START), _sub(ctx, ae, ps), F.lit(RED_START),
                          _sub(ctx, ps, pe), F.lit(SPAN_END), tail(pe))
    answer_only = F.concat(_wrap(ctx, a0, ae0, BLUE_START), tail(ae0))
    return (F.when(ps < 0, answer_only)          # prediction not found in the context
             .when(exact, answer_only)
             .when(contained, F.concat(_wrap(ctx, ps, pe, RED_START), tail(pe)))
             .when(pe <= as_, red_first)
             .when(ps >= ae, blue_first)
             .otherwise(answer_only))


def highlight_pred(context, pred_start, pred_text) -> Column:
    """The prediction in blue (the context unchanged when the prediction
    is not in it, i.e. its start is negative)."""
    ctx, ps = _c(context), _c(pred_start)
    pe = ps + F.length(_c(pred_text))
    return F.when(ps < 0, ctx).otherwise(
        F.concat(_wrap(ctx, ps, pe, BLUE_START), _sub(ctx, pe, F.length(ctx))))


def _fill(template: str, values: dict) -> Column:
    parts, rest = [], template
    while "$" in rest:
        i = rest.index("$")
        parts.append(F.lit(rest[:i]))
        j = i + 1
        while j < len(rest) and (rest[j].isalnum() or rest[j] == "_"):
            j += 1
        parts.append(values[rest[i + 1:j]])
        rest = rest[j:]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def eval_paragraph(id_, question, is_match, paragraph) -> Column:
    """One evaluation fragment (``is_match`` printed as True/False)."""
    m = F.when(_c(is_match), F.lit("True")).otherwise(F.lit("False"))
    return _fill(EVAL_PARAGRAPH_TEMPLATE, {"id": _c(id_).cast("string"), "question": _c(question),
                                           "is_match": m, "paragraph": _c(paragraph)})


def pred_paragraph(id_, question, paragraph) -> Column:
    """One prediction fragment."""
    return _fill(PRED_PARAGRAPH_TEMPLATE, {"id": _c(id_).cast("string"),
                                           "question": _c(question), "paragraph": _c(paragraph)})


def wrapped_lines(text, width: int = 100) -> Column:
    """The text cut into ``width``-character lines, each ending in a newline."""
    t = _c(text)
    idx = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(t) / width) - 1, F.lit(-1)).cast("int"))
    lines = F.when(F.length(t) > 0, F.transform(idx, lambda i: F.concat(
        F.substring(t, i * width + 1, width), F.lit("\n")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(lines, "")


def fixed2(x: Column) -> Column:
    """Python ``f"{x:.2f}"``: DecimalFormat rounds the exact binary value half
    to even like Python does (Java's ``%.2f`` rounds half up); no grouping."""
    return F.regexp_replace(F.format_number(x, 2), ",", "")


def overlap_report(row_id, context, question, answer, shared, ratio) -> Column:
    """``<id> <context lines>Q: .. -> A: ..\\nSAME: .. -> ACCURACY:x.xx\\n\\n``."""
    return F.concat(_c(row_id).cast("string"), F.lit(" "), wrapped_lines(context),
                    F.lit("Q: "), _c(question), F.lit(" -> A: "), _c(answer), F.lit("\n"),
                    F.lit("SAME: "), _c(shared), F.lit(" -> ACCURACY:"),
                    fixed2(_c(ratio)), F.lit("\n\n"))
