"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are read as UTF-8 bytes in windows of ``WINDOW`` bytes. Two gated
recurrent layers run over each window, one in either direction; at every byte
the two states give a probability for each language, and a document's
probabilities are the mean over all its bytes. The network is trained in numpy
by backpropagation through time on a bounded sample of labelled windows.

Gates are clip(x / 4 + 1 / 2, 0, 1) and candidates clip(x, -1, 1): piecewise
linear forms of the usual sigmoid and tanh, several times cheaper.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import frames

WINDOW = 64
HIDDEN = 8
ROWS = 2048
CHUNK_BYTES = 1 << 20
SAMPLE_TEXTS = 4000
SAMPLE_WINDOWS = 4
MOST_LANGUAGES = 256
EPOCHS = 10
UNKNOWN = "und"
LEAST_SCORE = 0.4
F32 = np.float32


@dataclass
class Network:
    """Per direction: ``table`` (byte 0-256 -> inputs of update gate, reset
    gate, candidate; 256 is padding), ``gates`` and ``own`` (state -> the
    same). ``out`` and ``bias`` give the languages from both states."""

    languages: list[str]
    table: list[np.ndarray]
    gates: list[np.ndarray]
    own: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @property
    def weights(self) -> list[np.ndarray]:
        return [*self.table, *self.gates, *self.own, self.out, self.bias]


def fresh(languages: list[str], hidden: int, rng: np.random.Generator) -> Network:
    def normal(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(F32)

    table = []
    for _ in range(2):
        t = (rng.standard_normal((257, 3 * hidden)) * 0.5).astype(F32)
        t[:, :hidden] += 1  # update gates begin rather open to the past
        table.append(t)
    return Network(languages, table, [normal(hidden, 2 * hidden) for _ in range(2)],
                   [normal(hidden, hidden) for _ in range(2)],
                   normal(2 * hidden, len(languages)), np.zeros(len(languages), F32))


def states(net: Network, steps: np.ndarray, kept: list | None = None) -> np.ndarray:
    """States of both directions, (window, rows, 2 * hidden), for bytes
    ``steps`` (window, rows). Padding (256, after a text's last byte) has learned
    inputs like any byte, but is neither trained on nor counted as a position.
    ``kept`` receives what backpropagation needs."""
    window, rows = steps.shape
    hidden = net.own[0].shape[0]
    out = np.empty((window, rows, 2 * hidden), F32)
    for d in (0, 1):
        table, gates, own = net.table[d], net.gates[d], net.own[d]
        h = np.zeros((rows, hidden), F32)
        x = np.empty((rows, 3 * hidden), F32)
        g = np.empty((rows, 2 * hidden), F32)
        c = np.empty((rows, hidden), F32)
        for t in range(window) if d == 0 else range(window - 1, -1, -1):
            np.take(table, steps[t], axis=0, out=x, mode="clip")
            np.matmul(h, gates, out=g)
            g += x[:, :2 * hidden]
            g *= F32(0.25)
            g += F32(0.5)
            np.clip(g, 0, 1, out=g)
            reset = h * g[:, hidden:]
            np.matmul(reset, own, out=c)
            c += x[:, 2 * hidden:]
            np.clip(c, -1, 1, out=c)
            if kept is not None:
                kept.append((d, t, h, g.copy(), reset, c.copy()))
            new = out[t, :, d * hidden:(d + 1) * hidden]
            np.subtract(h, c, out=new)
            new *= g[:, :hidden]
            new += c
            h = new
    return out


def probabilities(net: Network, s: np.ndarray) -> np.ndarray:
    p = s.reshape(-1, s.shape[-1]) @ net.out
    p += net.bias
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p.reshape(*s.shape[:2], -1)


def gradients(net: Network, steps: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss per byte and its gradients, in the order of ``weights``."""
    hidden = net.own[0].shape[0]
    kept: list = []
    s = states(net, steps, kept)
    p = probabilities(net, s)
    real = (steps < 256).astype(F32)
    n = max(1.0, float(real.sum()))
    rows = np.arange(steps.shape[1])
    loss = float(-(np.log(p[:, rows, label] + F32(1e-9)) * real).sum() / n)
    err = p
    err[:, rows, label] -= 1
    err *= (real / F32(n))[:, :, None]
    flat, flat_err = s.reshape(-1, 2 * hidden), err.reshape(-1, err.shape[-1])
    d_out, d_bias = flat.T @ flat_err, flat_err.sum(axis=0)
    d_states = err @ net.out.T
    tables = [np.zeros_like(t) for t in net.table]
    d_gates, d_own = [np.zeros_like(w) for w in net.gates], [np.zeros_like(w) for w in net.own]
    carry = [np.zeros((steps.shape[1], hidden), F32) for _ in range(2)]
    for d, t, h, g, reset, c in reversed(kept):
        dh = carry[d] + d_states[t, :, d * hidden:(d + 1) * hidden]
        update = g[:, :hidden]
        dc = dh * (1 - update) * ((c > -1) & (c < 1))
        d_reset = dc @ net.own[d].T
        d_own[d] += reset.T @ dc
        dg = np.concatenate([dh * (h - c), d_reset * h], axis=1)
        dg *= F32(0.25) * ((g > 0) & (g < 1))
        d_gates[d] += h.T @ dg
        into = np.concatenate([dg, dc], axis=1)
        np.add.at(tables[d], steps[t], into)
        carry[d] = dh * update + d_reset * g[:, hidden:] + dg @ net.gates[d].T
    return loss, [*tables, *d_gates, *d_own, d_out, d_bias]


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], hidden: int = HIDDEN,
          epochs: int = EPOCHS, seed: int = 0, batch: int = 256, rate: float = 0.02) -> Network:
    """Fit a network to ``windows`` (rows of bytes, 256 for padding)."""
    rng = np.random.default_rng(seed)
    net = fresh(languages, hidden, rng)
    mean = [np.zeros_like(w) for w in net.weights]
    square = [np.zeros_like(w) for w in net.weights]
    steps, total = 0, max(1, epochs * -(-len(windows) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), batch):
            rows = order[a:a + batch]
            some = windows[rows]
            # a quarter of the windows end early, as short texts do
            end = np.where(rng.random(len(rows)) < 0.25, rng.integers(4, some.shape[1] + 1, len(rows)), some.shape[1])
            some = np.where(np.arange(some.shape[1]) < end[:, None], some, 256)
            _, grads = gradients(net, np.ascontiguousarray(some.T), labels[rows])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            steps += 1
            now = rate * (1 - steps / (total + 1))
            for w, g, m, v in zip(net.weights, grads, mean, square):
                g = g * F32(min(1.0, 1.0 / (norm + 1e-6)))
                m += (g - m) * F32(0.1)
                v += (g * g - v) * F32(0.01)
                w -= F32(now) * (m / F32(1 - 0.9 ** steps)) / (np.sqrt(v / F32(1 - 0.99 ** steps)) + F32(1e-6))
    return net


def cut(raw: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, (windows, bytes) with padding 256, and the
    text of each."""
    sizes = np.diff(offsets)
    n = -(-sizes // window)
    text = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][text] + k * window
    at = start[:, None] + np.arange(window)[None, :]
    out = np.full(at.shape, 256, np.int16)
    ok = at < offsets[1:][text][:, None]
    out[ok] = raw[at[ok]]
    return out, text


def document_probabilities(net: Network, raw: np.ndarray, offsets: np.ndarray,
                           window: int = WINDOW) -> np.ndarray:
    """Mean probabilities over the bytes of each text, (texts, languages);
    zero rows for empty texts."""
    docs = len(offsets) - 1
    total = np.zeros((docs, len(net.languages)))
    # ROWS windows at a time, counted through all texts
    windows_before = np.concatenate([[0], np.cumsum(-(-np.diff(offsets) // window))])
    count = int(windows_before[-1])
    for a in range(0, count, ROWS):
        b = min(a + ROWS, count)
        number = np.arange(a, b)
        text = np.searchsorted(windows_before, number, side="right") - 1
        start = offsets[text] + (number - windows_before[text]) * window
        at = start[None, :] + np.arange(window)[:, None]
        inside = at < offsets[text + 1][None, :]
        steps = np.where(inside, raw[np.minimum(at, len(raw) - 1)], np.int16(256)).astype(np.intp)
        p = probabilities(net, states(net, steps))
        p *= inside[:, :, None]
        np.add.at(total, text, p.sum(axis=0, dtype=np.float64))
    size = np.maximum(np.diff(offsets), 1)
    return total / size[:, None]


def labelled_sample(docs: DataFrame, texts: int = SAMPLE_TEXTS) -> tuple[list[str], list[tuple[int, bytes]]]:
    """Languages and (language number, text) of up to about ``texts`` labelled
    documents, as many of each language, chosen by a hash of the id."""
    counts = {r[0]: r[1] for r in docs.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(counts)
    if not languages:
        return [], []
    each = max(1, texts // len(languages))
    draw = (F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(each / counts[lang])).otherwise(share)
    longest = SAMPLE_WINDOWS * WINDOW
    # a part of each chosen text, from a place that the hash chooses
    binary = F.col("text").cast("binary")
    size = F.octet_length("text")
    room = F.greatest(size - longest, F.lit(0))
    begin = F.floor(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20)) * (room + 1))
    rows = (docs.filter(draw < share)
            .select("lang", F.substring(binary, (begin + 1).cast("int"), F.lit(longest)).alias("part"), draw.alias("draw"))
            .orderBy("draw").limit(2 * texts).collect())
    number = {lang: i for i, lang in enumerate(languages)}
    return languages, [(number[r["lang"]], bytes(r["part"])) for r in rows if r["part"]]


def held_out() -> Column:
    """Whether a document is never learned from: CRC-32 of its id as text is a
    multiple of 5. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, hidden: int = HIDDEN,
        epochs: int = EPOCHS) -> Network | None:
    """A network for the languages of the labelled, not held-out documents
    with text; None if there are none."""
    usable = docs.filter(F.col("lang").isNotNull() & (F.octet_length("text") > 0) & ~held_out())
    languages, sample = labelled_sample(usable.select("doc_id", "text", "lang"), sample_texts)
    if not sample:
        return None
    raw = np.frombuffer(b"".join(p for _, p in sample), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) for _, p in sample])])
    windows, text = cut(raw, offsets)
    labels = np.array([i for i, _ in sample])[text]
    return train(windows.astype(np.intp), labels, languages, hidden, epochs)


def has_letter() -> Column:
    """Whether the text has a character of Unicode category L (a fraction, a
    circled digit or a combining mark alone is none); false for null."""
    return F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))


def _predict(net):
    def run(batches):
        model = net.value
        for batch in batches:
            raw, offsets = frames.utf8(batch.column("text"))
            known = batch.column("letter").to_numpy(zero_copy_only=False) & (model is not None)
            names = np.full(len(batch), UNKNOWN, object)
            score = np.zeros(len(batch))
            if model is not None:
                for i, j in frames.chunks(offsets, CHUNK_BYTES):
                    p = document_probabilities(model, raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                    best = p.argmax(axis=1)
                    names[i:j] = np.array(model.languages, object)[best]
                    score[i:j] = np.clip(p[np.arange(j - i), best], 0, 1)
                names[~known], score[~known] = UNKNOWN, 0.0
            yield pa.record_batch([batch.column("doc_id"), batch.column("tag"), batch.column("held_out"),
                                   pa.array(names, pa.string()), pa.array(score)],
                                  names=["doc_id", "tag", "held_out", "lang_pred", "score"])
    return frames.lean(run)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, tag, held_out, lang_pred, score`` for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights a language
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), frames.text_tag().alias("tag"),
                       held_out().alias("held_out"), has_letter().alias("letter"), "text")
    return rows.mapInArrow(_predict(model), "doc_id long, tag long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``
    (doc_id, text, lang), learned from its labelled rows.

    ``und`` with score 0 where the text is null or has no letter, and
    everywhere if no labelled text may be learned from. A null label is not
    learned from; repeated rows get equal predictions. No rows give no rows;
    other columns are not read. A text is held whole by its task, with about
    eight bytes for each of its bytes beside windows of a fixed size.
    """
    return predict(docs, fit(docs, sample_texts)).drop("tag")


def _identified(net, least: float):
    def run(batches):
        for batch in batches:
            row = batch.column("row")
            none = pa.nulls(len(batch), pa.int64())
            text = row.field(row.type.get_field_index("text"))
            given = pa.record_batch([none, none, pa.nulls(len(batch), pa.bool_()), batch.column("letter"), text],
                                    names=["doc_id", "tag", "held_out", "letter", "text"])
            found = next(_predict(net)([given]))
            keep = pc.and_(pc.not_equal(found.column("lang_pred"), UNKNOWN), pc.greater_equal(found.column("score"), least))
            yield pa.record_batch([row.filter(keep)], names=["row"])
    return frames.lean(run)


def keep_identified(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without the rows that have no language: those without a letter
    (``und``) and those whose best language gets less than ``least_score`` of
    the probability, averaged over their bytes. All columns stay, whatever
    their names. Null and empty texts go; repeated rows are judged alike;
    where no labelled text may be learned from, no row has a language; an
    empty table gives no rows. A text is held whole by its task."""
    net = docs.sparkSession.sparkContext.broadcast(fit(docs, sample_texts))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, has_letter().alias("letter"))
    kept = rows.mapInArrow(_identified(net, least_score), rows.select("row").schema)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
