"""Toxicity by a weighted grammar of composed finite-state transducers.

A text is cut into clauses. In every clause the words are mapped to symbols
(insult, threat verb, modal, target, negation, reported speech, other) and the
symbols run through one deterministic transducer, the composition of four:

* ``threats``: a threat verb soon after a modal ("will ... hurt") is a menace,
  elsewhere an ordinary word;
* ``negation``: insults and menaces within three words after a negation are
  marked ``no``;
* ``reported``: after a verb of saying they are marked ``said``;
* ``targets``: after a word that names a person they are marked ``you``; a
  target after an insult is an ``address``, after a menace a menace at it.

What comes out are events (``insult``, ``insult+no``, ``menace+you``, ...).
Each has a weight; a document's score is 1 - exp(-sum of weights), so that every
matched clause independently adds its chance (a noisy or), with a small weight
that every document has.

Learning. The weights are fitted to labelled rows by expectation maximisation,
drawn towards those of ``prior`` where rows are few. Insults are the words of
``INSULTS`` and those that begin with a learned stem: a beginning of words that
labelled toxic texts use in many different surroundings and other texts hardly
use (``insult``) or seldom use (``hint``, an insult with a weight of its own).
Surroundings are counted, not documents, so a text with many copies counts
once. Both use about ``SAMPLE_LABELS`` labelled ids, chosen by a hash;
everything else covers all rows.

Scale. The sample's ids are broadcast (bounded by that parameter). Scoring is
one pass without a shuffle; a clause without an insult or threat verb is left
after a look-up of its words (kept for up to ``MEMO_WORDS`` words a task).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import frames
from quarry.session import materialize

SAMPLE_LABELS = 20_000
MOST_STEMS = 5000
STEM_POINTS = (4, 16)
LEAST_SURROUNDINGS = 12
RATIOS = {"insult": 100.0, "hint": 20.0}
MEMO_WORDS = 200_000
MOST_EVENTS = 5
CHUNK_BYTES = 1 << 20

# Words of the grammar: plain English, with negations, targets and verbs of
# saying of some other languages.
INSULTS = """idiot idiots idiotic moron morons moronic stupid dumb imbecile loser losers scum trash
garbage pathetic worthless disgusting clown clowns fool fools vermin filth filthy scumbag pig pigs
creep coward cowards degenerate lowlife retarded bastard bastards jerk ugly""".split()
THREATS = "kill hurt beat destroy shoot stab murder smash punch crush burn hang strangle".split()
MODALS = "will gonna going shall must should gotta 'll i'll we'll they'll he'll she'll want".split()
TARGETS = """you your you're u yours yourself he she him her they them he's she's they're these those
du dich dein ihr tu toi ton votre vous tú eres usted""".split()
NEGATIONS = """not no never nobody none neither nor without isn't aren't wasn't weren't ain't don't doesn't
didn't can't cannot won't nicht kein keine nie pas jamais nunca""".split()
REPORTS = """said says say called calls told tells wrote writes claimed claims quoted quote allegedly
sagte nannte dit disait dijo llamó""".split()

OTHER = "other"
SYMBOLS = [OTHER, "insult", "hint", "threat", "modal", "target", "negation", "report"]
_CLAUSE = re.compile(r"[^.!?;|\n\r]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


# ------------------------------------------------------------------ transducers

@dataclass(frozen=True)
class Transducer:
    """Deterministic: (state, symbol) to (state, symbol written)."""

    start: object
    arcs: dict = field(default_factory=dict)

    @property
    def inputs(self) -> list:
        return list(dict.fromkeys(x for _, x in self.arcs))


def complete(start, states, inputs, step) -> Transducer:
    return Transducer(start, {(s, x): step(s, x) for s in states for x in inputs})


def written(t: Transducer) -> list[str]:
    return list(dict.fromkeys(y for _, y in t.arcs.values()))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What ``second`` writes when it reads what ``first`` writes, as one
    transducer over the pairs of states that can be reached."""
    start = (first.start, second.start)
    arcs, todo, known = {}, [start], {start}
    inputs = first.inputs
    while todo:
        a, b = state = todo.pop()
        for x in inputs:
            a_next, y = first.arcs[a, x]
            b_next, z = second.arcs[b, y]
            arcs[state, x] = ((a_next, b_next), z)
            if (a_next, b_next) not in known:
                known.add((a_next, b_next))
                todo.append((a_next, b_next))
    return Transducer(start, arcs)


def marked(symbol: str) -> bool:
    """Whether the symbol stands for an insult or a menace, with any marks."""
    return symbol.split("+")[0] in ("insult", "hint", "menace")


def threats(inputs, scope: int = 4) -> Transducer:
    def step(s, x):
        if x == "modal":
            return scope, OTHER
        if x == "threat":
            return (0, "menace") if s else (0, OTHER)
        return max(0, s - 1), x
    return complete(0, range(scope + 1), inputs, step)


def negation(inputs, scope: int = 3) -> Transducer:
    def step(s, x):
        if x == "negation":
            return scope, OTHER
        return max(0, s - 1), x + "+no" if s and marked(x) else x
    return complete(0, range(scope + 1), inputs, step)


def reported(inputs) -> Transducer:
    def step(s, x):
        if x == "report":
            return True, OTHER
        return s, x + "+said" if s and marked(x) else x
    return complete(False, (False, True), inputs, step)


def targets(inputs) -> Transducer:
    def step(s, x):
        if x == "target":
            return "you", {"insult": "address", "hint": "address", "menace": "menace+you"}.get(s, OTHER)
        if not marked(x):
            return s, OTHER
        kind = x.split("+")[0]
        if kind != "menace" and s == "you":
            return "you", x + "+you"
        return kind, x
    return complete("", ("", "you", "insult", "hint", "menace"), inputs, step)


def grammar() -> Transducer:
    machine = threats(SYMBOLS)
    for build in (negation, reported, targets):
        machine = compose(machine, build(written(machine)))
    return machine


EVENTS = [e for e in written(grammar()) if e != OTHER]


def prior(event: str) -> float:
    """The weight that an event has before any label is seen."""
    base, *marks = event.split("+")
    weight = {"insult": 1.0, "hint": 0.3, "menace": 0.8, "address": 0.4}[base]
    for mark in marks:
        weight *= {"no": 0.2, "said": 0.4, "you": 1.5}[mark]
    return weight


@dataclass
class Model:
    """The grammar as tables, its words and stems and the weights of its events."""

    stems: dict[str, str] = field(default_factory=dict)  # beginning of a word to insult or hint
    weights: np.ndarray = field(default_factory=lambda: np.array([prior(e) for e in EVENTS]))
    always: float = 0.02

    def __post_init__(self):
        machine = grammar()
        number = {s: i for i, s in enumerate(dict.fromkeys([machine.start, *(s for s, _ in machine.arcs)]))}
        event = {OTHER: -1, **{e: i for i, e in enumerate(EVENTS)}}
        self.step = [[(0, -1)] * len(SYMBOLS) for _ in number]
        for (s, x), (t, y) in machine.arcs.items():
            self.step[number[s]][SYMBOLS.index(x)] = (number[t], event[y])
        self.words = {}
        for name, words in (("insult", INSULTS), ("threat", THREATS), ("modal", MODALS), ("target", TARGETS),
                            ("negation", NEGATIONS), ("report", REPORTS)):
            for w in words:
                self.words.setdefault(w, SYMBOLS.index(name))
        self.sizes = sorted({len(x) for x in self.stems})
        self.loud = frozenset(SYMBOLS.index(x) for x in ("insult", "hint", "threat"))
        self.memo: dict[str, int] = {}

    def symbol(self, word: str) -> int:
        """The symbol of a word: its own, or that of its longest stem."""
        found = self.words.get(word.replace("’", "'"))
        if found is None:
            found = 0
            for k in self.sizes:
                kind = self.stems.get(word[:k]) if len(word) >= k else None
                if kind is not None:
                    found = SYMBOLS.index(kind)
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        self.memo[word] = found
        return found

    def events(self, text: str) -> list[int]:
        """How often each event of ``EVENTS`` happens in the clauses of the text."""
        counts = [0] * len(EVENTS)
        step, known, symbol = self.step, self.memo.get, self.symbol
        quiet = self.loud.isdisjoint
        for clause in _CLAUSE.finditer(text.lower()):
            symbols = [known(w) if known(w) is not None else symbol(w) for w in _WORD.findall(clause.group())]
            if quiet(symbols):
                continue
            state = 0
            for x in symbols:
                state, event = step[state][x]
                if event >= 0:
                    counts[event] += 1
        return counts

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Chance that a text with these event counts (rows) is toxic."""
        return -np.expm1(-(self.always + np.minimum(counts, MOST_EVENTS) @ self.weights))


# ------------------------------------------------------------------ learning

def held_out() -> Column:
    """Whether a document's label is never learned from: CRC-32 of its id as
    text is 2 modulo 4. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_LABELS) -> DataFrame:
    """``text, toxic`` of about ``most`` labelled ids that are not held out. An
    id with several labels is toxic if one says so; null labels and ids are left out."""
    usable = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") != 0).cast("int").alias("toxic"))
              .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = most / max(1, usable.count())
    draw = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = usable.filter(draw < F.lit(share))  # about ``most`` ids at any size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.join(F.broadcast(chosen), "doc_id")
                       .select("text", "toxic").filter(F.col("text").isNotNull()), "toxicity-sample")


def _surroundings(batches):
    """Distinct (word, hash of both neighbours, label) of every few texts."""
    for batch in batches:
        labels = batch.column("toxic").to_pylist()
        for i, label in enumerate(labels):
            words = (m.group() for m in _WORD.finditer(batch.column("text")[i].as_py().lower()))
            while True:  # a long text in parts; each part begins anew
                part = list(islice(words, 100_000))
                if not part:
                    break
                rows = {(w, a + " " + b) for a, w, b in zip(["", *part[:-1]], part, [*part[1:], ""]) if len(w) > 2}
                if rows:
                    w, c = zip(*rows)
                    yield pa.record_batch([pa.array(w, pa.string()), pa.array(c, pa.string()),
                                           pa.array([label] * len(w), pa.int32())], names=["word", "near", "toxic"])


def learned_stems(sample: DataFrame, least: int = LEAST_SURROUNDINGS, most: int = MOST_STEMS) -> dict[str, str]:
    """Beginnings of words with at least ``least`` different surroundings in
    toxic texts, as many times as frequent there as elsewhere as ``RATIOS``
    says. Of the ``most`` most frequent ones those that no shorter one
    includes, each made longer while a longer one covers nearly all its uses.
    """
    seen = (sample.mapInArrow(_surroundings, "word string, near string, toxic int")
            .select("word", "toxic", F.xxhash64("near").alias("near")).distinct())
    counts = materialize(seen.groupBy("word").agg(
        F.sum(F.col("toxic").cast("long")).alias("bad"), F.sum((1 - F.col("toxic")).cast("long")).alias("good")), "toxicity-words")
    bad, good = counts.agg(F.sum("bad"), F.sum("good")).first()
    if not bad or not good:
        return {}
    low, high = STEM_POINTS
    size = F.explode(F.sequence(F.lit(low), F.least(F.char_length("word"), F.lit(high)))).alias("size")
    stems = (counts.filter(F.char_length("word") >= low).select("word", "bad", "good", size)
             .groupBy(F.expr("left(word, size)").alias("stem")).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    ratio = F.col("bad") / F.lit(bad) / ((F.col("good") + 0.5) / F.lit(good))
    rows = (stems.filter((F.col("bad") >= least) & (ratio >= min(RATIOS.values())))
            .select("stem", "bad", ratio.alias("ratio")).orderBy(F.desc("bad"), "stem").limit(most).collect())
    return chosen_stems({r["stem"]: (r["bad"], r["ratio"]) for r in rows})


def chosen_stems(strong: dict[str, tuple[int, float]]) -> dict[str, str]:
    """The stems of ``learned_stems`` from (uses, ratio) of all candidates."""
    longer: dict[str, list[str]] = {}
    for stem in strong:
        longer.setdefault(stem[:-1], []).append(stem)
    chosen = {}
    for stem in strong:
        if stem[:-1] in strong:
            continue
        while True:
            more = [x for x in longer.get(stem, []) if strong[x][0] >= 0.9 * strong[stem][0]]
            if not more:
                break
            stem = more[0]
        kinds = [k for k, r in RATIOS.items() if strong[stem][1] >= r]
        chosen[stem] = kinds[0] if kinds else "hint"
    return chosen


def _count_events(model):
    def run(batches):
        for batch in batches:
            counts = [np.minimum(model.value.events(t), MOST_EVENTS).tolist() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array(counts, pa.list_(pa.int32())), batch.column("toxic")], names=["events", "toxic"])
    return run


def fit_weights(counts: np.ndarray, toxic: np.ndarray, times: np.ndarray, strength: float = 8.0,
                rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights of the events and of every document, from distinct rows of
    event counts, their label and how often they stand. Each event is taken as
    a source of a Poisson number of causes; a text is toxic if there is one.
    ``strength`` pseudo-rows hold each weight near its prior."""
    n = np.column_stack([counts, np.ones(len(counts))]).astype(float)
    start = np.array([*(prior(e) for e in EVENTS), Model().always])
    w = start.copy()
    seen = (n * times[:, None]).sum(axis=0)
    bad = toxic == 1
    for _ in range(rounds):
        total = n[bad] @ w
        causes = (n[bad] * (times[bad] / -np.expm1(-total))[:, None]).sum(axis=0) * w
        w = np.clip((causes + strength * start) / (seen + strength), 1e-4, 8.0)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample_labels: int = SAMPLE_LABELS) -> Model:
    """The grammar with learned stems and weights; with ``INSULTS`` and the
    weights of ``prior`` alone where no label may be learned from."""
    sample = labelled_sample(docs, labels, sample_labels)
    model = Model(learned_stems(sample))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = (sample.mapInArrow(_count_events(shared), "events array<int>, toxic int")
            .groupBy("events", "toxic").agg(F.count(F.lit(1)).alias("times")).collect())
    if rows:
        model.weights, model.always = fit_weights(
            np.array([r["events"] for r in rows]), np.array([r["toxic"] for r in rows]),
            np.array([r["times"] for r in rows], float))
    return model


# ------------------------------------------------------------------ scoring

_SCORED = "doc_id long, held_out boolean, score double, events array<int>"


def _score(model):
    def run(batches):
        for batch in batches:
            raw, offsets = frames.utf8(batch.column("text"))
            data = memoryview(raw)
            for i, j in frames.chunks(offsets, CHUNK_BYTES):
                counts = [model.value.events(str(data[offsets[k]:offsets[k + 1]], "utf-8", "replace")) for k in range(i, j)]
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i),
                                       pa.array(model.value.score(np.array(counts))),
                                       pa.array(counts, pa.list_(pa.int32()))],
                                      names=["doc_id", "held_out", "score", "events"])
    return frames.lean(run)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, events`` (counts of ``EVENTS``) for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), _SCORED)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3,
                   sample_labels: int = SAMPLE_LABELS) -> DataFrame:
    """``doc_id, held_out, score, predicted, events`` for every row of ``docs``
    (doc_id, text), learned from ``labels`` (doc_id, toxic).

    ``score`` is the chance of label 1, ``predicted`` 1 from ``threshold`` on,
    ``events`` counts the matches of ``EVENTS``. Null and empty texts have no
    events and the score of any text without. Only text decides: repeated rows
    get equal scores. Labels of ids that ``docs`` lacks are not used, other
    columns not read. Without labels the grammar's own weights hold; an empty
    table gives no rows. A clause is held as a whole, with its words, by the task.
    """
    scored = score_documents(docs, fit(docs, labels, sample_labels))
    return scored.select("doc_id", "held_out", "score",
                         (F.col("score") >= F.lit(threshold)).cast("int").alias("predicted"), "events")
