"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon transducer maps words to the classes insult, threat, target,
negation and report.  Four small transducers rewrite these symbols, in this
order: negation marks insults and takes back threats that follow within its
scope; threat joins a threat with the target that follows and passes the
target on; target marks insults of a clause that addresses someone, before or
soon after the insult; report marks what follows a verb of speech.  They are
composed once into one deterministic machine that reads a clause from left to
right; each pattern it emits adds the insult's weight to one feature of the
text.  No feature is made of words outside a pattern.

Insult words and stems and their weights are learnt from labelled texts as
log-odds; a logistic model turns the features into a probability.  It is
fitted out of fold (each half's features by the other half's lexicon), so the
weights are not judged by the texts that made them.  At most MAX_LABELLED
labelled rows, drawn by a hash of their id, are used; only the model depends on
that sample, and every text is scored whole.

Defined cases: null and empty texts have no pattern and score the model's base
rate; repeated rows score alike; labels repeated for a document count once
(the higher); of labelled texts that are near copies with one mark the least
id counts; an empty label table gives the model's prior, 0.05; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import product
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.sources.shared import unused

from .common import save

#: Labelled rows that the model is fitted on, about.
MAX_LABELLED = 20_000
#: Rows of a batch that a worker gives back.
OUT_ROWS = 500
#: Stems of these many letters; words of one stem share what the stem has shown.
STEMS = (4, 5, 6)
#: A word or stem needs this many toxic texts, and log-odds of so much.
SUPPORT, ODDS = 3, 2.5

#: Words of the closed classes in four languages.
CLASSES = {
    "threat": "kill hurt destroy crush burn beat smash töten vernichten schlagen tuer détruire frapper matar destruir golpear",
    "target": "you your yours he she they them him her this that these du dich dir ihr euch er sie tu te toi vous il elle ils tú vosotros usted él ella ellos",
    "negation": "not no never neither nor nicht kein keine nie pas jamais non nunca ni",
    "report": "said says say wrote writes called quoted claimed sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó",
}
SYMBOLS = ("other", "insult", "threat", "target", "negation", "report")
FEATURES = ("plain", "targeted", "negated", "reported", "menace")
#: Emitted where a target follows an insult: the last plain insult was meant for someone.
RECAST = len(FEATURES)
SCOPE = 3

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+")


class Transducer:
    """Deterministic: step(state, symbol) -> (state, emitted symbol)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def compose(self, then: Transducer) -> Transducer:
        def step(state, symbol):
            a, middle = self.step(state[0], symbol)
            b, out = then.step(state[1], middle)
            return (a, b), out

        return Transducer((self.start, then.start), step)


def negation() -> Transducer:
    def step(left, symbol):
        if symbol == "negation":
            return SCOPE, "other"
        if left and symbol in ("insult", "threat"):
            return left - 1, "negated" if symbol == "insult" else "other"
        return max(0, left - 1), symbol

    return Transducer(0, step)


def threat() -> Transducer:
    def step(left, symbol):
        if symbol == "threat":
            return SCOPE, "other"
        return (0, "menace") if symbol == "target" and left else (max(0, left - 1), symbol)

    return Transducer(0, step)


def target() -> Transducer:
    def step(state, symbol):
        on, since = state  # whether someone is addressed; words left in which a target still belongs to the last plain insult
        if symbol in ("target", "menace"):
            return (1, 0), "recast" if since and symbol == "target" else symbol
        if symbol == "insult":
            return (on, 0 if on else SCOPE), "targeted" if on else "plain"
        return (on, max(0, since - 1)), symbol

    return Transducer((0, 0), step)


def report() -> Transducer:
    def step(on, symbol):
        if symbol == "report":
            return 1, "other"
        if on and symbol in ("plain", "targeted", "negated", "menace"):
            return on, "reported"
        return on, "other" if on and symbol == "recast" else symbol

    return Transducer(0, step)


def grammar() -> tuple[list[list[int]], list[list[int]]]:
    """The composed machine as tables [state][symbol] of next states and emitted features (-1: none)."""
    machine = negation().compose(threat()).compose(target()).compose(report())
    names = [*FEATURES, "recast"]
    number, queue = {machine.start: 0}, [machine.start]
    nexts, outs = [], []
    for state in queue:
        row, out = [], []
        for symbol in SYMBOLS:
            to, emitted = machine.step(state, symbol)
            if to not in number:
                number[to] = len(queue)
                queue.append(to)
            row.append(number[to])
            out.append(names.index(emitted) if emitted in names else -1)
        nexts.append(row)
        outs.append(out)
    return nexts, outs


CLOSED = {w: SYMBOLS.index(c) for c, words in CLASSES.items() for w in words.split()}


class Model:
    """Lexicon of insults with weights, and the logistic coefficients."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], coefficients: list[float] | None = None):
        self.words, self.stems, self.coefficients = words, stems, coefficients
        self.nexts, self.outs = grammar()

    def weight(self, word: str) -> float:
        found = self.words.get(word)
        if found is None:
            found = max((self.stems[s] for s in (word[:n] for n in STEMS) if s in self.stems), default=0.0)
        return found

    def features(self, text: str | None) -> list[float]:
        text = (text or "").lower()
        words = set(_WORD.findall(text))
        insults = {w: x for w in words if (x := self.weight(w)) > 0}
        sums = [0.0] * len(FEATURES)
        if insults or not CLOSED_THREATS.isdisjoint(words):
            for clause in _CLAUSE.split(text):
                state, last = 0, 0.0
                for w in _WORD.findall(clause):
                    weight = insults.get(w)
                    symbol = 1 if weight else CLOSED.get(w, 0)
                    out = self.outs[state][symbol]
                    state = self.nexts[state][symbol]
                    if out == RECAST:
                        sums[0] -= last
                        sums[1] += last
                    elif out >= 0:
                        last = weight or 1.0
                        sums[out] += last
        return [float(np.log1p(max(x, 0.0))) for x in sums]

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.coefficients is None:
            return np.full(len(features), 0.05)
        c = np.array(self.coefficients)
        return 1 / (1 + np.exp(-np.clip(c[0] + features @ c[1:], -30, 30)))


CLOSED_THREATS = frozenset(CLASSES["threat"].split())


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Newton's method; the ridge leaves the constant alone."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-3, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= np.clip(step, -2, 2)
    return w.tolist()


def _lexicon(counts: list[tuple[str, int, int, int, int]], texts: tuple[int, int], stem: bool) -> dict[str, float]:
    """Weights of terms with enough support; counts: (term, length or 0, distinct words, toxic, clean)."""
    out = {}
    for term, kind, forms, toxic, clean in counts:
        if bool(kind) != stem or toxic < SUPPORT or stem and forms < 3:
            continue
        odds = float(np.log((toxic + 0.5) / (texts[1] + 1)) - np.log((clean + 0.5) / (texts[0] + 1)))
        if odds >= ODDS and toxic >= 4 * clean:
            out[term] = odds
    return out


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled rows (id, toxic)."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    drawn = marked.where(F.pmod(F.xxhash64("id"), F.lit(max(n, 1))) < max_labelled)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id")  # bounded by max_labelled, about

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(set(_WORD.findall((t.as_py() or "").lower()))) for t in batch.column(1)]
            # Near copies mostly share their least hashes and then count as one text.
            sketch = [repr(sorted(crc32(w.encode()) for w in ws)[:3]) for ws in words]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.list_(pa.string())), pa.array(sketch, pa.string())], names=["id", "text", "toxic", "words", "sketch"])

    rows = rows.select("id", "text", F.col("toxic").cast("int").alias("toxic"))
    kept = rows.mapInArrow(terms, f"id {docs.schema[id_col].dataType.simpleString()}, text string, toxic int, words array<string>, sketch string")
    first = kept.groupBy("sketch", "toxic").agg(F.min(F.struct("id", "text", "words")).alias("first"))
    kept = save(first.select("first.text", "toxic", "first.words", F.pmod(F.xxhash64("sketch"), F.lit(2)).cast("int").alias("fold")), "labelled")
    sizes: dict = defaultdict(int)
    for r in kept.groupBy("fold", "toxic").count().collect():
        sizes[r["fold"], int(r["toxic"] > 0)] += r["count"]
    if not sum(v for (_, t), v in sizes.items() if t) or not sum(v for (_, t), v in sizes.items() if not t):
        return Model({}, {})
    parts = [F.transform("words", lambda w: F.struct(w.alias("term"), F.lit(0).alias("kind"), F.lit(1).alias("forms")))]
    for k in STEMS:
        longer = F.filter("words", lambda w: F.length(w) > k)
        parts.append(F.transform(F.array_distinct(F.transform(longer, lambda w: F.substring(w, 1, k))), lambda s: F.struct(s.alias("term"), F.lit(k).alias("kind"), F.lit(0).alias("forms"))))
    toxic = (F.col("toxic") > 0).cast("int")
    counted = kept.select("fold", toxic.alias("toxic"), F.explode(F.concat(*parts)).alias("t")).groupBy("t.term", "t.kind").agg(
        *[F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), 1).otherwise(0)).alias(f"n{f}{t}") for f, t in product((0, 1), (0, 1))]
    )
    # Distinct words of each stem, from texts marked toxic.
    forms = kept.where("toxic > 0").select(F.explode("words").alias("word")).distinct().select(F.explode(F.array(*[F.struct(F.substring("word", 1, k).alias("term"), F.lit(k).alias("kind")) for k in STEMS])).alias("t")).groupBy("t.term", "t.kind").agg(F.count("*").alias("forms"))
    found = counted.where(F.col("n01") + F.col("n11") >= SUPPORT).where((F.col("n01") + F.col("n11")) * 2 >= F.col("n00") + F.col("n10")).join(forms, ["term", "kind"], "left").collect()  # few: mostly toxic terms of the bounded sample

    def lexicon(folds: tuple[int, ...]) -> Model:
        counts = [(r["term"], r["kind"], r["forms"] or 0, sum(r[f"n{f}1"] for f in folds), sum(r[f"n{f}0"] for f in folds)) for r in found]
        texts = tuple(sum(sizes[f, t] for f in folds) for t in (0, 1))
        return Model(_lexicon(counts, texts, False), _lexicon(counts, texts, True))

    halves = lexicon((1,)), lexicon((0,))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [halves[f].features(t.as_py()) for t, f in zip(batch.column(0), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    seen = kept.select("text", toxic.alias("toxic"), "fold").mapInArrow(look, "x array<double>, toxic int").collect()  # a few numbers a row of the bounded sample
    model = lexicon((0, 1))
    model.coefficients = fit_logistic(np.array([r["x"] for r in seen]), np.array([r["toxic"] for r in seen], dtype=float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: id, score, and the kept columns.

    Texts go to the workers once, kept or not, and come back, if they are kept,
    in batches of OUT_ROWS: Spark's own batches of long texts take much of an
    executor's memory outside its heap.
    """
    keep = keep or []
    (own,) = unused(docs.select(id_col, *keep), "_text")
    rows = docs.select(F.col(id_col), *keep, *([] if text_col in keep else [F.col(text_col).alias(own)]))
    at = rows.columns.index(text_col if text_col in keep else own)
    kept = 1 + len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), OUT_ROWS):
                batch = whole.slice(start, OUT_ROWS)
                x = np.array([model.features(t.as_py()) for t in batch.column(at)], dtype=float)
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(model.score(x))], names=[*batch.schema.names[:kept], "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:kept])
    return rows.mapInArrow(run, schema + ", score double")
