"""Quality rules whose cutoffs keep a bound on false rejection, stratum by stratum.

Each rule rejects texts whose measure lies above a cutoff.  The labelled
documents of each stratum (a value of `lang`) are dealt into two halves by a
hash of their id.  The first half gives a path of joint cutoffs: step by step
the rule and cutoff that reject most further bad documents for the good ones
they cost, by counts over all of that half.  On the other
half, all of it, the steps are tested in the order of the path (fixed-sequence
testing): a step is admitted while the exact binomial tail P(Bin(n, risk) <=
rejected), for the good documents that any of the rules rejects by then, is at
most delta / strata, and the first that fails ends the sequence.  As the path
was made from other documents and is tested in a fixed order, its steps need
no further correction, and only the strata share delta (Bonferroni).  So with
probability 1 - delta no stratum loses more than the share `risk` of its good
documents to all rules together.  A stratum with too few labels for any
admission keeps all that the base rules keep.

Defined cases: a null text has no words and fails; null lang is a stratum of
its own; repeated rows are judged alike; documents without labels, or that the
base rules reject, do not count as labelled; labels repeated for a document
count once (the worse one); texts of any length are measured whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, save, small

RULES = ("symbols", "dup_lines", "repeats", "upper", "marks", "same_words")
#: Measures are multiples of 1 / GRID up to TOP / GRID.
GRID, TOP = 100, 300
#: Steps of a path.
STEPS = 20
RISK, DELTA = 0.03, 0.05
#: What a wrongly rejected share of good documents weighs against a rightly rejected share of bad ones.
PRICE = 5.0

_SYMBOLS, _MARKS, _UPPER = b"#*$%&|<>", b"!?", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: str | None) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The base counts, and each rule's measure in steps of 1 / GRID."""
    text = text or ""
    data = text.encode()
    words = data.split()  # of bytes: at ASCII white space only
    n = len(words)
    chars = len(text) - (len(data) - sum(map(len, words)))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines, dup, filled = set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip():
            filled += 1
            dup += line in lines
            lines.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeats = 0
    if len(set(windows)) < len(windows):
        found, past = Counter(windows), 0
        for i, w in enumerate(windows):
            if found[w] > 1:
                repeats += i + 3 - max(i, past)
                past = i + 3
    upper, marks = len(data) - len(data.translate(None, _UPPER)), len(data) - len(data.translate(None, _MARKS))
    share = lambda a, b: min(TOP, a * GRID // max(1, b))
    return (n, chars, symbols, dup, repeats), (share(symbols, n), share(dup, filled), share(repeats, n), share(upper, chars), share(marks, n), share(n - len(set(words)), n))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(id, stratum, base counts, rule measures) of every row; saved."""
    names = [*COUNTS, *RULES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [a + b for a, b in (measure(t.as_py()) for t in batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in zip(*found))] if found else [batch.column(0), batch.column(1), *(pa.array([], pa.int64()) for _ in names)], names=["id", "stratum", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).alias("text"))
    return save(rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, stratum string, " + ", ".join(f"{c} long" for c in names)), "measures")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed exactly in logarithms."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def next_cut(found: np.ndarray, n: tuple[int, int]) -> tuple[int, int] | None:
    """(rule, cutoff) of the best next step; found: documents left by mark (bad, good), rule and measure, n: all bad and good ones.  Ties go to the first rule and the looser cutoff."""
    best, move = 0.0, None
    for r in range(found.shape[1]):
        bad, fine = found[:, r, ::-1].cumsum(axis=1)[:, ::-1]
        gain = bad / max(1, n[0]) - PRICE * fine / max(1, n[1])  # of a cutoff just below each step
        at = TOP - int(np.argmax(gain[::-1]))
        if at > 0 and gain[at] > best + 1e-12:
            best, move = gain[at], (r, at - 1)
    return move


def learn_paths(half: DataFrame) -> dict[str | None, list[tuple[int, ...]]]:
    """Joint cutoffs of the rules for each stratum, ever stricter, from all rows (stratum, good, rules); the driver gets a row for each stratum, mark, rule and measure."""
    spark = half.sparkSession
    alike = half.groupBy("stratum", "good", *RULES).agg(F.count("*").alias("docs"))
    # Read once a step, so in no more files than there are tasks at a time.
    alike = save(alike.coalesce(spark.sparkContext.defaultParallelism), "fitted")
    measured = F.posexplode(F.array(*[F.col(r).cast("int") for r in RULES])).alias("rule", "measure")
    cuts: dict = {r[0]: [TOP] * len(RULES) for r in alike.select("stratum").distinct().toLocalIterator()}
    paths: dict = {s: [] for s in cuts}
    totals: dict = {}
    for _ in range(STEPS):
        if not cuts:
            break
        table = spark.createDataFrame([(s, *c) for s, c in cuts.items()], "cut_stratum string, " + ", ".join(f"cut_{r} int" for r in RULES))
        left = alike.join(small(table, len(cuts)), F.col("stratum").eqNullSafe(F.col("cut_stratum"))).where(" AND ".join(f"{r} <= cut_{r}" for r in RULES))
        found: dict = {s: np.zeros((2, len(RULES), TOP + 1), np.int64) for s in cuts}
        for s, good, rule, measure, docs in left.select("stratum", "good", "docs", measured).groupBy("stratum", "good", "rule", "measure").agg(F.sum("docs")).toLocalIterator():
            found[s][int(good), rule, measure] = docs
        for s, counts in found.items():
            n = totals.setdefault(s, tuple(counts[:, 0].sum(axis=1).tolist()))
            move = next_cut(counts, n)
            if move:
                cuts[s][move[0]] = min(cuts[s][move[0]], move[1])
                paths[s].append(tuple(cuts[s]))
            else:
                del cuts[s]
    drop_saved(alike)
    return paths


def first_steps(steps: list[tuple[int, ...]], rule: int) -> list[int]:
    """For each measure up to TOP the first step of a path that rejects it by the rule (past the last: none)."""
    return [next((t for t, cuts in enumerate(steps) if m > cuts[rule]), len(steps)) for m in range(TOP + 1)]


def admitted(good: list[int], risk: float, level: float) -> int:
    """How many steps the fixed sequence admits; good: labelled good documents by the first step that rejects them, the last entry those of none."""
    rejected = 0
    for t in range(len(good) - 1):
        rejected += good[t]
        if not sum(good) or binomial_tail(rejected, sum(good), risk) > level:
            return t
    return len(good) - 1


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Per row: id, base counts, base_failed, kept, rejected_by (names of rules)."""
    spark = docs.sparkSession
    found = measures(docs, id_col, text_col, stratum_col)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    marked = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.min("quality") > 0).alias("good"))
    known = save(found.where(~base_failed).join(marked, "id").select("id", "stratum", "good", *RULES), "labelled")
    half = F.pmod(F.xxhash64("id"), F.lit(2))
    paths = learn_paths(known.where(half == 0))

    def stepped(rows: DataFrame) -> DataFrame:
        """rows with first_<rule> and first: the steps of their stratum's path that reject them first."""
        at = [(s, *(first_steps(p, k) for k in range(len(RULES)))) for s, p in paths.items()]
        table = spark.createDataFrame(at, "path_stratum string, " + ", ".join(f"path_{r} array<int>" for r in RULES))
        joined = rows.join(small(table, len(at)), F.col("stratum").eqNullSafe(F.col("path_stratum")), "left")
        joined = joined.withColumns({f"first_{r}": F.get(f"path_{r}", F.col(r).cast("int")) for r in RULES})
        return joined.withColumn("first", F.least(*[f"first_{r}" for r in RULES])).drop("path_stratum", *[f"path_{r}" for r in RULES])

    good: dict = {s: [0] * (len(p) + 1) for s, p in paths.items()}
    for r in stepped(known.where((half == 1) & F.col("good"))).where("first IS NOT NULL").groupBy("stratum", "first").count().toLocalIterator():  # a row for each step
        good[r["stratum"]][r["first"]] += r["count"]
    strata = known.select("stratum").distinct().count()
    used = [(s, admitted(counts, risk, delta / strata)) for s, counts in good.items()]
    chosen = spark.createDataFrame(used, "used_stratum string, used int")
    out = stepped(found).join(small(chosen, len(used)), F.col("stratum").eqNullSafe(F.col("used_stratum")), "left")
    rejected = F.array_compact(F.array(*[F.when(F.col(f"first_{r}") < F.col("used"), F.lit(r)) for r in RULES]))
    return out.select(F.col("id").alias(id_col), *COUNTS, base_failed.alias("base_failed"), (~base_failed & (F.size(rejected) == 0)).alias("kept"), rejected.alias("rejected_by"))
