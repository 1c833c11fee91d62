import glob
import os
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellgrid.llm import common, toxicity
from cellgrid.llm.entry import QUERIES, oracle_sql, tokenizer_path, toxic_held_out

from . import brute
from .test_token_outputs import check_packed


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df, want = QUERIES[name](spark, data), con.sql(oracle_sql()[name])
    cols = sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


STAGE = dict(corpus_pipeline.STAGES)


def corpus(data_rows, items):
    """Documents with nulls, repeats, copies, near copies, shared lines and benchmark passages, one of them long."""
    rng = np.random.default_rng(12)
    words = lambda n: " ".join(f"w{'abcdefghij'[x % 10]}{'klmnopqrst'[x // 10 % 10]}{x}" for x in rng.integers(0, 4000, n))

    def edited(text, n):
        w = text.split(" ")
        for i in rng.choice(len(w), n, replace=False):
            w[i] = words(1)
        return " ".join(w)

    passage, close = words(60), words(60)
    base = [words(int(n)) for n in rng.integers(80, 300, 8)]
    texts = [*base, base[0], edited(base[1], 1), edited(base[2], 2), edited(base[3], 30)]
    texts += [f"{words(90)}\n{passage}\n{words(70)}", f"{words(80)}\n{passage.upper()}!\n\n{words(20)}", f"{edited(passage, 3)}\n{words(100)}", f"{close}\n{edited(close, 4)}"]
    texts += [passage, f"{words(100)} {items[0]} {words(30)}", f"{words(3000)} {items[1][:40]} {words(3000)}", f"{items[2].upper()}", None, "", " \n ", words(3), words(3), words(20_000)]
    texts += ["All rights reserved.\nLes.\n" + words(60), "all rights  reserved\n---\n" + words(60)] + [t for _, t in data_rows]
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def small(spark, data):
    items = [r["text"] for r in common.table(spark, data, "benchmark").orderBy("item_id").limit(3).collect()]
    # Marked documents of the tables, so that some are toxic.
    marked = common.table(spark, data, "documents").join(common.table(spark, data, "labels").where("toxic = 1"), "doc_id").orderBy("doc_id").limit(6)
    rows = corpus([(r["doc_id"], r["text"]) for r in marked.collect()], items)
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def clashing(df):
    """df with columns whose names the stages use themselves."""
    return df.select("*", *[F.lit(1).alias(c) for c in ("id", "h", "key", "own", "removed", "n_removed", "score", "row", "label", "node", "norm", "fp", "items", "_text", "contaminated")])


def run_stage(spark, name, df, data):
    out = common.save(STAGE[name](spark, clashing(df), data), name)
    if name != "packing":
        assert out.columns == corpus_pipeline.COLUMNS
    return sorted(map(tuple, out.collect()), key=repr)


def test_toxicity_stage(spark, data, small):
    rows, df = small
    whole = common.table(spark, data, "documents")
    docs = whole.where("doc_id >= 60").union(df.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    model = toxicity.learn(docs, common.table(spark, data, "labels").where(~toxic_held_out()))
    gone = lambda t: model.score(np.array([model.features(t)]))[0] >= 0.3
    want = sorted((tuple(r) for r in docs.collect() if not gone(r["text"])), key=repr)
    assert run_stage(spark, "toxicity", docs, data) == want


def test_toxicity_moves_texts_once_and_in_small_batches(spark, data, small, monkeypatch):
    _, df = small
    seen, kind = [], type(df)
    through = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, *a, **b: seen.append((self.schema.names, run)) or through(self, run, *a, **b))
    STAGE["toxicity"](spark, clashing(df.withColumn("doc_id", F.col("doc_id") + 1_000_000)), data)
    names, run = seen[-1]
    assert sorted(names) == sorted(corpus_pipeline.COLUMNS)
    n = 2 * toxicity.OUT_ROWS + 1
    batch = pa.RecordBatch.from_pydict({c: [f"text {k}" for k in range(n)] if c == "text" else [*range(n)] for c in names})
    out = list(run(iter([batch])))
    assert [len(x) for x in out] == [toxicity.OUT_ROWS, toxicity.OUT_ROWS, 1]
    assert pa.Table.from_batches(out).drop_columns("score").equals(pa.Table.from_batches([batch]))


def test_line_stage(spark, data, small):
    rows, df = small
    norm = lambda x: re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", re.sub("[1-9]", "0", x.lower())).strip()
    found = [(i, k, norm(x) or x.strip()) for i, t, *_ in rows for k, x in enumerate((t or "").split("\n"))]
    found = [x for x in found if x[2]]
    forms = {f: k for k, f in enumerate(dict.fromkeys(f for _, _, f in found))}
    text = {k: f for f, k in forms.items()}
    long = [k for k, f in text.items() if len(f.split()) >= 5 and len(f) < 20_000]
    roots = brute.union(brute.alike([(a, b) for a in long for b in long if a < b], text), text)
    first, gone = {}, set()
    for i, k, f in found:
        first.setdefault(roots[forms[f]], (i, k))
        if first[roots[forms[f]]] != (i, k):
            gone.add((i, k))
    want = []
    for i, t, *rest in rows:
        left = "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone)
        changed = any(d == i for d, _ in gone)
        if not changed:
            want.append((i, t, *rest))
        elif left.strip():
            want.append((i, left, *rest[:2], len(left)))
    assert len(gone) > 5 and run_stage(spark, "line_dedup", df, data) == sorted(want, key=repr)


def test_near_stage(spark, data, small):
    rows, df = small
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := brute.BLACK.findall((t or "").translate(brute.LOWER))) else set() for i, t, *_ in rows}
    alike = lambda a, b: sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    roots = brute.union([(a, b) for a in sets for b in sets if a < b and alike(a, b)], sets)
    want = sorted((r for r in rows if roots[r[0]] == r[0]), key=repr)
    assert 4 < len(rows) - len(want) and run_stage(spark, "near_dedup", df, data) == want
    twice = run_stage(spark, "near_dedup", df.union(df), data)
    assert twice == want  # of repeated rows one stays


def test_decontamination_stage(spark, data, small):
    rows, df = small
    items = [(r["item_id"], r["text"]) for r in common.table(spark, data, "benchmark").collect()]
    found = brute.contamination([(i, t) for i, t, *_ in rows], items)
    want = sorted((r for r in rows if not found[r[0]][4]), key=repr)
    assert 1 < len(rows) - len(want) < 12 and run_stage(spark, "decontamination", df, data) == want


def test_packing_stage(spark, data, small):
    rows, df = small
    packed = common.save(STAGE["packing"](spark, clashing(df), data), "packed").collect()
    check_packed(packed, brute.encoded([(i, t) for i, t, *_ in rows], tokenizer_path(), 2))


def test_stages(spark, data):
    docs = common.table(spark, data, "documents")
    seen, texts = {r["doc_id"] for r in docs.collect()}, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.save(stage(spark, docs, data), name)
        rows = docs.collect()
        assert {r["doc_id"] for r in rows} <= seen
        seen = {r["doc_id"] for r in rows}
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            texts[name] = {r["doc_id"]: r["text"] for r in rows}
    assert seen == set(texts["decontamination"])
    # What the later filters keep is unchanged, and copies are gone.
    assert texts["decontamination"].items() <= texts["near_dedup"].items() <= texts["line_dedup"].items()
    left = [t for t in texts["near_dedup"].values()]
    assert len(left) == len(set(left))
    whole = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, data).collect())
    assert whole == sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)


def test_empty_documents(spark, data):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.save(stage(spark, docs, data), "none")
    assert docs.count() == 0
