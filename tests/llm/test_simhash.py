import numpy as np
import pytest

from cellgrid.llm import components as components_module
from cellgrid.llm import simhash
from cellgrid.llm.common import table
from cellgrid.llm.components import components
from cellgrid.llm.entry import QUERIES

from . import brute


def test_query_equals_brute_force(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, data, "documents").collect()]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op2_simhash_near_dup"](spark, data).collect()}
    assert got == brute.near_groups(docs)


def test_golay_indices_cover_two_bits():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300)
    for a, own in zip(words, simhash.golay_indices(words)):
        assert len(own) in (1, 6)
        other = np.array([a ^ (1 << i) ^ (1 << j) for i in range(23) for j in range(i + 1)])
        assert all(set(own) & set(x) for x in simhash.golay_indices(other))


def test_links_by_pairs_and_by_stars(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 1 << 63, 6, dtype=np.uint64)]
    prints = {b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (40, 2))} | set(base) | {0, 1, 7, (1 << 64) - 1, (1 << 63) - 1}
    signed = [p - (1 << 64) * (p >> 63) for p in prints]
    want = brute.union([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2], signed)
    nodes = spark.createDataFrame([(p, 0) for p in signed], "fp long, v int")
    for most in (1000, 8, 1):
        monkeypatch.setattr(simhash, "PAIRS_UP_TO", most)
        got = dict.fromkeys(signed) | {r["node"]: r["root"] for r in components(simhash.links(nodes).select("a", "b")).collect()}
        assert {k: k if v is None else v for k, v in got.items()} == want


def test_edge_cases(spark, docs):
    long = " ".join(f"w{i % 977}" for i in range(70_000))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs([None, "", " \t\n", "one", "ONE", "one", long, long], ids=[5, 6, 7, 8, 9, 9, 11, 12])).collect()}
    assert [got[i]["fp"] for i in (5, 6, 7)] == [0, 0, 0] and {got[i]["component"] for i in (5, 6, 7)} == {5}
    assert got[9]["component"] == 8 and got[12]["component"] == 11
    assert simhash.near_duplicates(docs([])).count() == 0


def test_near_copies_keeps_one(spark, docs):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"t{x}" for x in rng.integers(0, 5000, 300)) for _ in range(12)]
    near = texts[0].split()
    near[150] = "changed"
    kept = simhash.near_copies(docs([*texts, texts[3], " ".join(near), "tiny", None, ""], ids=range(17)))
    assert "_row" not in kept.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {*range(12), 14, 15}
    assert simhash.near_copies(docs([])).count() == 0


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 470)] + [(500, i) for i in range(501, 560)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    used = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {k: v for k, v in brute.union(pairs, {x for p in pairs for x in p}).items() if k in used}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("kind", ["long", "int"])
def test_components_of_few_edges_take_two_tables(spark, monkeypatch, kind):
    """A small graph needs no rounds of jobs, and has the groups that the rounds find."""
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(7, 7)]
    made, save = [], components_module.save
    monkeypatch.setattr(components_module, "save", lambda *a: made.append(a[1]) or save(*a))
    few = components_module.components(spark.createDataFrame(edges, f"a {kind}, b {kind}"))
    assert len(made) == 2 and [t for _, t in few.dtypes] == [{"long": "bigint"}.get(kind, kind)] * 2
    monkeypatch.setattr(components_module, "DRIVER_EDGES", 0)
    many = components_module.components(spark.createDataFrame(edges, f"a {kind}, b {kind}"))
    assert len(made) > 4 and sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert components_module.components(spark.createDataFrame([], f"a {kind}, b {kind}")).isEmpty()


def test_near_copies_by_shingle_similarity(spark, docs, monkeypatch):
    rng = np.random.default_rng(9)
    texts = []
    for n in [6, 8, 12, 18, 30, 60, 150, 400, 1000] * 2:
        base = [f"t{x}" for x in rng.integers(0, 5000, n)]
        texts.append(" ".join(base))
        for changed in (1, max(1, n // 50), max(1, n // 42), n // 20 + 1, n // 10 + 1):
            w = base.copy()
            for at in rng.integers(0, n, changed):
                w[at] = "changed" if rng.integers(0, 2) else ""
            texts.append(" ".join(w))
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"t{x}" for x in rng.integers(0, 5000, 5 + k)) for k in range(12)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    want = set(brute.union(pairs, range(len(texts))).values())
    assert pairs and len(want) > 20
    monkeypatch.setattr(simhash, "PAIRS_A_PART", 8)
    assert {r["doc_id"] for r in simhash.near_copies(docs(texts), left_over=0).select("doc_id").collect()} == want
