import numpy as np
import pytest

from cellgrid.llm import simhash


@pytest.fixture
def verified(monkeypatch):
    """The pairs that near_copies() verifies, a list for each time."""
    seen, real = [], simhash._verified

    def record(pairs, *rest):
        seen.append(pairs.distinct().count())
        return real(pairs, *rest)

    monkeypatch.setattr(simhash, "_verified", record)
    return seen


def test_a_shared_passage_makes_few_pairs(spark, docs, verified):
    """Texts that share most of their shingles but are no near copies: pairs must not grow with the square of their number."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(150))
    texts = [f"{passage} {' '.join(f't{x}' for x in rng.integers(0, 10**6, 40))}" for _ in range(60)]
    kept = simhash.near_copies(docs([*texts, texts[7] + " end"])).select("doc_id").collect()
    assert {r["doc_id"] for r in kept} == set(range(60))
    assert sum(verified) <= 2 * len(texts)  # of 1,830


def test_fingerprints_within_two_bits_come_first(spark, docs, verified, monkeypatch):
    before, real = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *rest, **more: (before.append(len(verified)), real(*rest, **more))[1])
    rng = np.random.default_rng(6)
    print_of = lambda t: simhash.majority(np.unique(simhash.shingle_hashes(t.encode(), 5)))
    base = [f"t{x}" for x in rng.integers(0, 10**6, 2000)]
    texts = [" ".join(base)]
    for at in range(0, 2000, 7):
        other = " ".join([*base[:at], "changed", *base[at + 1 :]])
        if (print_of(other) ^ print_of(texts[0])).bit_count() <= 2 and len(texts) < 6:
            texts.append(other)
    far = [" ".join(f"t{x}" for x in rng.integers(0, 10**6, 200)) for _ in range(5)]
    kept = simhash.near_copies(docs([*texts, *far])).select("doc_id").collect()
    assert len(texts) == 6 and {r["doc_id"] for r in kept} == {0, *range(6, 11)}
    assert before == [0]  # by Golay indices, ahead of any pair
    assert 5 <= verified[0] <= 15 and sum(verified[1:]) == 0  # the prefixes find nothing more
