import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cellgrid.llm import packing, token_files
from cellgrid.llm.common import new_path, table
from cellgrid.llm.elias_fano import EliasFano
from cellgrid.llm.entry import QUERIES, tokenizer_path

from . import brute


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=60), st.integers(0, 1500))
def test_elias_fano(values, run):
    v = sorted([*values, *range(run)])
    e = EliasFano.from_bytes(EliasFano.of(np.array(v, dtype=np.uint64)).to_bytes())
    assert e.range(0, len(v)).tolist() == v
    assert all(e.select(i) == v[i] for i in range(0, len(v), 97))
    assert e.range(len(v) // 3, len(v) // 2).tolist() == v[len(v) // 3 : len(v) // 2]


def test_elias_fano_is_small():
    v = np.sort(np.random.default_rng(1).integers(0, 10_000_000, 10_000)).astype(np.uint64)
    assert len(EliasFano.of(v).to_bytes()) * 8 / len(v) < np.log2(1000) + 2.5


def test_token_files_query(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, data, "documents").collect()]
    ids, at, want = brute.encoded(docs, tokenizer_path(), 1), 0, {}
    for d in sorted(ids):
        want[d] = (at, len(ids[d]), zlib.crc32(ids[d].tobytes()))
        at += len(ids[d])
    assert {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op6_token_files"](spark, data).collect()} == want


def test_token_files_cases(spark, docs):
    texts, ids = [None, "", "a b", "a b", "word " * 9000, "null"], [3, -5, 1 << 40, 1 << 40, 7, None]
    manifest = token_files.write(docs(texts, ids), tokenizer_path(), new_path(spark, "t"))
    got = sorted(token_files.read(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, -5, 3, 7, 1 << 40, 1 << 40]
    assert [r["n_tokens"] for r in got] == [2, 1, 1, 9001, 3, 3]
    shard = token_files.Shard(manifest.orderBy("part").first()["path"])
    assert [shard.span(i) for i in range(shard.about["n_docs"])] == [(s, s + len(x)) for _, s, x in shard.documents()]
    assert token_files.round_trip(docs([]), tokenizer_path()).count() == 0


def check_packed(rows, ids, max_len=4096):
    parts, places = defaultdict(list), defaultdict(list)
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] > 0 and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        parts[r["doc_id"]].append((r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans, size in [*((s, None) for s in places.values()), *((parts[d], len(ids[d])) for d in ids)]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == size if size else at <= max_len
    return places


def test_packing_query(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, data, "documents").collect()]
    ids = brute.encoded(docs, tokenizer_path(), 2)
    places = check_packed(QUERIES["op8_packing"](spark, data).collect(), ids)
    total = sum(map(len, ids.values()))
    assert len(places) <= total / 4096 * 1.05 + 2


def test_packing_cases(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 5)
    texts = [None, "", "a " * 4095, "a " * 4096, "a " * 9000, *["x y"] * 40]
    ids = brute.encoded(enumerate(texts), tokenizer_path(), 2)
    cut = packing.pieces(docs(texts), tokenizer_path(), with_ids=True)
    packed = packing.pack(cut)
    check_packed(packed.collect(), ids)
    got = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    assert all(len(r["ids"]) == 4 * 4096 or r["n_tokens"] & (r["n_tokens"] - 1) == 0 for r in got.values())
    assert packing.pack(packing.pieces(docs([]), tokenizer_path())).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 30), min_size=1))
def test_histogram_is_used_up(histogram):
    used = defaultdict(int)
    for pattern, count in packing.pack_histogram(histogram, 32):
        assert sum(pattern) <= 32 and count > 0
        for length in pattern:
            used[length] += count
    assert used == histogram
