import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellgrid import NeighbourSearch, points
from cellgrid.operators import voxels

SCHEMA = "id long, x float, y float, z float"
FOUR = [(0, 0.1, 0.1, 0.2), (1, 0.2, 0.2, 0.1), (2, 3.2, 1.2, 1.1), (3, 3.3, 1.1, 1.0)]


def cloud(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute(queries, search, radius, k=None, epsilon=0.0):
    """Pairs by a plain loop in 32-bit floats; with epsilon, in the order of the scan."""
    r, out = np.float32(radius), []
    ok = lambda p: all(c is not None and np.isfinite(c) for c in p[1:])
    for q in queries:
        found = []
        for s in search:
            if ok(q) and ok(s):
                d = [np.float32(a) - np.float32(b) for a, b in zip(q[1:], s[1:])]
                dist = np.float32(np.sqrt(np.float64(np.float32(np.float32(d[0] * d[0] + d[1] * d[1]) + d[2] * d[2]))))
                if dist < r:
                    cell = tuple(int(np.trunc(np.float32(np.float32(c) / r))) for c in s[1:])
                    found.append((cell, s[0], dist))
        if epsilon > 0:
            seen, hits = [], 0
            for f in sorted(found):
                seen.append(f)
                hits += f[2] < np.float32(epsilon)
                if hits >= max(k, 1):
                    break
            found = seen
        found = sorted((float(d), i) for _, i, d in found)
        out += [(q[0], n, i, d) for n, (d, i) in enumerate(found[:k])]
    return out


def test_four_points(spark):
    c = cloud(spark, FOUR)
    got = NeighbourSearch(c, 4.0).find_neighbours(c.where("id = 0"), 3).orderBy("rank").collect()
    assert [r["search_id"] for r in got] == [0, 1, 2]
    assert np.allclose([r["distance"] for r in got], [0.0, 0.173, 3.410], atol=0.001)
    for radius, n in ((2.0, 2), (4.0, 4)):
        assert {r["n_neighbours"] for r in NeighbourSearch(c, radius).count_neighbours(c).collect()} == {n}


@pytest.mark.parametrize("strategy", ["auto", "broadcast", "shuffle_hash", "merge", "salted"])
def test_matches_brute_force(spark, strategy):
    rng = np.random.default_rng(7)
    rows = [(i, *map(float, rng.uniform(-1, 1, 3).astype("f4"))) for i in range(120)] + [(120 + i, 0.25, -0.25, 0.0) for i in range(5)]
    c = cloud(spark, rows)
    search = NeighbourSearch(c, 0.5, strategy=strategy)
    assert sorted(map(tuple, search.find_neighbours(c, 6).collect())) == sorted(brute(rows, rows, 0.5, 6))
    assert sorted(map(tuple, search.find_neighbours(c, 4, epsilon=0.4).collect())) == sorted(brute(rows, rows, 0.5, 4, 0.4))


def test_strict_radius_padding_and_missing(spark):
    s = cloud(spark, [(0, 0.0, 0.0, 0.0), (1, 0.5, 0.0, 0.0)])
    q = cloud(spark, [(7, 0.0, 0.0, 0.0), (8, 9.0, 9.0, 9.0), (9, float("nan"), 0.0, 0.0), (10, None, 0.0, 0.0), (11, float("inf"), 0.0, 1e30)])
    search = NeighbourSearch(s, 0.5)
    assert {r["query_id"]: r["n_neighbours"] for r in search.count_neighbours(q).collect()} == {7: 1, 8: 0, 9: 0, 10: 0, 11: 0}
    dense = {r["query_id"]: (r["indices"], r["distances"]) for r in search.find_neighbours_dense(q, 3).collect()}
    assert dense[7] == ([0, -1, -1], [0.0, -1.0, -1.0])
    assert all(dense[i] == ([-1] * 3, [-1.0] * 3) for i in (8, 9, 10, 11))
    assert all(r["indices"] == [] for r in search.find_neighbours_dense(q, 0).collect())
    far = cloud(spark, [(0, 1e30, -1e30, 0.0), (1, float("-inf"), 0.0, 0.0)])
    assert NeighbourSearch(far, 0.1).count_neighbours(far).where("query_id = 0").first()["n_neighbours"] == 1


def test_empty_sides(spark):
    none, one = cloud(spark, []), cloud(spark, FOUR)
    assert NeighbourSearch(none, 1.0).count_neighbours(one).agg(F.sum("n_neighbours")).first()[0] == 0
    assert NeighbourSearch(one, 1.0).find_neighbours(none, 2).count() == 0


@pytest.mark.parametrize("radius", [0.0, -1.0, float("nan"), float("inf")])
def test_bad_radius(spark, radius):
    with pytest.raises(ValueError):
        NeighbourSearch(cloud(spark, FOUR), radius)


def test_bad_k_and_columns(spark):
    c = cloud(spark, FOUR)
    with pytest.raises(ValueError):
        NeighbourSearch(c, 1.0).find_neighbours(c, -1)
    with pytest.raises(ValueError):
        points(c, "id", ("x", "y"))
    with pytest.raises(ValueError):
        points(c.withColumn("x", F.lit("a")))
    with pytest.raises(ValueError):
        points(c.drop("z"))


def test_casts_before_arithmetic(spark):
    wide = spark.createDataFrame([(0, 0.1, 16777217.0, 0.0)], "id long, x double, y double, z double")
    assert points(wide).first()["y"] == 16777216.0
    arrays = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0])], "id int, e array<double>")
    assert tuple(points(arrays, "id", "e").first()) == (0, 1.0, 2.0, 3.0)


def test_voxels(spark):
    c = cloud(spark, [(0, -0.5, 0.5, 1.5), (1, 0.5, -0.5, 1.2), (2, -1.5, 0.0, 0.0)])
    assert {tuple(r)[4:] for r in voxels.voxelise(c, 1.0, toward_zero=True).collect()} == {(0, 0, 1), (-1, 0, 0)}
    assert {tuple(r)[4:] for r in voxels.voxelise(c, 1.0).collect()} == {(-1, 0, 1), (0, -1, 1), (-2, 0, 0)}
    assert {tuple(r["ids"]) for r in voxels.occupancy(c, 1.0).collect()} == {(0, 1), (2,)}
    assert [tuple(r)[1:] for r in voxels.offsets(spark).orderBy("ord").collect()] == [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


def test_batches_and_stored_searcher(spark, tmp_path):
    c = cloud(spark, FOUR)
    whole = sorted(map(tuple, NeighbourSearch(c, 4.0).find_neighbours(c, 2).collect()))
    NeighbourSearch(c, 4.0).save(f"file://{tmp_path}/s")
    loaded = NeighbourSearch.load(spark, f"file://{tmp_path}/s")
    parts = [loaded.find_neighbours(c.where(F.col("id") % 2 == k), 2) for k in (0, 1)]
    assert sorted(map(tuple, parts[0].union(parts[1]).collect())) == whole
    kept = NeighbourSearch(c, 4.0).persist()
    assert sorted(map(tuple, kept.find_neighbours(c, 2).collect())) == whole
    kept.unpersist()


def test_no_nested_loops(spark):
    c = cloud(spark, FOUR)
    for strategy in ("auto", "merge", "salted"):
        plan = NeighbourSearch(c, 1.0, strategy=strategy).pairs(c)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.floats(-3, 3, width=32)] * 3), min_size=1, max_size=12), st.sampled_from([0.25, 0.1, 1.0]))
def test_count_is_number_of_pairs(spark, coords, radius):
    rows = [(i, *p) for i, p in enumerate(coords)]
    c = cloud(spark, rows)
    got = {r["query_id"]: r["n_neighbours"] for r in NeighbourSearch(c, radius).count_neighbours(c).collect()}
    want = brute(rows, rows, radius)
    assert got == {i: sum(w[0] == i for w in want) for i in range(len(rows))}


def test_stream(spark, tmp_path):
    from cellgrid.streaming.neighbours import stream_find, stream_pairs

    c = cloud(spark, FOUR)
    c.write.parquet(f"{tmp_path}/in")
    search = NeighbourSearch(c, 2.0)
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    stream_find(search, stream, 2, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").select("query_id", "rank", "search_id", "distance").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, search.find_neighbours(c, 2).collect()))
    assert stream_pairs(search, stream).isStreaming
