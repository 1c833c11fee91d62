"""The queries of the neighbour and grouping operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid import NeighbourSearch, group_counts, group_ids, group_update, group_values, indices_by_field, indices_by_id, points
from cellgrid.operators import voxels
from cellgrid.operators.grouping import group_positions, iterate_groups
from cellgrid.sources.points import stacked_clusters
from cellgrid.sources.shared import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _listed(df: DataFrame, col: str = "indices", name: str = "indices") -> DataFrame:
    """Lists as text, which compares alike everywhere."""
    return df.withColumn(name, F.concat_ws(",", F.col(col).cast("array<string>")))


def project_points(spark, sf_dir):
    return cloud(spark, sf_dir)


def project_part(spark, sf_dir):
    return points(_table(spark, sf_dir, "part"), "p_partkey", ("p_size", "p_retailprice", "p_partkey"))


def voxel_assign(spark, sf_dir):
    return voxels.voxelise(cloud(spark, sf_dir), 0.2, toward_zero=True).select("id", "vx", "vy", "vz")


def voxel_occupancy(spark, sf_dir):
    return _listed(voxels.occupancy(cloud(spark, sf_dir), 0.2), "ids", "ids")


def voxel_offsets(spark, sf_dir):
    return voxels.offsets(spark).select(F.col("ord").cast("long").alias("ord"), "dx", "dy", "dz")


def candidate_pairs(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return NeighbourSearch(c, 0.2).candidates(c, toward_zero=True).select("query_id", "search_id")


def radius_pairs(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return NeighbourSearch(c, 0.1).pairs(c).select("query_id", "search_id", "distance")


def knn_self(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return NeighbourSearch(c, 0.2).find_neighbours(c, 5)


def _two(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    return tuple(points(e.where(w), "vec_id", "embedding") for w in ("label = 0", "label <> 0 or label is null"))


def knn_two_sets(spark, sf_dir):
    q, s = _two(spark, sf_dir)
    return NeighbourSearch(s, 0.05).find_neighbours(q, 5)


def knn_dense(spark, sf_dir):
    q, s = _two(spark, sf_dir)
    out = NeighbourSearch(s, 0.05).find_neighbours_dense(q, 5)
    return out.select("query_id", F.posexplode(F.arrays_zip("indices", "distances")).alias("rank", "e")).select("query_id", "rank", F.col("e.indices").alias("search_id"), F.col("e.distances").alias("distance"))


def knn_epsilon(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return NeighbourSearch(c, 0.2).find_neighbours(c, 5, epsilon=0.12)


def count_near(radius: float) -> Query:
    def run(spark, sf_dir):
        c = cloud(spark, sf_dir)
        return NeighbourSearch(c, radius).count_neighbours(c)

    return run


def knn_batched(spark, sf_dir):
    c = cloud(spark, sf_dir)
    search = NeighbourSearch(c, 0.2)
    even, odd = (search.find_neighbours(c.where(F.col("id") % 2 == k), 5) for k in (0, 1))
    return even.union(odd)


def persisted_searcher(spark, sf_dir):
    path = f"{shared_dir(spark)}/searcher-{uuid.uuid4().hex}"
    c = cloud(spark, sf_dir)
    NeighbourSearch(c, 0.2).save(path)
    return NeighbourSearch.load(spark, path).find_neighbours(c, 5)


def salted_search(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return NeighbourSearch(c, 0.2, strategy="salted").find_neighbours(c, 5)


def by_field(table: str, fields, row: str) -> Query:
    return lambda spark, sf_dir: _listed(indices_by_field(_table(spark, sf_dir, table), fields, row))


def indices_dense_id(spark, sf_dir):
    ids = group_ids(_table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])
    return _listed(indices_by_id(ids, "group_id", "o_orderkey"))


def indices_long(spark, sf_dir):
    return group_positions(_table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey")


def indices_32_bit(spark, sf_dir):
    return indices_by_field(_table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", "int").select("c_mktsegment", F.posexplode("indices").alias("ordinal", "row"))


def groups_in_turn(spark, sf_dir):
    """The groups as iterate_groups() hands them out, one after another."""
    rows = [(field, len(found), int(min(found)), int(max(found))) for field, found in iterate_groups(_table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey")]
    return spark.createDataFrame(rows, "c_mktsegment string, n_rows long, first long, last long")


def stacked(spark, sf_dir):
    """Each point of a cluster stacked three times has its copies at no distance."""
    c = stacked_clusters(spark, 200, 3)
    found = NeighbourSearch(c, 1e-6).find_neighbours(c, 3)
    return found.select("query_id", "rank", "search_id", F.col("distance").cast("double").alias("distance"))


def dense_group_id(spark, sf_dir):
    return group_ids(_table(spark, sf_dir, "orders"), ("o_orderstatus", "o_orderpriority")).select("o_orderkey", "group_id")


def distinct_values(spark, sf_dir):
    return group_values(_table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


def counts(spark, sf_dir):
    return group_counts(_table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


def update(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return group_update(lines, "l_returnflag", most=F.max("l_quantity"), n=F.count("*"))


QUERIES: dict[str, Query] = {
    "project_points": project_points, "project_part": project_part,
    "voxel_assign": voxel_assign, "voxel_occupancy": voxel_occupancy, "voxel_offsets": voxel_offsets,
    "candidate_pairs": candidate_pairs, "radius_pairs": radius_pairs,
    "knn_self": knn_self, "knn_two_sets": knn_two_sets, "knn_dense": knn_dense, "knn_epsilon": knn_epsilon, "knn_batched": knn_batched,
    "persisted_searcher": persisted_searcher, "salted_search": salted_search,
    "count_neighbours": count_near(0.05), "count_neighbours_wide": count_near(0.1),
    "indices_single": by_field("orders", "o_orderstatus", "o_orderkey"), "indices_multi": by_field("orders", ["o_orderstatus", "o_orderpriority"], "o_orderkey"),
    "indices_string_key": by_field("customer", ("c_mktsegment",), "c_custkey"),
    "indices_long": indices_long, "indices_32_bit": indices_32_bit, "groups_in_turn": groups_in_turn, "stacked_clusters": stacked,
    "indices_by_id": indices_dense_id, "group_ids": dense_group_id, "group_values": distinct_values, "group_counts": counts, "group_update": update,
}

_CLOUD = "SELECT vec_id AS id, CAST(embedding[1] AS FLOAT) AS x, CAST(embedding[2] AS FLOAT) AS y, CAST(embedding[3] AS FLOAT) AS z FROM embeddings"
_CELLS = "SELECT *, " + ", ".join(f"CAST(trunc(CAST({c} / CAST(0.2 AS FLOAT) AS FLOAT)) AS BIGINT) AS v{c}" for c in "xyz") + f" FROM ({_CLOUD})"


def _pairs(radius: float, query: str = _CLOUD, search: str = _CLOUD) -> str:
    dx, dy, dz = (f"(q.{c} - s.{c})" for c in "xyz")
    return (
        f"SELECT * FROM (SELECT q.id AS query_id, s.id AS search_id, CAST(sqrt({dx} * {dx} + {dy} * {dy} + {dz} * {dz}) AS FLOAT) AS distance"
        f" FROM ({query}) q, ({search}) s) WHERE distance < CAST({radius} AS FLOAT)"
    )


def _nearest(pairs: str, k: int) -> str:
    return f"SELECT query_id, CAST(rn - 1 AS INTEGER) AS rank, search_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, search_id) AS rn FROM ({pairs})) WHERE rn <= {k}"


def _count(radius: float) -> str:
    return f"SELECT c.id AS query_id, count(p.search_id) AS n_neighbours FROM ({_CLOUD}) c LEFT JOIN ({_pairs(radius)}) p ON c.id = p.query_id GROUP BY c.id"


def _lists(table: str, fields: str, row: str) -> str:
    return f"SELECT {fields}, string_agg(CAST({row} AS VARCHAR), ',' ORDER BY {row}) AS indices FROM {table} GROUP BY {fields}"


_Q0, _S0 = (f"SELECT * FROM ({_CLOUD}) WHERE id IN (SELECT vec_id FROM embeddings WHERE {w})" for w in ("label = 0", "label <> 0 OR label IS NULL"))
_KNN = _nearest(_pairs(0.2), 5)
_EPS_PAIRS = (
    "SELECT * FROM (SELECT p.*, coalesce(sum(CASE WHEN distance < CAST(0.12 AS FLOAT) THEN 1 ELSE 0 END) OVER"
    " (PARTITION BY query_id ORDER BY vx, vy, vz, search_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen"
    f" FROM (SELECT r.*, v.vx, v.vy, v.vz FROM ({_pairs(0.2)}) r JOIN ({_CELLS}) v ON r.search_id = v.id) p) WHERE seen < 5"
)
_GROUP = "dense_rank() OVER (ORDER BY o_orderstatus, o_orderpriority) - 1 AS group_id"

SQL: dict[str, str] = {
    "project_points": _CLOUD,
    "project_part": "SELECT p_partkey AS id, CAST(p_size AS FLOAT) AS x, CAST(p_retailprice AS FLOAT) AS y, CAST(p_partkey AS FLOAT) AS z FROM part",
    "voxel_assign": f"SELECT id, vx, vy, vz FROM ({_CELLS})",
    "voxel_occupancy": f"SELECT vx, vy, vz, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, count(*) AS n_points FROM ({_CELLS}) GROUP BY vx, vy, vz",
    "voxel_offsets": "SELECT row_number() OVER (ORDER BY dx, dy, dz) - 1 AS ord, dx, dy, dz FROM (SELECT CAST(a AS BIGINT) AS dx, CAST(b AS BIGINT) AS dy, CAST(c AS BIGINT) AS dz FROM range(-1, 2) t(a), range(-1, 2) u(b), range(-1, 2) v(c))",
    "candidate_pairs": f"SELECT q.id AS query_id, s.id AS search_id FROM ({_CELLS}) q, ({_CELLS}) s WHERE abs(q.vx - s.vx) <= 1 AND abs(q.vy - s.vy) <= 1 AND abs(q.vz - s.vz) <= 1",
    "radius_pairs": _pairs(0.1),
    "knn_self": _KNN, "knn_batched": _KNN, "persisted_searcher": _KNN, "salted_search": _KNN,
    "knn_two_sets": _nearest(_pairs(0.05, _Q0, _S0), 5),
    "knn_dense": f"SELECT q.id AS query_id, CAST(r.rank AS INTEGER) AS rank, coalesce(n.search_id, -1) AS search_id, coalesce(n.distance, CAST(-1 AS FLOAT)) AS distance FROM ({_Q0}) q CROSS JOIN range(0, 5) r(rank) LEFT JOIN ({_nearest(_pairs(0.05, _Q0, _S0), 5)}) n ON n.query_id = q.id AND n.rank = r.rank",
    "knn_epsilon": _nearest(_EPS_PAIRS, 5),
    "count_neighbours": _count(0.05), "count_neighbours_wide": _count(0.1),
    "indices_single": _lists("orders", "o_orderstatus", "o_orderkey"), "indices_multi": _lists("orders", "o_orderstatus, o_orderpriority", "o_orderkey"),
    "indices_string_key": _lists("customer", "c_mktsegment", "c_custkey"),
    "indices_by_id": _lists(f"(SELECT o_orderkey, {_GROUP} FROM orders)", "group_id", "o_orderkey"),
    "indices_long": "SELECT o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) - 1 AS ordinal, o_orderkey FROM orders",
    "indices_32_bit": "SELECT c_mktsegment, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS INTEGER) AS ordinal, CAST(c_custkey AS INTEGER) AS row FROM customer",
    "groups_in_turn": "SELECT c_mktsegment, count(*) AS n_rows, min(c_custkey) AS first, max(c_custkey) AS last FROM customer GROUP BY c_mktsegment",
    "stacked_clusters": "SELECT CAST(q * 200 + i AS BIGINT) AS query_id, CAST(r AS INTEGER) AS rank, CAST(r * 200 + i AS BIGINT) AS search_id, CAST(0 AS DOUBLE) AS distance FROM range(0, 200) a(i), range(0, 3) b(q), range(0, 3) c(r)",
    "group_ids": f"SELECT o_orderkey, {_GROUP} FROM orders",
    "group_values": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "group_counts": "SELECT o_orderstatus, o_orderpriority, count(*) AS n_rows FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "group_update": "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, max(l_quantity) OVER (PARTITION BY l_returnflag) AS most, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem",
}
