"""Connected components of large graphs, by alternating star contraction; of small ones, on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, Scratch, drop_saved, save

#: Leaders are taken while more pairs than this for each row are left, and each halves them.
LEFT_OVER = 16
#: Graphs counted to have at most so many edges between integers are joined up on the driver.
DRIVER_EDGES = BROADCAST_ROWS


def _roots(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for a, b in zip(ends[: len(hi)].tolist(), ends[len(hi) :].tolist()):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return nodes, nodes[np.array([root(k) for k in range(len(nodes))], dtype=int)]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that it reaches.

    Each round ties every node's larger neighbours, then its smaller ones, to
    the least node around it.  The number of rounds grows with the logarithm
    of the graph's diameter; the edges never grow in number.  Minima are
    aggregated before the shuffle, and a node with very many edges is split by
    Spark's skew handling where it is joined.  The rounds are some dozens of
    jobs, however few the edges are, so up to DRIVER_EDGES go to the driver.
    """
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    if isinstance(kind := now.schema["hi"].dataType, T.IntegralType) and now.count() <= DRIVER_EDGES:
        ends = now.toArrow()
        found = pa.table(dict(zip(("node", "root"), _roots(ends["hi"].to_numpy(), ends["lo"].to_numpy()))))
        out = save(edges.sparkSession.createDataFrame(found).select(*[F.col(c).cast(kind).alias(c) for c in found.column_names]), "components")
        drop_saved(now)
        return out
    state = None
    while True:
        # Large stars: each node's larger neighbours get the least of its neighbourhood.
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = save(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct(), "large")
        drop_saved(least)
        # Small stars: each node and its smaller neighbours get the least of those.
        least = save(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        tied = large.join(least, "hi")
        after = save(
            tied.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", F.col("m").alias("lo"))).where("hi <> lo").distinct(), "edges"
        )
        for old in (least, large, now):
            drop_saved(old)
        found = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        now = after
        if found == state:
            out = now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select("lo", "lo").distinct())
            out._saved_path = now._saved_path
            return out
        state = found


def linked(
    rows: DataFrame, near: Column, verify: Callable[[DataFrame], DataFrame], hold: Scratch, left_over: int | None = None, edges: DataFrame | None = None
) -> DataFrame:
    """(node, root) of the components of all verified pairs of nodes that share a key.

    rows: (key, node, further columns) of the keys that several nodes have,
    saved; deleted once it is not needed.  near: what a pair has to meet, of the
    columns and those of the other node, which end in _b.  verify: gives the
    true ones of pairs (a, b), saved.  edges: true pairs (a, b) that are known
    before, saved.

    All nodes of a key are compared with one leader: first each node with the
    one that comes first of its keys' leaders, then, in keys whose nodes are
    not in one group by then, with those of all keys.  This makes at most as
    many pairs as there are rows.  While many pairs of different groups are
    left, another leader is taken; the rest is compared in full, so no link is
    lost.
    """
    left_over = LEFT_OVER if left_over is None else left_over
    columns = [c for c in rows.columns if c != "key"]
    parts, left, turn = None, None, 0

    def meet(others: DataFrame, condition: Column, one: Column | None = None) -> DataFrame:
        pairs = rows.join(others, (F.col("key") == F.col("key_b")) & condition & near)
        pairs = pairs.groupBy("node").agg(F.min_by("node_b", one).alias("node_b")) if one is not None else pairs
        return verify(pairs.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")))

    def grouped() -> tuple[DataFrame, DataFrame]:
        """The components of the edges, and the rows of keys whose nodes are in several, with their labels."""
        found = components(edges)
        hold.tables.append(found)
        labelled = rows.drop("label").join(found, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
        labelled = hold.save(labelled, "labelled")
        mixed = labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("greatest")).where("least <> greatest").select("key")
        still = hold.save(labelled.join(mixed, "key"), "mixed")
        drop_saved(labelled, rows, *([parts] if parts is not None else []))
        hold.sweep()
        return found, still

    if edges is not None:
        parts, rows = grouped()
    else:
        path = getattr(rows, "_saved_path", None)
        rows = rows.withColumn("label", F.col("node"))
        rows._saved_path = path
    while True:
        seed = F.lit(max(0, turn - 1))
        order = F.xxhash64("node", seed)
        leaders = rows.groupBy(F.col("key").alias("key_b")).agg(*[F.min_by(c, order).alias(f"{c}_b") for c in (*columns, "label")])
        more = meet(leaders, F.col("label") != F.col("label_b"), None if turn else F.xxhash64("node_b", seed))
        if edges is not None:
            both = hold.save(edges.union(more), "edges")
            drop_saved(edges, more)
            more = both
        edges = more
        parts, rows = grouped()
        groups = rows.groupBy("key", "label").count()
        totals = groups.groupBy("key").agg((F.pow(F.sum("count"), 2) - F.sum(F.pow("count", F.lit(2)))).alias("pairs"), F.sum("count").alias("n"))
        pairs, n = totals.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n or turn and (pairs <= left_over * n or left is not None and pairs * 2 > left):
            break
        left, turn = pairs if turn else None, turn + 1
    if n:
        others = rows.select(*[F.col(c).alias(f"{c}_b") for c in rows.columns])
        more = meet(others, (F.col("node") < F.col("node_b")) & (F.col("label") != F.col("label_b")))
        if not more.isEmpty():
            drop_saved(parts)
            parts = components(edges.union(more))
            hold.tables.append(parts)
    drop_saved(rows)
    hold.sweep()
    return parts
