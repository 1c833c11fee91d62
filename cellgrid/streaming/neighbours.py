"""Neighbours of points that arrive in a stream, among fixed search points."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cellgrid.operators.neighbours import NeighbourSearch


def stream_pairs(search: NeighbourSearch, stream: DataFrame) -> DataFrame:
    """pairs() for a streaming table of points: a stream-static join without state."""
    return search.pairs(stream)


def stream_find(search: NeighbourSearch, stream: DataFrame, k: int, path: str, checkpoint: str, epsilon: float = 0.0):
    """Write find_neighbours() of each micro-batch under path; the batch's number makes a retried write land in the same place."""

    def batch(df: DataFrame, number: int) -> None:
        search.find_neighbours(df, k, epsilon).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
