"""Point-cloud and array analytics on Spark: neighbours within a radius, and row positions by field."""

from cellgrid.operators.grouping import group_counts, group_ids, group_positions, group_table, group_update, group_values, indices_by_field, indices_by_id, iterate_groups
from cellgrid.operators.neighbours import NeighbourSearch
from cellgrid.sources.points import points, with_row_index

__all__ = ["NeighbourSearch", "group_counts", "group_ids", "group_table", "group_update", "group_values", "indices_by_field", "indices_by_id", "iterate_groups", "points", "with_row_index"]
