"""Neighbour search and grouping."""
