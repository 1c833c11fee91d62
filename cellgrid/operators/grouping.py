"""Row positions by the values of fields."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.sources.shared import materialised, unused

Fields = str | list[str] | tuple[str, ...]


def field_list(df: DataFrame, fields: Fields) -> list[str]:
    names = [fields] if isinstance(fields, str) else list(fields)
    if not names:
        raise ValueError("no fields")
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    return names


def indices_by_field(df: DataFrame, fields: Fields, row_col: str = "row_idx", indices_type: str = "bigint") -> DataFrame:
    """(fields..., indices): the ascending row positions of each distinct value. Nulls form a group, as do NaNs."""
    names = field_list(df, fields)
    positions = F.array_sort(F.collect_list(F.col(row_col).cast(indices_type)))
    return df.groupBy(*names).agg(positions.alias("indices"))


def iterate_groups(df: DataFrame, fields: Fields, row_col: str = "row_idx", indices_type: str = "bigint") -> Iterator[tuple]:
    """The groups one after another as (value or tuple of values, positions); one partition at a time is fetched."""
    single = isinstance(fields, str)
    for row in indices_by_field(df, fields, row_col, indices_type).toLocalIterator():
        *values, indices = row
        yield (values[0] if single else tuple(values)), indices


def group_values(df: DataFrame, fields: Fields) -> DataFrame:
    return df.select(*field_list(df, fields)).distinct()


def group_counts(df: DataFrame, fields: Fields) -> DataFrame:
    return df.groupBy(*field_list(df, fields)).agg(F.count("*").alias("n_rows"))


def _numbered(sorted_rows: DataFrame, name: str) -> DataFrame:
    """Rows sorted over ranges with their position: each range's starts after the counts of those before it, so no single task sees them all."""
    spark = sorted_rows.sparkSession
    part, base = unused(sorted_rows, "part", "base")
    numbered = materialised(sorted_rows.withColumns({part: F.spark_partition_id(), name: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    total, offsets = 0, []
    for at, n in sorted(numbered.groupBy(part).count().collect()):  # a row for each partition
        offsets.append((at, total))
        total += n
    table = F.broadcast(spark.createDataFrame(offsets, f"`{part}` int, `{base}` long"))
    return numbered.join(table, part).withColumn(name, F.col(base) + F.col(name)).drop(part, base)


def group_table(df: DataFrame, fields: Fields) -> DataFrame:
    """(fields..., group_id): ids from 0 in the order of the values, which are sorted over ranges."""
    names = field_list(df, fields)
    return _numbered(df.select(*names).distinct().repartitionByRange(*names).sortWithinPartitions(*names), "group_id")


def _with_keys(table: DataFrame, df: DataFrame, names: list[str]) -> tuple[DataFrame, Column, list[str]]:
    """table with its fields renamed to names that df lacks, the condition that joins both, and the new names."""
    keys = unused(df, *[f"key_{c}" for c in names])
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`{k}`")) for c, k in zip(names, keys)])
    return table.withColumnsRenamed(dict(zip(names, keys))), same, keys


def group_ids(df: DataFrame, fields: Fields) -> DataFrame:
    """df with group_id added."""
    table, same, keys = _with_keys(group_table(df, fields), df, field_list(df, fields))
    return df.join(table, same).drop(*keys)


def group_positions(df: DataFrame, fields: Fields, row_col: str = "row_idx", indices_type: str = "bigint") -> DataFrame:
    """(fields..., ordinal, row): indices_by_field() in long form, for groups of any size.

    Rows are sorted over ranges of the fields and positions; a row's ordinal is
    its place less that of its group's first row.  A group that fills many
    ranges is in as many tasks.
    """
    names = field_list(df, fields)
    rows = df.select(*names, F.col(row_col).cast(indices_type).alias(row_col))
    (place,) = unused(rows, "place")
    placed = _numbered(rows.repartitionByRange(*names, row_col).sortWithinPartitions(*names, row_col), place)
    (first,) = unused(placed, "first")
    starts, same, keys = _with_keys(placed.groupBy(*names).agg(F.min(place).alias(first)), placed, names)
    return placed.join(starts, same).select(*names, (F.col(place) - F.col(first)).alias("ordinal"), row_col)


def indices_by_id(ids: DataFrame, id_col: str = "group_id", row_col: str = "row_idx") -> DataFrame:
    """(group_id, indices) from rows that have their group's id."""
    return indices_by_field(ids, id_col, row_col)


def group_update(df: DataFrame, fields: Fields, **updates: Column) -> DataFrame:
    """df with columns set from aggregates over each row's group, such as group_update(t, "a", mean=F.avg("b"))."""
    names = field_list(df, fields)
    values = unused(df, *[f"new_{n}" for n in updates])
    totals, same, _ = _with_keys(df.groupBy(*names).agg(*[e.alias(v) for v, e in zip(values, updates.values())]), df.select("*", *[F.lit(0).alias(v) for v in values]), names)
    joined = df.join(totals, same)
    return joined.select(*[df[c] for c in df.columns if c not in updates], *[F.col(v).alias(n) for v, n in zip(values, updates)])
