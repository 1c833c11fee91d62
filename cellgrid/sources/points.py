"""Point clouds as rows (id BIGINT, x FLOAT, y FLOAT, z FLOAT), and dense row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrid.sources.shared import unused


def points(df: DataFrame, id_col: str = "id", coords: str | tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Project a table to a point cloud; other columns are pruned.

    coords: three numeric columns, or one array column whose first three
    entries are taken.  Coordinates are cast to 32-bit floats.  Ids should be unique and
    must be integers; rows keep null and non-finite coordinates here.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    wanted = (id_col, coords) if isinstance(coords, str) else (id_col, *coords)
    missing = [c for c in wanted if c not in fields]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    if not isinstance(fields[id_col], T.IntegralType):
        raise ValueError(f"{id_col} is not an integer column")
    if isinstance(coords, str):
        if not isinstance(fields[coords], T.ArrayType):
            raise ValueError(f"{coords} is not an array column")
        axes = [F.get(F.col(coords), i) for i in range(3)]
    elif len(coords) != 3:
        raise ValueError("three coordinates are needed")
    else:
        if bad := [c for c in coords if not isinstance(fields[c], T.NumericType)]:
            raise ValueError(f"not numeric: {bad}")
        axes = [F.col(c) for c in coords]
    return df.select(F.col(id_col).cast("long").alias("id"), *[a.cast("float").alias(n) for a, n in zip(axes, "xyz")])


def finite(*cols: Column) -> Column:
    """Whether all are neither null, NaN nor infinite."""
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce(out, F.lit(False))


def with_row_index(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Add the rows' positions 0, 1, ... in their present order.

    Counts each partition once and adds its offset; no row is moved.  The
    order is that of the partitions, so df has to be a plan whose partitions
    come out alike each time, such as a scan of files.
    """
    spark = df.sparkSession
    part, mono, offset = unused(df, "part", "mono", "offset")
    numbered = df.withColumn(part, F.spark_partition_id()).withColumn(mono, F.monotonically_increasing_id())
    counts = sorted(numbered.groupBy(part).count().collect())  # a row for each partition
    offsets, total = [], 0
    for at, n in counts:
        offsets.append((at, total))
        total += n
    table = spark.createDataFrame(offsets, f"`{part}` int, `{offset}` long")
    # The id's low 33 bits count the rows of its partition.
    local = F.col(mono).bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.join(F.broadcast(table), part).withColumn(name, F.col(offset) + local).drop(part, mono, offset)


def uniform_cloud(spark: SparkSession, n: int, side: float = 15.0, seed: int = 42) -> DataFrame:
    """n points dealt evenly over a cube."""
    axes = [(F.rand(seed + k) * side).cast("float").alias(c) for k, c in enumerate("xyz")]
    return spark.range(n).select("id", *axes)


def stacked_clusters(spark: SparkSession, n: int, copies: int, seed: int = 42) -> DataFrame:
    """One normal cluster of n points, stacked `copies` times: points repeat exactly."""
    axes = [F.randn(seed + k).cast("float").alias(c) for k, c in enumerate("xyz")]
    one = spark.range(n).select(F.col("id").alias("_i"), *axes)
    stacked = one.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return stacked.select((F.col("_copy") * n + F.col("_i")).cast("long").alias("id"), "x", "y", "z")


def integer_table(spark: SparkSession, n: int, top: int = 100, seed: int = 42) -> DataFrame:
    """Rows (row_idx, a, b, c) of integers from 0 to top - 1."""
    return spark.range(n).select(F.col("id").alias("row_idx"), *[F.floor(F.rand(seed + k) * top).cast("int").alias(c) for k, c in enumerate("abc")])
