"""Helpers shared by the operators: table access, shared storage, native word splitting."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.sources.shared import shared_dir

#: Broadcast hints are given only to tables counted to hold at most so many rows.
BROADCAST_ROWS = 200_000
#: The same for rows of a few numbers each.
NARROW_ROWS = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words of letters and digits, once A-Z are lower case.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.option("compression", codec) if codec else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def drop_saved(*tables: DataFrame) -> None:
    """Delete tables of save() that no later plan reads."""
    for df in tables:
        path = getattr(df, "_saved_path", None)
        if path:
            delete(df.sparkSession, path)


class Scratch:
    """The tables that a computation saves on its way."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def save(self, df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
        out = save(df, label, codec)
        self.tables.append(out)
        return out

    def drop(self, *keep: DataFrame) -> None:
        """Delete all but the given tables.

        Spark removes the files of finished shuffles when the driver collects
        its garbage, which a driver with little to do does rarely; so it is
        asked to.
        """
        drop_saved(*[t for t in self.tables if not any(t is k for k in keep)])
        self.tables = [t for t in self.tables if any(t is k for k in keep)]
        self.sweep()

    def sweep(self) -> None:
        """Have Spark remove the files of shuffles that no plan reads any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the counted rows are within the bound; else leave the join to shuffle."""
    return F.broadcast(df) if rows <= most else df


def at_once(value: Column) -> Column:
    """The value, computed once a row.

    Spark's compiled code puts off what it can: a column made before an
    explode() is otherwise computed again for each row that this makes.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


#: Characters beside A-Z that lower() changes; those among them of Latin-1; a mark from the private area.
_CHANGING = r"\p{javaUpperCase}\p{javaTitleCase}&&[^A-Z]"
_LATIN, _MARK = "\u00c0-\u00d6\u00d8-\u00de", "\ue000"
_LATIN_UPPER = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)]))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other characters so that words are equal just if they are under that rule alone.

    translate() looks up each character and is slow.  lower() gives the same
    for texts without other capital letters.  A capital of Latin-1 becomes its
    small letter and a mark, a mark becomes two; texts with further capitals
    or the mark itself go through translate().
    """
    other = text.rlike(rf"{_MARK}|[{_CHANGING}&&[^{_LATIN}]]")
    marked = F.regexp_replace(text, f"([{_LATIN}{_MARK}])", f"$1{_MARK}")
    plain = (F.octet_length(text) == F.length(text)) | ~text.rlike(f"{_MARK}|[{_CHANGING}]")
    return F.when(plain, F.lower(text)).when(other, F.translate(marked, UPPER + _LATIN_UPPER, LOWER + _LATIN_UPPER.lower())).otherwise(F.lower(marked))


def spaced_words(text: Column) -> Column:
    """Words of letters and digits in lower case, one space between them; null has none."""
    return F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), WORD_GAP, " "))


def words_of(text: Column) -> Column:
    """Words of letters and digits, in lower case as by lower_ascii(); null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), WORD_GAP, -1), "")
