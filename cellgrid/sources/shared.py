"""Storage that the driver and all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir or SparkContext.setCheckpointDir(); without one, a folder of this machine if all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named or found.isDefined():
        return (named or found.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("/tmp/cellgrid-checkpoints")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialised(df: DataFrame) -> DataFrame:
    """df computed once and read back from the shared folder, so that its partitions stay as they are."""
    shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that columns of df have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
