"""The registered queries, and DuckDB SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that come in fewer pieces than there are cores (one small file) are dealt over the cores, others left as they are.
    Parts are always dealt: short rows of much work each, whose file may be one row group and so one task, however many pieces it is cut to."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "part":
        return df.repartition(max(cores, df.rdd.getNumPartitions()))
    if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
