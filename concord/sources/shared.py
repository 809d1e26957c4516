"""Tables that a plan reads several times, written to the folder all executors share: they survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own: list[str] = []


def folder(spark) -> str:
    """The folder spark.checkpoint.dir names; where it is unset (tests, one machine), one of our own."""
    here = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not here:
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="concord-"))
        here = _own[0]
    return here.rstrip("/")


def kept(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet and read again: computed once, whatever reads it."""
    spark, path = df.sparkSession, f"{folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
