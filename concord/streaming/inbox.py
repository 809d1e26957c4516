"""Streams of readings: an addition to the batch engine. Sheets are judged one by one, so a micro-batch needs no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files: int = 100) -> DataFrame:
    """Rows of new files in a folder, at most `files` of them at a time."""
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files).load(path)


def windowed(rows: DataFrame, time: str, by: str, value: str, late: str = "10 minutes", length: str = "1 hour", step: str | None = None) -> DataFrame:
    """Counts and sums in windows of event time; rows later than the watermark are left out."""
    w = F.window(time, length, step) if step else F.window(time, length)
    return rows.withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def latest(rows: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark: a sheet and method sent twice counts once."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def judge(rows: DataFrame, verdict: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs a batch plan over each micro-batch and appends its result under the batch's number: a batch that is repeated after a loss replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        verdict(df).write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    out = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="30 seconds")).start()
