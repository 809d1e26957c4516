"""Reading tables, cutting lineage and sizing work, as all operators of this subpackage do it."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. With texts of a few KB a batch stays at a few MB; operators slice it further.
ROWS_PER_BATCH = 512


def tune(spark: SparkSession) -> None:
    """Small Arrow batches: their bytes, not their rows, must fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where that is unset (tests), one of our own."""
    here = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not here:
        import tempfile

        here = "file://" + tempfile.mkdtemp(prefix="concord-")
        spark.conf.set("spark.checkpoint.dir", here)
    return here.rstrip("/")


class _Made(threading.local):
    """Paths of the tables that a thread settled so far, in order: queries built at once in several threads keep theirs apart. See release."""

    def __init__(self):
        self.paths: list[str] = []


_made = _Made()


def settle(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    # mostly hashes and ids, which no codec shortens
    df.write.option("compression", "uncompressed").parquet(path)
    _made.paths.append(path)
    back = spark.read.schema(schema).parquet(path)
    back._settled = path
    return back


def mark() -> int:
    """Where release begins."""
    return len(_made.paths)


def release(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Deletes the tables settled since the mark, but for those of `keep`: nothing that is read from here on may need the others."""
    kept = {getattr(d, "_settled", None) for d in keep}
    gone = [p for p in _made.paths[since:] if p not in kept]
    _made.paths[since:] = [p for p in _made.paths[since:] if p in kept]
    conf = spark._jsc.hadoopConfiguration()
    for p in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: str = "text") -> Column:
    """Tells rows of one doc_id with different texts apart; equal rows share their decisions."""
    return F.xxhash64(F.col(text))


def text_keys(text: str = "text") -> tuple[Column, Column]:
    """text_key and as many bits again, of another seed: 128 bits tell any number of rows of one doc_id apart."""
    return text_key(text), F.xxhash64(F.lit(1), F.col(text))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in taken:
            n = "_" + n
        taken.add(n)
        out.append(n)
    return out


def plain(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text and the named columns alone: other columns of the input never clash with ours."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
