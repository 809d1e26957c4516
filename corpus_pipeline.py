"""The training-corpus pipeline: quality, line dedup, near dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet to the
shared folder and read again as the next stage's docs. All stages but the last return the columns of
their input with n_chars brought up to date.

Defined cases: null and empty texts pass the stages that cannot judge them (the classifier scores
them by its bias); rows without doc_id lose no lines and have no near copies; rows of one doc_id with
one text stay or go together; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from concord.llm.frames import mark, release, settle, table
from concord.llm.queries import tokenizer

SHINGLE, PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines found in three documents or more stay in the one of largest doc_id alone."""
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least doc_id stays."""
    gone = near_dedup.near_duplicates(docs, SHINGLE, PERCENT).filter("NOT kept").select("doc_id").distinct()
    # the ids grow with the documents: a shuffle at every size, never a broadcast
    return docs.join(settle(gone, "near-copies").hint("merge"), "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the token ids and of the text they decode to, and the ids themselves."""
    return bpe.encode(docs, *tokenizer(), digest=True, forms=True).drop("decoded")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", to_tokens),
]
#: The classifier is a trained model: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    begun = mark()
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, begun, docs)  # what the stage and those before it wrote on their way
    return docs
