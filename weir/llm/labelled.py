"""What the two classifiers share: the bounded labelled sample and the held-out folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(n: int) -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def sample(docs: DataFrame, labels: DataFrame, label: str, train: F.Column, rows: int) -> DataFrame:
    """(text, label 0/1) of at most `rows` labelled documents outside the held-out fold, the first ones in the order of a hash of doc_id.

    Of a doc_id's several texts or labels one pair is taken. Ids are chosen first, so that only the sample's texts move.
    """
    known = labels.where(F.col(label).isin(0, 1)).where(train).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = known.join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most `rows` ids: a size that the parameter bounds.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min(F.struct("label", "text")).alias("r")).select("doc_id", "r.text", "r.label")
