"""A training corpus from the table of documents, in five stages.

Each stage is a function of (spark, docs, sf_dir) and works on all that the one before has kept; all but the last return the
columns of documents. run() writes each stage's rows to the shared folder and reads them again, so a lost executor costs
one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weir.llm import jaccard, lines, mixing, quality, sentencepieces
from weir.llm.common import Scratch, load


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.accepted(docs, quality.train(docs, load(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines like an earlier one, and documents that lose all their words."""
    return lines.without_repeats(docs, least_words=1)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of similar ones."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that each source's words come near its target."""
    return mixing.copies(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and decoded text."""
    import public_tokenizers

    return sentencepieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", classify_quality),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_documents),
    ("mixing", mix_sources),
    ("sentencepiece", encode_texts),
]

#: The classifier is trained here, which SQL can't express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.table(docs)
    return docs
