"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weir.llm import jaccard, lines, mixing, nearest, quality, rules, secrets, sentencepieces, token_files, toxicity
from weir.llm.common import load


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(load(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_decode(load(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_digests(token_files.write_files(load(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json")))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_of(load(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, load(spark, sf_dir, "labels")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(load(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduped(load(spark, sf_dir, "documents"), least_words=1)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sorted_mix(mixing.mixed(load(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "position")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = nearest.index(load(spark, sf_dir, "embeddings"))
    return nearest.nearest(indexed, indexed.where("vec_id % 20 = 0").select("vec_id", "vector"), 20)


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_sentencepiece, op3_token_files, op4_secret_scans, op5_quality_classifier, op7_toxicity, op6_quality_rules, op8_line_dedup, op9_mixing, op10_nearest_neighbours)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": jaccard.ORACLE, "op6_quality_rules": rules.ORACLE, "op8_line_dedup": lines.ORACLE, "op9_mixing": mixing.ORACLE}
