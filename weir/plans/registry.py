"""Where queries register themselves: a Spark form, and the SQL that another engine runs on the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str):
    """Registers a function of (spark, load), where load(name) is a table."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark, lambda t: table(spark, sf_dir, t))
        ORACLES[name] = oracle
        return f

    return register


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Registers SQL over the tables that it names; without `oracle` both engines run the same text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    QUERIES[name], ORACLES[name] = run, oracle or text
