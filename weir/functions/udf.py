"""Functions of the user: scalar ones over Arrow batches, aggregates, and table functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType


def scalar(spark: SparkSession, name: str, f: Callable, returns: str):
    """Registers f(*values) under a name for SQL, and returns it for DataFrames; rows go to Python in Arrow batches, nulls as None."""
    return spark.udf.register(name, F.udf(f, returns, useArrow=True))


def vectorized(spark: SparkSession, name: str, f: Callable[..., pd.Series], returns: str):
    """Registers f(*series), which gets whole batches as pandas series."""

    return spark.udf.register(name, F.pandas_udf(f, returns, PandasUDFType.SCALAR))


def aggregate(spark: SparkSession, name: str, f: Callable[[pd.Series], object], returns: str):
    """Registers f(series of a group); a group's values meet in one task, so it is for groups that fit there."""
    return spark.udf.register(name, F.pandas_udf(f, returns, PandasUDFType.GROUPED_AGG))


def table(spark: SparkSession, name: str, handler: type, returns: str):
    """Registers a table function: a class whose eval(*values) yields tuples. In SQL it follows LATERAL."""
    found = F.udtf(handler, returnType=returns)
    spark.udtf.register(name, found)
    return found
