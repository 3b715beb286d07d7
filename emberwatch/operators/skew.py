"""Helpers that keep one hot key from filling one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int, spread: Column, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of every key.

    Ranks inside (key, salt) first, so the final rank of a hot key sees at
    most ``n * SALTS`` rows whatever the key's size.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    cut = salted.withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= n).drop("_rank", "_salt")
    name = rank or "_rank"
    final = cut.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return final if rank else final.drop(name)


def spread(df: DataFrame, keep: list, values: Column, name: str) -> DataFrame:
    """One row per element of an array.

    The outer form with a test afterwards: the plain one makes the optimizer
    copy a costly array expression into a filter and so work it out twice.
    """
    return df.select(*keep, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())


def once(df: DataFrame, column: Column, name: str) -> DataFrame:
    """Add a costly column that later filters may read without it being worked out again.

    A filter on a plain column is pushed below its projection with a copy of
    the expression; it stays above a generator.
    """
    return df.select("*", F.explode_outer(F.array(column)).alias(name))
