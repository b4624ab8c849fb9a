"""Exact-size samples, reservoirs and shuffles that give the same rows at every partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def arithmetic_hash(c: Column) -> Column:
    """Multiplicative hash of an integer, below 2^32."""
    return F.pmod(c * 2654435761, F.lit(1 << 32))


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement, in key order; n beyond the table raises."""
    if n > df.count():
        raise ValueError("sample larger than the table")
    picked = df.orderBy(arithmetic_hash(F.col(key) + seed), key).limit(n)
    return picked.orderBy(key)


def reservoir(df: DataFrame, n: int, group: str, key: str, seed: int = 0) -> DataFrame:
    """At most n rows of each group."""
    w = Window.partitionBy(group).orderBy(arithmetic_hash(F.col(key) + seed), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def shuffle(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(arithmetic_hash(F.col(key) + seed), key)


def split(df: DataFrame, parts: int, key: str, seed: int = 123) -> DataFrame:
    """df with part: an even random split."""
    return df.withColumn("part", F.pmod(arithmetic_hash(F.col(key) + seed), F.lit(parts)).cast("int"))
