"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import materialize, scratch  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(name: str, taken: list[str]) -> str:
    """name with as many leading underscores as it takes to differ from all names taken."""
    own = {c.lower() for c in taken}
    while name.lower() in own:
        name = f"_{name}"
    return name


def text_digest(text: str = "text") -> Column:
    """16-byte identity of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


HOT = 1000


def spread_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """many (a written table, keys not null) joined with one (a row a key), whatever share of many's rows a key holds.

    Keys of a HOT-th of the rows or more, of which there are HOT at most, meet by broadcast; all
    others by shuffle, where none holds more than that share.
    """
    rows = many.count()
    hot = materialize(many.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT >= rows).select(key))
    own = one.join(F.broadcast(hot), key, "left_semi")
    near = many.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(own), key, how)
    return near.unionByName(many.join(F.broadcast(hot), key, "left_anti").join(one, key, how))
