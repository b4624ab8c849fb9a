"""Norm buckets by the sequential rule, block offsets and active buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .shared import materialize, numbered


def bucket_offsets(lengths: list[float], factor: float = 0.9, least: int = 30, most: int | None = None, first: int = 0) -> list[int]:
    """Starts of buckets over lengths sorted in descending order.

    A bucket closes once it has `least` rows and the next length falls below factor times
    its first, or once it has `most` rows.  With first, the `first` longest make a bucket of their own.
    """
    offsets = [0] + ([first] if 0 < first < len(lengths) else [])
    start = offsets[-1]
    for i in range(start + 1, len(lengths)):
        size = i - start
        if size >= least and (lengths[i] < factor * lengths[start] or (most and size >= most)):
            offsets.append(i)
            start = i
    return offsets


def bucketize(probes: DataFrame, factor: float = 0.9, least: int = 30, most: int | None = None, first: int = 0) -> DataFrame:
    """(id, norm, bucket) by the sequential rule, over rows numbered range by range.

    Where a bucket ends depends on where it starts, so starts are found one after the other,
    each by one aggregation over the numbered lengths that is answered by one row.
    """
    ranked = materialize(numbered(probes.select("id", V.norm("vec").alias("norm")), F.desc("norm"), "id", name="place"))
    rows = ranked.count()
    head = ranked.agg(F.max("norm").alias("norm")).first()
    starts, start, norm = [0], 0, head.norm
    if 0 < first < rows:
        start, norm = first, ranked.where(F.col("place") == first).first().norm
        starts.append(start)
    while rows:
        due = (F.col("place") >= start + least) & (F.col("norm") < factor * norm)
        if most:
            due |= F.col("place") == start + max(least, most)
        row = ranked.where((F.col("place") > start) & due).agg(F.min(F.struct("place", "norm")).alias("s")).first().s
        if row is None:
            break
        start, norm = row.place, row.norm
        starts.append(start)
    bounds = probes.sparkSession.createDataFrame(list(zip(range(len(starts)), starts, [*starts[1:], rows])), "bucket long, lo long, hi long")
    return ranked.join(F.broadcast(bounds), (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi"))).select("id", "norm", "bucket")


def bucket_stats(bucketed: DataFrame) -> DataFrame:
    """(bucket, probes, longest, shortest)."""
    return bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("probes"), F.max("norm").alias("longest"), F.min("norm").alias("shortest"))


def active_buckets(stats: DataFrame, longest_query: float, theta: float) -> DataFrame:
    """Buckets that some query can still reach theta in."""
    return stats.where(F.col("longest") * longest_query * (1 + 1e-12) >= theta)


def blocks(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """df with block 0..n-1: even consecutive blocks in key order, the first ones larger."""
    out = numbered(df, key, name="place")
    small, larger = divmod(df.count(), n)
    place = F.col("place")
    even = F.floor((place - larger * (small + 1)) / small) + larger if small else F.lit(0)
    return out.withColumn("block", F.when(place < larger * (small + 1), F.floor(place / (small + 1))).otherwise(even).cast("long")).drop("place")
