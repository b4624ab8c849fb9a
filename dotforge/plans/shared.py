"""The shared folder of the cluster: fresh paths, tables that cut lineage, and numbering in order by way of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that the whole cluster shares.

    The cluster names it in spark.checkpoint.dir.  Only a local master, where that is
    unset (tests on one machine), gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(spark, "_dotforge_scratch", None)
        if base is None:
            base = spark._dotforge_scratch = f"file://{tempfile.mkdtemp(prefix='spark-dotforge-')}"
    return f"{base.rstrip('/')}/dotforge-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage: written once to the shared folder, then read from there."""
    spark = df.sparkSession
    path = scratch(spark)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def numbered(df: DataFrame, *order: str | Column, name: str = "n", parts: int | None = None) -> DataFrame:
    """df with its place, from 0, in an order over all rows; rows that tie are numbered in any order.

    Rows are cut into ranges, counted range by range, and numbered inside their range
    beyond the rows of the ranges before it: no task holds more than a range, and only
    one row a range is ordered in one place.
    """
    part, place, ahead = (f"{name}_{x}" for x in ("part", "place", "ahead"))
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions(*order)
    low = F.monotonically_increasing_id()
    rows = materialize(dealt.select("*", F.spark_partition_id().alias(part), low.bitwiseAND(F.lit((1 << 33) - 1)).alias(place)))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("c")).select(part, F.coalesce(F.sum("c").over(before), F.lit(0)).alias(ahead))
    return rows.join(F.broadcast(sizes), part).withColumn(name, F.col(ahead) + F.col(place)).drop(part, place, ahead)
