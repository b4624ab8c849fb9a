"""Linear algebra over (id, vec): centring, covariance, whitening and related transforms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .lsh import principal_axes, rotated


def entries(df: DataFrame) -> DataFrame:
    return df.select("id", F.posexplode("vec").alias("coord", "val"))


def means(df: DataFrame) -> DataFrame:
    """(coord, mean)."""
    return entries(df).groupBy("coord").agg(F.avg("val").alias("mean"))


def center(df: DataFrame) -> DataFrame:
    """Vectors minus their mean; the mean is one value per coordinate and is broadcast."""
    mean = means(df).agg(F.transform(F.array_sort(F.collect_list(F.struct("coord", "mean"))), lambda s: s["mean"]).alias("m"))
    return df.crossJoin(F.broadcast(mean)).select("id", F.zip_with("vec", "m", lambda x, m: x - m).alias("vec"))


def _gram(df: DataFrame, x: str, y: str) -> DataFrame:
    """(i, j, n, sx, sy, sxy): sums of both vectors' coordinates and of their products, one matrix a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                a, b = (c.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in batch.columns)
                part = np.hstack([np.ones((len(a), 1)), a]).T @ np.hstack([np.ones((len(b), 1)), b])
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total[1:, 1:].shape)
            cols = [i.ravel().astype(np.int32), j.ravel().astype(np.int32), np.full(i.size, total[0, 0]), total[1:, 0][i].ravel(), total[0, 1:][j].ravel(), total[1:, 1:].ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["i", "j", "n", "sx", "sy", "sxy"])

    sums = df.select(F.col(x).cast("array<double>"), F.col(y).cast("array<double>").alias("other")).mapInArrow(run, "i int, j int, n double, sx double, sy double, sxy double")
    return sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy")])


def _cov(sums: DataFrame, sample: bool) -> DataFrame:
    return sums.select("i", "j", F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.col("n") - int(sample)).alias("cov"))


def covariance(df: DataFrame, sample: bool = True) -> DataFrame:
    """(i, j, cov) of coordinates i <= j, from one matrix of products a task."""
    return _cov(_gram(df, "vec", "vec").where("i <= j"), sample)


def cross_covariance(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, cov) between the coordinates of two tables of vectors with common ids."""
    return _cov(_gram(a.join(b.select("id", F.col("vec").alias("other")), "id"), "vec", "other"), True)


def power(df: DataFrame, exponent: float) -> DataFrame:
    """Vectors with every coordinate raised to a power, its sign kept."""
    return df.select("id", F.transform("vec", lambda x: F.signum(x) * F.power(F.abs(x), F.lit(float(exponent)))).alias("vec"))


def coordinate_maxima(df: DataFrame) -> DataFrame:
    """(coord, top): the greatest absolute value of each coordinate."""
    return entries(df).groupBy("coord").agg(F.max(F.abs("val")).alias("top"))


def whiten(df: DataFrame) -> DataFrame:
    """Vectors along their principal axes at variance 1 (axes of variance 0 stay 0)."""
    width = df.select(F.size("vec")).first()[0]
    mean, axes = principal_axes(df, "vec", width)
    turned = rotated(df.select("id", F.col("vec").cast("array<double>").alias("t")), "id", mean, axes).withColumnRenamed("x", "vec")
    spread = entries(turned).groupBy("coord").agg(F.stddev_pop("val").alias("s")).agg(F.transform(F.array_sort(F.collect_list(F.struct("coord", "s"))), lambda s: s["s"]).alias("s"))
    return turned.crossJoin(F.broadcast(spread)).select("id", F.zip_with("vec", "s", lambda x, s: F.when(s > 1e-12, x / s).otherwise(0.0)).alias("vec"))


def orthogonalize(m: np.ndarray) -> np.ndarray:
    """Nearest orthogonal matrix of a small square matrix."""
    u, _, v = np.linalg.svd(m)
    return u @ v


def random_unit(width: int, seed: int = 0) -> np.ndarray:
    v = np.random.default_rng(seed).standard_normal(width)
    return v / np.linalg.norm(v)


def random_vectors(spark, n: int, width: int, seed: int = 0) -> DataFrame:
    """(id, vec) of values in [0, 1) that depend on (seed, id, coordinate) only."""
    value = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(1 << 40)).cast("double") / float(1 << 40)
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(width)), value).alias("vec"))


def remove_rows(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_anti")


def ball_bound(df: DataFrame) -> DataFrame:
    """(centre, radius): the mean of the vectors and the largest distance to it."""
    mean = means(df).agg(F.transform(F.array_sort(F.collect_list(F.struct("coord", "mean"))), lambda s: s["mean"]).alias("centre"))
    far = df.crossJoin(F.broadcast(mean)).agg(F.max(V.l2("vec", "centre")).alias("radius"))
    return mean.crossJoin(far)


def rect_bound(df: DataFrame) -> DataFrame:
    """(coord, lo, hi) of the smallest box around the vectors."""
    return entries(df).groupBy("coord").agg(F.min("val").alias("lo"), F.max("val").alias("hi"))


def group_bounds(df: DataFrame, by: str) -> DataFrame:
    """(by, centre, radius, lo, hi): the ball around the mean and the box of each group of vectors."""
    per = df.select(by, F.posexplode("vec").alias("coord", "x")).groupBy(by, "coord").agg(F.avg("x").alias("centre"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    side = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("coord", c))), lambda s: s[c]).alias(c)
    per = per.groupBy(by).agg(side("centre"), side("lo"), side("hi"))  # one row a coordinate
    far = df.join(per.select(by, "centre"), by).groupBy(by).agg(F.max(V.l2("vec", "centre")).alias("radius"))
    return per.join(far, by).select(by, "centre", "radius", "lo", "hi")


def group_distances(bounds: DataFrame, by: str, pairs: DataFrame, period: Column | None = None) -> DataFrame:
    """pairs (a, b) of groups with the least and greatest distances of their balls and boxes, and the size of what holds both.

    With a period, boxes are measured the shortest way round.
    """
    side = lambda n: bounds.select(F.col(by).alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("centre", "radius", "lo", "hi")])
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    ball = (F.col("a_centre"), F.col("a_radius"), F.col("b_centre"), F.col("b_radius"))
    box = ("a_lo", "a_hi", "b_lo", "b_hi")
    near, far = (V.boxes_min_distance(*box), V.boxes_max_distance(*box)) if period is None else (V.periodic_boxes_min_distance(*box, period), V.periodic_boxes_max_distance(*box, period))
    whole = V.box_union(*box)
    return met.select(
        "a", "b", V.balls_min_distance(*ball).alias("ball_near"), V.balls_max_distance(*ball).alias("ball_far"), V.ball_union(*ball)["radius"].alias("ball_union"),
        near.alias("box_near"), far.alias("box_far"), V.l2(whole["lo"], whole["hi"]).alias("box_union"),
    )
