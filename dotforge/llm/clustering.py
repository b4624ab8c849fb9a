"""Centroid clustering of quantised vectors, each distinct one once with its multiplicity.

Method.  Components become integers (SCALE steps a unit, floored).  Identical vectors are
grouped with their multiplicity; Lloyd's rounds assign the distinct vectors to the nearest
centroid and move every centroid to the floored mean of its vectors, from integer sums
weighted by multiplicity.  The assignments are joined back to the ids at the end.  All
arithmetic is exact, so neither the order of rows nor their partitioning matters.

Scale.  Grouping combines equal vectors before the shuffle.  A round reads the written
table of distinct vectors once and sends one row of sums a task, centroid and coordinate;
the driver holds the centroids, CENTROIDS vectors, and nothing that grows.  Digests meet
their assignment by spread_join, so a vector of a third of all rows stays spread.

Defined results: vectors that are null, of another width, or hold a null, NaN or infinite
component are left out; components beyond the range of a long count as its end; with fewer
vectors than CENTROIDS each starts a centroid; equal ids start in the order of their
vectors, a null id counts as an empty string; equal vectors share a cluster; a distance or
an inertia beyond a long is null; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread_join

WIDTH = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
SEED = 1
LONG = 1 << 63


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", width: int = WIDTH) -> DataFrame:
    """(vec_id, q) of the vectors kept, q of whole numbers."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    whole = (F.size("v") == width) & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(whole)
    return kept.select("vec_id", F.transform("v", lambda x: F.floor(x * SCALE)).alias("q"))


def _size(*parts: np.ndarray) -> int:
    return max((max(int(p.max()), -int(p.min())) for p in parts if p.size), default=0)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of every row, exact; ties go to the smaller number."""
    if 4 * q.shape[1] * _size(q, centroids) ** 2 < 1 << 53:  # every term and sum is a whole number that a double holds
        a, c = q.astype(np.float64), centroids.astype(np.float64)
        d = ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    else:
        a, c = q.astype(object), centroids.astype(object)
        d = np.stack([((a - row) ** 2).sum(1) for row in c], axis=1)
    best = d.argmin(1)
    return best, d[np.arange(len(d)), best]


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    q = batch.column(batch.schema.get_field_index("q"))
    return q.flatten().to_numpy().reshape(len(q), -1), batch.column(batch.schema.get_field_index("copies")).to_numpy()


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; empty ones stay."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, width), object), np.zeros(k, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            q, copies = _rows(batch)
            if _size(q) * int(copies.sum()) >= LONG:
                q = q.astype(object)
            cluster, _ = nearest(q, centroids)
            for c in np.unique(cluster):
                own = cluster == c
                total[c] += (q[own] * copies[own, None]).sum(0).astype(object)
                count[c] += int(copies[own].sum())
        c, at = np.nonzero(np.repeat(count != 0, width).reshape(k, width))
        exact = pa.array([Decimal(int(x)) for x in total[c, at]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(at.astype(np.int32)), exact, pa.array(count[c].astype(np.int64))], ["cluster", "coord", "total", "n"])

    sums = distinct.mapInArrow(run, "cluster int, coord int, total decimal(38,0), n long").groupBy("cluster", "coord").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():  # CENTROIDS * width rows at most
        out[r.cluster, r.coord] = int(r.total) // r.n
    return out


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(digest, copies, cluster, distance) of the distinct vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance = nearest(_rows(batch)[0], centroids)
                exact = pa.array([int(x) if x < LONG else None for x in distance], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), exact], ["digest", "copies", "cluster", "distance"])

    return distinct.select("digest", "copies", "q").mapInArrow(run, "digest binary, copies long, cluster int, distance long")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", width: int = WIDTH, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector kept, the final centroids)."""
    spark = vectors.sparkSession
    kept = quantised(vectors, id_col, vec_col, width)
    key = F.unhex(F.sha2(F.array_join(F.transform("q", lambda x: x.cast("string")), ","), 256)).alias("digest")
    members = materialize(kept.select("vec_id", key))
    distinct = materialize(kept.groupBy("q").agg(F.count(F.lit(1)).alias("copies")).select(key, "copies", "q"))
    start = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(start, "q").limit(k).collect()
    centroids = np.array([r.q for r in first], np.int64).reshape(len(first), width)
    for _ in range(rounds if first else 0):
        centroids = moved(distinct, centroids)
    found = materialize(assigned(distinct, centroids))
    part = F.col("distance").cast("decimal(19,0)") * F.col("copies").cast("decimal(19,0)")
    whole = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(part))  # null as soon as one distance is
    total = found.agg(whole.alias("s")).first().s
    per = found.groupBy("cluster").agg(whole.try_cast("long").alias("cluster_inertia"))
    shas = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(shas, "cluster int, centroid_sha256 string")
    per = per.join(F.broadcast(named), "cluster")
    total = int(total) if total is not None and total < LONG else None
    out = spread_join(members, found.select("digest", "cluster", "distance"), "digest").join(F.broadcast(per), "cluster")  # k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256"), centroids
