"""Bounded labelled samples and small numpy training helpers shared by the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod


LONGEST = 1 << 18  # bytes of the longest text that the driver learns from


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> tuple[DataFrame, dict[int, int]]:
    """((doc_id, y, text), training labels of each kind) of at most `most` training rows, half of them of the rarer label if there are enough.

    Ids whose crc32 modulo `folds` is `held_out` are never used.  The choice follows a
    hash of the id, so it is the same in every run and at every partitioning; `most` ids,
    one text each (the smallest of an id's texts, combined on the map side) of at most
    LONGEST bytes, bound what training holds.  Several labels of one id count as their largest.
    """
    spark = docs.sparkSession
    lab = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_mod("doc_id", folds) != held_out))
    lab = lab.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    counts = {r.y: r.n for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {y: min(counts.get(y, 0), max(most // 2, most - counts.get(1 - y, 0))) for y in (0, 1)}
    rows = []
    for y in (0, 1):
        rows += lab.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(share[y]).collect()
    picks = spark.createDataFrame(rows, "doc_id long, y int") if rows else spark.createDataFrame([], "doc_id long, y int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= LONGEST)
    return texts.join(F.broadcast(picks), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), counts


def in_order(got: pa.Table, counts: dict[int, int]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(texts, labels, weights) of labelled rows by id; weights restore the share of each label among all training labels."""
    got = got.sort_by([("doc_id", "ascending")])
    y = got["y"].to_numpy().astype(np.float32)
    weight = np.ones(len(y), np.float32)
    total = sum(counts.values()) or 1
    for v in (0, 1):
        of = y == v
        if of.any():
            weight[of] = counts.get(v, 0) / total / of.mean()
    return got["text"].combine_chunks() if len(y) else pa.array([], pa.string()), y, weight


def labelled_sample(*how) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """in_order() of labelled_rows(), on the driver."""
    rows, counts = labelled_rows(*how)
    return in_order(rows.toArrow(), counts)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Adam:
    """Adam over a dict of arrays; a gradient (rows, values) moves those rows of its array only."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, slow: dict[str, float] | None = None):
        self.params, self.rate, self.t, self.slow = params, rate, 0, slow or {}
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]]) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            m = self.m[k][at] * np.float32(0.9) + np.float32(0.1) * g
            v = self.v[k][at] * np.float32(0.999) + np.float32(0.001) * g * g
            self.m[k][at], self.v[k][at] = m, v
            self.params[k][at] -= (rate * self.slow.get(k, 1) * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def by_row(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sum of the values of each row)."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    head = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
    return index[head], np.add.reduceat(values[order], head, axis=0)
