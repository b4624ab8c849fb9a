"""Accuracy of result tables (query_id, probe_id, score[, rank]) against exact ones."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(recall): hits among the found rows, of the found rows."""
    keys = ["query_id", "probe_id"]
    hits = exact.select(*keys, F.lit(1).alias("hit"))
    out = found.select(*keys).join(hits, keys, "left")
    return out.agg(F.coalesce(F.try_divide(F.count("hit"), F.count(F.lit(1))), F.lit(1.0)).alias("recall"))


def recall_at_k(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(recall): hits of (queries * k)."""
    keys = ["query_id", "probe_id"]
    whole = exact.agg((F.countDistinct("query_id") * k).alias("whole"))
    hits = found.select(*keys).join(exact.select(*keys), keys, "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    return hits.crossJoin(whole).select(F.coalesce(F.try_divide("hits", "whole"), F.lit(1.0)).alias("recall"))


def _by_rank(exact: DataFrame, found: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "probe_id")
    side = lambda d, n: d.select("query_id", F.col("score").alias(n), F.row_number().over(w).alias("r"))
    return side(exact, "e").join(side(found, "f"), ["query_id", "r"]).withColumn("d", F.col("e") - F.col("f"))


def errors(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(rmse, max_abs, are, max_rel) of scores of equal rank: means over queries, and largest values."""
    rel = F.abs(F.try_divide("d", "e"))
    per = _by_rank(exact, found).groupBy("query_id").agg(
        F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.max(F.abs("d")).alias("max_abs"), F.avg(rel).alias("are"), F.max(rel).alias("max_rel")
    )
    return per.agg(F.avg("rmse").alias("rmse"), F.max("max_abs").alias("max_abs"), F.avg("are").alias("are"), F.max("max_rel").alias("max_rel"))


def relative_error_estimate(found: DataFrame, k: int, epsilon: float) -> DataFrame:
    """(error): mean over queries and ranks of what a relative top-k may miss.

    Pruning kept away only what is below the margin, the k-th score times 1 + epsilon: a
    score below it may fall short of the margin, one that reaches it is right.
    """
    own = Window.partitionBy("query_id")
    held = found.withColumn("margin", F.min("score").over(own) * (1 + epsilon))
    short = F.when(F.col("score") < F.col("margin"), 1 - F.try_divide("score", "margin")).otherwise(0.0)
    per = held.groupBy("query_id").agg((F.sum(short) / k).alias("e"))
    return per.agg(F.avg("e").alias("error"))


def hybrid_error_estimate(found: DataFrame, k: int, next_length: Column, recall: float) -> DataFrame:
    """(error): mean over queries and ranks of what a hybrid top-k may miss; next_length: the bound of what was not looked at.

    A score that reaches the bound can only be missing by the recall; one below it may fall short by as much as it is below.
    """
    short = F.when(F.col("score") >= next_length, F.lit(1 - recall)).otherwise(1 - F.try_divide("score", next_length))
    per = found.groupBy("query_id").agg((F.sum(short) / k).alias("e"))
    return per.agg(F.avg("e").alias("error"))


def comparisons(candidates: DataFrame) -> DataFrame:
    """(comparisons): candidate pairs that a method verifies."""
    return candidates.agg(F.count(F.lit(1)).alias("comparisons"))


def run_log(queries: DataFrame, probes: DataFrame, bound: float | int, method: str, write: Callable[[DataFrame], None]) -> DataFrame:
    """One row of figures of a run whose result goes to write(): above theta for a float, the row top k for an int.

    (algorithm, probes, width, queries, bound, results, comparisons, seconds).  Results and
    comparisons are counted while the run makes them, so nothing is worked out twice; methods
    that are not in joins.COUNTED have no comparisons of their own (null).
    """
    from . import joins

    seen = {"results": Observation(), "comparisons": Observation()}
    rows = lambda df, n, what: df.observe(seen[n], what.alias("n"))
    began = time.perf_counter()
    q, p, width = joins.prepare_both(queries, probes)
    if isinstance(bound, float):
        q = q.withColumn("bound", F.lit(bound))
    else:
        q = joins.top_k_bounds(q, p, bound)
    met = joins.scored(q, p, method, width, counted=method in joins.COUNTED, k=None if isinstance(bound, float) else bound)
    if method in joins.COUNTED:
        met = rows(met, "comparisons", F.coalesce(F.sum("compared"), F.lit(0))).where("compared IS NULL").drop("compared")
    out = met.where(F.col("score") >= bound).select("query_id", "probe_id", "score") if isinstance(bound, float) else joins.best(met, bound)
    write(rows(out, "results", F.count(F.lit(1))))
    took = time.perf_counter() - began
    figures = {n: o.get["n"] for n, o in seen.items() if n == "results" or method in joins.COUNTED}
    row = (method, probes.count(), width, queries.count(), float(bound), figures["results"], figures.get("comparisons"), took)
    return queries.sparkSession.createDataFrame([row], "algorithm string, probes long, width int, queries long, bound double, results long, comparisons long, seconds double")


def write_log(log: DataFrame, path: str) -> None:
    """Appends the figures of runs as tab-separated lines."""
    log.write.mode("append").csv(path, sep="\t")
