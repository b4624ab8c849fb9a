"""Above-theta and row-top-k joins on the inner product, with interchangeable methods.

Vectors are (id BIGINT, vec ARRAY<DOUBLE>).  above_theta returns (query_id, probe_id,
score) with score >= theta; row_top_k returns (query_id, probe_id, score, rank), the k
best probes of each query, ties by the smaller probe id, and min(k, n) rows if there
are fewer probes.  Every method turns into the same plan: probes are cut into norm
buckets, a small table of bucket bounds pairs each query with the buckets that can
still reach its bound, an equi-join brings the probes, the method's filter thins the
candidates, and one shared verification decides.  Exact methods therefore return the
same rows, whatever they prune.

The equi-join is on the bucket, a chunk of at most about BLOCK of its probes and a part of
at most about BLOCK queries, so no task meets more, also where all vectors have one length
and lie in one bucket.  Filter and verification run inside the groups of that join
(kernels.block_join), so candidates are never rows; lc and li read lists over whole buckets.

The bound is theta, or in top-k the k-th best score against the probes of
greatest length (a set of fixed size, a block at most, so every task may have it).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..plans.shared import materialize
from . import covers, kernels, lists, lsh

SLACK = kernels.SLACK
EPS = 1e-9
BUCKET_FACTOR = 0.9
SEEDS = 10  # top-k bounds come from SEEDS * k longest probes at least, which an approximate top k keeps as candidates
SEED_VALUES = 1 << 18  # ... of an exact one from a block of them, as long as it has no more coordinates in all
BLOCK = 4096
EXACT = ("naive", "length", "bucketed", "coord", "incr", "lc", "li", "ta_rr", "ta_max", "tanra_rr", "tanra_max", "tree", "ap", "dense")
APPROXIMATE = ("lsh", "blsh")
COUNTED = ("naive", "length", "bucketed", "tree", "lsh", "blsh")  # methods whose comparisons are counted in a run's figures


def prepare(df: DataFrame, prefix: str, id_col: str = "id", vec_col: str = "vec", width: int | None = None) -> DataFrame:
    """(id, vec) with length and unit vector, under a prefix.

    Vectors that are null or hold a null or NaN coordinate have no products and are left
    out; with width, a vector of another one raises as soon as it is read.
    """
    v = F.col(vec_col).cast("array<double>")
    out = df.select(F.col(id_col).cast("long").alias(f"{prefix}id"), v.alias(f"{prefix}v"))
    out = out.where(F.forall(f"{prefix}v", lambda x: x.isNotNull() & ~F.isnan(x)))
    if width is not None:
        wrong = F.concat(F.lit(f"vectors of different lengths: {width} and "), F.size(f"{prefix}v").cast("string"))
        out = out.withColumn(f"{prefix}v", F.when(F.size(f"{prefix}v") != width, F.raise_error(wrong).cast("array<double>")).otherwise(F.col(f"{prefix}v")))
    return out.withColumn(f"{prefix}n", V.norm(f"{prefix}v")).withColumn(f"{prefix}u", V.unit(f"{prefix}v"))


def prepare_both(queries: DataFrame, probes: DataFrame, check: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """Both sides prepared, and the width that every vector must have, that of any of them; check: look at all now."""
    if check:
        check_dims(queries, probes)
    held = [d.where("vec IS NOT NULL").select(F.size("vec")).first() for d in (probes, queries)]
    width = next((r[0] for r in held if r), 0)
    return prepare(queries, "q", width=width), prepare(probes, "p", width=width), width


def check_dims(q: DataFrame, p: DataFrame, vec_col: str = "vec") -> None:
    """Raises if the vectors of both sides do not all have one length."""
    sizes = {r[0] for d in (q, p) for r in d.where(F.col(vec_col).isNotNull()).select(F.size(vec_col)).distinct().limit(2).collect()}
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(sizes)}")


def log_bucket(n: Column, factor: float = BUCKET_FACTOR) -> Column:
    """Norm bucket in which lengths differ by at most the factor; zero vectors share the lowest."""
    return F.when(n > 0, F.floor(F.log(n) / math.log(1 / factor))).otherwise(F.lit(-(1 << 40))).cast("long")


def with_buckets(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(probes with bucket, one row of bounds per bucket)."""
    p = p.withColumn("bucket", log_bucket(F.col("pn")))
    return p, p.groupBy("bucket").agg(F.max("pn").alias("longest"), F.min("pn").alias("shortest"), F.count(F.lit(1)).alias("probes"))


def pair_buckets(q: DataFrame, stats: DataFrame) -> DataFrame:
    """Queries times the buckets that can still reach their bound, with the local threshold."""
    # a log bucket exists for every tenth of a length: a few hundred rows whatever the input
    out = q.join(F.broadcast(stats), F.col("qn") * F.col("longest") * SLACK >= F.col("bound"))
    span = F.col("qn") * F.when(F.col("bound") > 0, F.col("longest")).otherwise(F.col("shortest"))
    return out.withColumn("local", F.when(span > 0, F.col("bound") / span).otherwise(F.lit(0.0)))


def in_blocks(q: DataFrame, p: DataFrame, stats: DataFrame, queries: int) -> DataFrame:
    """Rows of q (with bucket) joined with the probes of their bucket, block by block; queries: about how many there are."""
    parts = math.ceil(max(1, queries) / BLOCK)
    chunks = F.greatest(F.lit(1), F.ceil(F.col("probes") / BLOCK)).cast("int")
    sized = stats.select("bucket", chunks.alias("chunks"))  # one row a bucket
    left = q.join(sized, "bucket").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    right = p.join(sized, "bucket").withColumn("chunk", F.pmod(F.xxhash64("pid"), F.col("chunks")).cast("int")).drop("chunks")
    keys = ["bucket", "chunk"]
    if parts > 1:
        left = left.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int"))
        right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        keys.append("part")
    return left.join(right, keys).drop("chunk", "part")


def all_pairs(q: DataFrame, p: DataFrame) -> DataFrame:
    """Every query with every probe, block by block."""
    one = lambda d: d.withColumn("bucket", F.lit(0))
    stats = one(p).groupBy("bucket").agg(F.count(F.lit(1)).alias("probes"))
    return in_blocks(one(q), one(p), stats, q.count()).select(*q.columns, *p.columns)


def feasible(qi: Column, t: Column) -> tuple[Column, Column]:
    """Where a coordinate of a unit probe must lie if its cosine with the query is t or more (0 < t <= 1)."""
    half = F.sqrt(F.greatest((1 - t * t) * (1 - qi * qi), F.lit(0.0)))
    lo, hi, pole = t * qi - half, t * qi + half, F.try_divide(t, qi)
    # past the pole of the query's coordinate the region is open towards +1 or -1
    above, below = (qi > 0) & (pole <= hi), (qi < 0) & (pole >= lo)
    return F.when(above, F.least(lo, pole)).when(below, F.lit(-1.0)).otherwise(lo) - EPS, F.when(below, F.greatest(hi, pole)).when(above, F.lit(1.0)).otherwise(hi) + EPS


def candidates(q: DataFrame, p: DataFrame, method: str) -> DataFrame:
    """Joined (q.*, p.*) rows that the lengths (naive: nothing) cannot rule out."""
    if method == "naive":
        return all_pairs(q, p)
    if method not in ("length", "bucketed"):
        raise ValueError(f"unknown method {method!r}")
    p, stats = with_buckets(p)
    joined = in_blocks(pair_buckets(q, stats).drop("probes"), p, stats, q.count())
    return joined.where(F.col("qn") * F.col("pn") * SLACK >= F.col("bound"))


def products(pairs: DataFrame) -> DataFrame:
    """(query_id, probe_id, score) of joined rows."""
    return pairs.select(F.col("qid").alias("query_id"), F.col("pid").alias("probe_id"), V.ip("qv", "pv").alias("score"))


def scored(q: DataFrame, p: DataFrame, method: str, width: int, recall: float = 0.97, k: int | None = None, complete: bool = False, counted: bool = False) -> DataFrame:
    """(query_id, probe_id, score) of the pairs of a method that reach the bound; k: at least the k best of each query."""
    if method in kernels.METHODS:
        held = covers.in_leaves(p) if method == "tree" else p
        return kernels.block_join(q, held, method, k=k, recall=recall, complete=complete, counted=counted)
    if method in lists.METHODS:
        return lists.pairs(q, p, method, width, k)
    raise ValueError(f"unknown method {method!r}")


def above_theta(queries: DataFrame, probes: DataFrame, theta: float, method: str = "dense", recall: float = 0.97, check: bool = False, complete: bool = False) -> DataFrame:
    """(query_id, probe_id, score) of every pair with inner product theta or more.

    complete: pairs that the tables of an approximate method leave out are checked as well, so none is missed.
    """
    q, p, width = prepare_both(queries, probes, check)
    q = q.withColumn("bound", F.lit(float(theta)))
    return scored(q, p, method, width, recall, complete=complete).where(F.col("score") >= theta)


def best(pairs: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query_id, ranked."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "probe_id")
    out = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("query_id", "probe_id", "score", F.col("rank").cast("long").alias("rank"))


def top_k_bounds(q: DataFrame, p: DataFrame, k: int, seeds: int | None = None) -> DataFrame:
    """q with bound: the k-th best score against the seeds * k longest probes (-inf if there are fewer than k).

    Without seeds, a block of probes is taken: the closer the bound, the fewer pairs reach it.
    Those few are sent to every task, which picks the k best by one product and adds these up
    coordinate by coordinate, as the verification does, so a bound is never above the scores that
    it comes from.  The result is written, since the queries are counted, paired with buckets and sent.
    """
    if seeds is None:
        width = p.select(F.size("pv")).first()
        many = max(SEEDS * k, min(kernels.BLOCK, SEED_VALUES // max(1, width[0] if width else 1)))
    else:
        many = seeds * k
    longest = [r.pv for r in p.orderBy(F.desc("pn"), "pid").limit(many).select("pv").collect()]
    if not 0 < k <= len(longest):
        return q.withColumn("bound", F.lit(float("-inf")))
    axes, at = np.array(longest).T, q.columns.index("qv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(axes))
            step, bound = max(1, kernels.PAIRS // axes.shape[1]), np.zeros(batch.num_rows)
            for lo in range(0, len(m), step):
                some = m[lo : lo + step]
                top = np.argpartition(some @ axes, -k, axis=1)[:, -k:]
                score = np.zeros(top.shape)
                for x, y in zip(some.T, axes):
                    score += x[:, None] * y[top]
                bound[lo : lo + step] = score.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound)], [*batch.schema.names, "bound"])

    return materialize(q.mapInArrow(run, T.StructType([*q.schema, T.StructField("bound", T.DoubleType())])))


def relax(bound: Column, qn: Column, approx: str | None, epsilon: float) -> Column:
    """The pruning bound of an approximate top-k: relative, absolute or hybrid error epsilon."""
    if approx in ("rel", "hyb"):
        return F.when(bound >= 0, bound * (1 + epsilon / (1 - epsilon))).otherwise(bound)
    if approx == "abs":
        return bound + epsilon
    return bound


def row_top_k(
    queries: DataFrame, probes: DataFrame, k: int, method: str = "dense", score: str = "ip", recall: float = 0.97,
    approx: str | None = None, epsilon: float = 0.0, depth: int = 5, check: bool = False, complete: bool = False,
) -> DataFrame:
    """(query_id, probe_id, score, rank) of the k best probes of each query.

    score: ip, ip_over_qnorm (divided by the query's length; 0 for zero queries) or, for
    pca_tree, distance.  With approx the seed probes stay candidates, so every query
    still gets its k rows, each at most epsilon short (absolutely, or relative).  complete:
    as in above_theta.
    """
    if method.startswith("tanra"):
        raise ValueError("tanra answers above-theta only")
    q, p, width = prepare_both(queries, probes, check)
    inexact = approx is not None or (method in (*APPROXIMATE, "simple_lsh") and not complete)
    q = top_k_bounds(q, p, k, SEEDS if inexact else None)
    if method in ("simple_lsh", "pca_tree", "pca_hamming"):
        if method != "simple_lsh":
            pairs = (lsh.pca_tree if method == "pca_tree" else lsh.pca_hamming)(q, p, k, depth)
        else:
            pairs = kernels.block_join(q, p, "simple_lsh", k=k, recall=recall, complete=complete)
    else:
        pruned = q.withColumn("bound", relax(F.col("bound"), F.col("qn"), approx, epsilon))
        pairs = scored(pruned, p, "lsh" if approx == "hyb" else method, width, recall, k, complete)
    if inexact:
        longest = p.orderBy(F.desc("pn"), "pid").limit(SEEDS * k)
        pairs = pairs.union(products(q.crossJoin(F.broadcast(longest)))).dropDuplicates(["query_id", "probe_id"])
    out = best(pairs, k)
    if score == "ip_over_qnorm":
        lengths = q.select(F.col("qid").alias("query_id"), "qn")
        out = out.join(lengths, "query_id").withColumn("score", F.coalesce(F.try_divide("score", "qn"), F.lit(0.0))).drop("qn")
    return out


def column_top_k(queries: DataFrame, probes: DataFrame, k: int, **how) -> DataFrame:
    """The k best queries of each probe: the same join with the sides swapped."""
    out = row_top_k(probes, queries, k, **how)
    return out.select(F.col("probe_id").alias("query_id"), F.col("query_id").alias("probe_id"), "score", "rank")
