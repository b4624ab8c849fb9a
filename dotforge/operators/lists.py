"""Inverted lists: candidates are read from sorted coordinate lists, not from pairs.

Every norm bucket has a list of unit values a coordinate, cut into BINS bins of equal width.
A query that can still reach its bound in a bucket has a feasible range on each of its
FOCUS largest coordinates.  How many entries each range holds is looked up in the running
counts of the bins; a query with an empty range is done with the bucket, and otherwise the
ranges are taken narrowest first.  The narrowest meets its entries by an equi-join on
(bucket, coordinate, bin); a probe is a candidate if it lies in all FOCUS ranges, and for
the incremental methods if what the focus coordinates leave over can still reach the bound.

    coord, incr   lists wherever the local threshold lies in (0, 1], block by block inside the
                  kernel's groups (in_ranges), since they may hold most pairs of a bucket
    lc, li        lists over whole buckets, but only where the narrowest range holds less than a SHARE-th of the
                  bucket; elsewhere the block product scans it

Postings are kept only for the bins that some query asks for.  A bin's list is cut into
chunks of at most about joins.BLOCK entries, so no key is as long as a bucket.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.shared import materialize

BINS = 64
FOCUS = 3
SHARE = 4
SMALL = 32 << 20  # bytes of running counts that may be broadcast
METHODS = ("coord", "incr", "lc", "li")
EPS = 1e-9


def bin_of(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((x + 1) * (BINS / 2)))).cast("int")


def running_counts(p: DataFrame) -> DataFrame:
    """(bucket, coord, ends): entries of the list below each bin's start, and all of them."""
    flat = p.select("bucket", F.posexplode("pu").alias("coord", "x")).groupBy("bucket", "coord", bin_of(F.col("x")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    per = flat.groupBy("bucket", "coord").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    n = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))
    grow = F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.array(F.lit(0).cast("long")), lambda a, i: F.array_append(a, F.element_at(a, -1) + n(i)))
    return per.select("bucket", "coord", grow.alias("ends"))


def ranges(active: DataFrame, ends: DataFrame, small: bool) -> DataFrame:
    """Rows of active (query, bucket) with lists: (entries, coord, lo, hi) of each focus coordinate, narrowest first."""
    from .joins import feasible

    per = ends.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("coord", "ends"))).alias("held"))  # width rows a bucket
    active = active.join(F.broadcast(per) if small else per, "bucket")

    def look(s: Column) -> Column:
        lo, hi = feasible(s["val"], F.col("local"))
        at = F.element_at("held", s["coord"])
        entries = F.get(at, bin_of(F.least(hi, F.lit(1.0))) + 1) - F.get(at, bin_of(F.greatest(lo, F.lit(-1.0))))
        return F.struct(F.greatest(F.lit(0), entries).alias("entries"), s["coord"].alias("coord"), lo.alias("lo"), hi.alias("hi"))

    return active.withColumn("lists", F.array_sort(F.transform("top", look))).drop("held")


def within(lists: Column, unit: Column) -> Column:
    """The vector's value lies in every range."""
    return F.forall(lists, lambda s: F.element_at(unit, s["coord"] + 1).between(s["lo"], s["hi"]))


def residual() -> Column:
    """Cauchy-Schwarz on what the focus coordinates leave over."""
    value = lambda v, s: F.element_at(v, s["coord"] + 1)
    part = V.total(F.transform("lists", lambda s: value(F.col("qu"), s) * value(F.col("pu"), s)))
    qq = V.total(F.transform("lists", lambda s: value(F.col("qu"), s) * value(F.col("qu"), s)))
    pp = V.total(F.transform("lists", lambda s: value(F.col("pu"), s) * value(F.col("pu"), s)))
    rest = F.sqrt(F.greatest(1 - pp, F.lit(0.0)) * F.greatest(1 - qq, F.lit(0.0)))
    size = F.col("qn") * F.col("pn")
    return size * (part + rest) >= F.col("bound") - 1e-9 * (1 + F.abs("bound") + size)


def feasible(qi: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """joins.feasible() of arrays."""
    half = np.sqrt(np.maximum((1 - t * t) * (1 - qi * qi), 0))
    lo, hi = t * qi - half, t * qi + half
    pole = np.divide(t, qi, out=np.full(qi.shape, np.nan), where=qi != 0)
    above, below = (qi > 0) & (pole <= hi), (qi < 0) & (pole >= lo)
    low = np.where(above, np.minimum(lo, pole), np.where(below, -1.0, lo))
    return low - EPS, np.where(below, np.maximum(hi, pole), np.where(above, 1.0, hi)) + EPS


def in_ranges(g, incremental: bool) -> Callable[[slice], np.ndarray]:
    """For some queries of a kernels.Group: which probes lie in the feasible ranges of their FOCUS largest coordinates.

    The narrowest range's entries are read from its sorted list and looked up in the others.
    incremental: and what the focus coordinates leave over can still reach the bound.
    Queries without a positive local threshold scan what the lengths allow.
    """
    whole = lambda m, n: np.divide(m, n[:, None], out=np.zeros(m.shape), where=n[:, None] > 0)
    qu, pu = whole(g.q, g.qn), whole(g.p, g.pn)
    order = np.argsort(pu, axis=0, kind="stable")
    values, axes = np.take_along_axis(pu, order, axis=0), np.ascontiguousarray(pu.T)

    def look(at: slice) -> np.ndarray:
        t, u = g.local[at], qu[at]
        top = np.argsort(-np.abs(u), axis=1, kind="stable")[:, :FOCUS]
        x = np.take_along_axis(u, top, axis=1)
        able = (t > 0) & (t <= 1)
        lo, hi = feasible(x, np.where(able, t, 1.0)[:, None])
        start, end = np.zeros(top.shape, int), np.zeros(top.shape, int)
        for c in np.unique(top):
            here = top == c
            start[here], end[here] = np.searchsorted(values[:, c], lo[here], "left"), np.searchsorted(values[:, c], hi[here], "right")
        found = np.zeros((len(u), len(pu)), bool)
        for i in np.flatnonzero(able & (end > start).all(1)):
            first, *others = np.argsort(end[i] - start[i], kind="stable")
            rows = order[start[i, first] : end[i, first], top[i, first]]
            for b in others:
                v = axes[top[i, b]][rows]
                rows = rows[(v >= lo[i, b]) & (v <= hi[i, b])]
            if incremental:
                part, pp = 0.0, 0.0
                for b in range(top.shape[1]):
                    v = axes[top[i, b]][rows]
                    part, pp = part + x[i, b] * v, pp + v * v
                rest = np.sqrt(np.maximum(1 - pp, 0) * max(1 - (x[i] * x[i]).sum(), 0))
                size = g.qn[at][i] * g.pn[rows]
                bound = g.bound[at][i]
                rows = rows[size * (part + rest) >= bound - 1e-9 * (1 + abs(bound) + size)]
            found[i, rows] = True
        found[~able] = True
        return found & g.by_length(at)

    return look


def plan(q: DataFrame, p: DataFrame, method: str, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(q.*, p.* of the list candidates, queries left to a scan by bucket, probes with bucket)."""
    from . import joins

    spark = q.sparkSession
    p, stats = joins.with_buckets(p)
    per_bucket = stats.collect()  # a row a norm bucket
    stats = spark.createDataFrame(per_bucket, stats.schema)
    small = len(per_bucket) * width * (BINS + 1) * 8 <= SMALL
    slim = q.select("qid", "qn", "bound", V.top_coords("qu", FOCUS).alias("top"))
    active = joins.pair_buckets(slim, stats).select("qid", "bucket", "probes", "local", "bound", "top")
    # written, since every later step looks at the ranges again
    seen = materialize(ranges(active, running_counts(p), small).drop("top"))
    able = (F.col("local") > 0) & (F.col("local") <= 1)
    # an empty range rules the bucket out
    listed = seen.where(able & F.forall("lists", lambda s: s["entries"] > 0))
    scan = seen.where(~able).select("qid", "bucket")
    wide = F.col("lists")[0]["entries"] * SHARE >= F.col("probes")
    scan = scan.union(listed.where(wide).select("qid", "bucket"))
    listed = listed.where(~wide)
    chunks = F.broadcast(stats.select("bucket", F.greatest(F.lit(1), F.ceil(F.col("probes") / joins.BLOCK)).cast("int").alias("chunks")))
    first = F.col("lists")[0]
    span = F.sequence(bin_of(F.greatest(first["lo"], F.lit(-1.0))), bin_of(F.least(first["hi"], F.lit(1.0))))
    asked = listed.select("qid", "bucket", "lists", first["coord"].alias("coord"), F.explode(span).alias("bin"))
    wanted = asked.select("bucket", "coord", "bin").distinct()
    flat = p.select("bucket", "pid", F.posexplode("pu").alias("coord", "x")).withColumn("bin", bin_of(F.col("x")))
    flat = flat.join(F.broadcast(wanted) if small else wanted, ["bucket", "coord", "bin"], "left_semi")
    flat = flat.join(chunks, "bucket").withColumn("chunk", F.pmod(F.xxhash64("pid"), F.col("chunks")).cast("int")).drop("chunks")
    asked = asked.join(chunks, "bucket").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    met = asked.join(flat, ["bucket", "coord", "bin", "chunk"]).where(F.col("x").between(F.col("lists")[0]["lo"], F.col("lists")[0]["hi"]))
    found = met.select("qid", "pid", "lists").join(p.drop("bucket"), "pid").where(within(F.col("lists"), F.col("pu")))
    found = found.join(q, "qid").where(F.col("qn") * F.col("pn") * joins.SLACK >= F.col("bound"))
    if method == "li":
        found = found.where(residual())
    return found, scan, p


def pairs(q: DataFrame, p: DataFrame, method: str, width: int, k: int | None = None) -> DataFrame:
    """(query_id, probe_id, score) of pairs whose score reaches the query's bound; k: at least the k best of each query."""
    from . import kernels

    found, scan, _ = plan(q, p, method, width)
    out = found.select(F.col("qid").alias("query_id"), F.col("pid").alias("probe_id"), V.ip("qv", "pv").alias("score"), "bound")
    return out.where(F.col("score") >= F.col("bound")).drop("bound").union(kernels.block_join(q, p, "dense", only=scan, k=k))


def comparisons(q: DataFrame, p: DataFrame, method: str, width: int) -> DataFrame:
    """(comparisons): pairs whose product the method works out."""
    from . import joins, kernels

    if method in kernels.METHODS:
        return kernels.block_join(q, p, method, counted=True).agg(F.coalesce(F.sum("compared"), F.lit(0)).cast("long").alias("comparisons"))
    found, scan, held = plan(q, p, method, width)
    stats = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("probes"))
    scanned = joins.in_blocks(q.join(scan, "qid"), held, stats, 1).where(F.col("qn") * F.col("pn") * joins.SLACK >= F.col("bound"))
    parts = [found.agg(F.count(F.lit(1)).alias("n")), scanned.agg(F.count(F.lit(1)).alias("n"))]
    return reduce(DataFrame.union, parts).agg(F.sum("n").alias("comparisons"))
