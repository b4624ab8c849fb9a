"""Block joins whose inner step is a small numpy kernel.

Queries and probes are cut into blocks of some BLOCK rows; a probe block (a chunk
of a norm bucket, or of another kind of bucket) meets each query block in one task-side
group, and only queries that can reach their bound in the block's bucket are sent, in as many
blocks as those queries take.  Where there are more than LEAST groups, blocks grow up to GROW times
as large, since what is sent falls as they grow.  Group sizes are bounded, so neither side is ever
broadcast or collected.

Inside a group some queries at a time, PAIRS pairs with all its probes, go through the
method, which says which pairs it looks up; these are multiplied and verified, and for a
top k only the k best of the group leave it.  So a task holds one group and PAIRS pairs,
whatever the tables' size or the bounds, and sorts GROUPS groups of BLOCK rows on average, or
as many rows of larger ones: there are as many tasks as that takes.  So it is with the k best of
all groups, which go by query to as many tasks as KEPT rows each take.

    naive, dense       all pairs of the group
    length, bucketed   pairs whose lengths reach the bound
    ta_*, tanra_*      what the threshold algorithms have seen when they stop; a query whose
                       lists would be read for as many entries as there are probes scans them
    ap                 prefix()
    coord, incr        lists.in_ranges()
    tree               covers.within_reach()
    lsh, blsh          lsh.meets()
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .covers import within_reach
from .lists import in_ranges
from .lsh import match_table, meets

SLACK = 1 + 1e-12
BLOCK = 4096
PAIRS = 1 << 20  # pairs looked at together
GROUPS = 1  # groups of BLOCK rows a side that a task has on average
KEPT = 1 << 19  # rows of the groups' k best that a task picks from, at most on average
GROW = 4  # a block has up to so many times BLOCK rows ...
LEAST = 128  # ... as long as there are so many groups
METHODS = ("naive", "length", "bucketed", "dense", "ta_rr", "ta_max", "tanra_rr", "tanra_max", "ap", "coord", "incr", "tree", "lsh", "blsh")
STAGE = 8  # coordinates between two bounds on partial sums
FEW = 0.1  # share of pairs from which on they are followed one by one
DEPTH = 16  # list entries that one step of the threshold algorithms reads
HALVINGS = 10  # steps in which the greedy one finds its level
TOL = 1e-9


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    if not len(flat):
        return np.zeros((0, 0))
    sizes = np.diff(flat.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of different lengths")
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def slack(x: np.ndarray) -> np.ndarray:
    """What a bound is lowered by, so that rounding loses no pair."""
    return TOL * (1 + np.abs(np.where(np.isfinite(x), x, 0)))


class Lists:
    """Per coordinate, the probes sorted by value, read from the end that the query's sign favours."""

    def __init__(self, p: np.ndarray):
        self.p, self.order = p, np.argsort(p, axis=0, kind="stable")
        self.values = np.take_along_axis(p, self.order, axis=0)

    def edges(self, q: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """What the first entry that is not read yet adds to each query's product, per coordinate."""
        n, c = len(self.p), np.arange(q.shape[1])
        at = np.minimum(depth, n - 1)
        return q * self.values[np.where(q >= 0, n - 1 - at, at), c]

    def read(self, q: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The probes among the first depth[i] entries of each list."""
        n = len(self.p)
        held = [self.order[n - d :, i] if q[i] >= 0 else self.order[:d, i] for i, d in enumerate(depth) if d]
        return np.unique(np.concatenate(held)) if held else np.zeros(0, int)


def round_robin(q: np.ndarray, lists: Lists, need: np.ndarray) -> np.ndarray:
    """Entries that each query reads of each list, DEPTH at a time from all of them, until unseen probes miss the bound."""
    n = len(lists.p)
    steps = np.arange(0, n + DEPTH, DEPTH)
    at = np.minimum(steps, n - 1)
    ahead = np.maximum(q, 0) @ lists.values[n - 1 - at].T + np.minimum(q, 0) @ lists.values[at].T
    stop = ahead < need[:, None]
    first = np.where(stop.any(1), stop.argmax(1), len(steps) - 1)
    return np.where(q != 0, np.minimum(steps[first], n)[:, None], 0)


def greedy(q: np.ndarray, lists: Lists, need: np.ndarray) -> np.ndarray:
    """Entries that each query reads of each list if it always reads on where the next entry adds most.

    Then all lists are read down to one level of what their entries add; the highest level at
    which unseen probes miss the bound is found by halving.
    """
    n = len(lists.p)
    low, high = (lists.edges(q, np.full(q.shape, d)) for d in (n - 1, 0))
    low, high = low.min(1), high.max(1) + TOL
    best = np.where(q != 0, n, 0)

    def down_to(level: np.ndarray) -> np.ndarray:
        depth = np.zeros(q.shape, int)
        for i in range(q.shape[1]):
            up, down = q[:, i] > 0, q[:, i] < 0
            depth[up, i] = n - np.searchsorted(lists.values[:, i], level[up] / q[up, i], "right")
            depth[down, i] = np.searchsorted(lists.values[:, i], level[down] / q[down, i], "left")
        return np.minimum(-(-depth // DEPTH) * DEPTH, n)

    open_, all_ = np.arange(len(q)), q
    for _ in range(HALVINGS):
        level = (low + high) / 2
        depth = down_to(level)
        stops = lists.edges(q, depth).sum(1) < need
        best[open_[stops]] = depth[stops]
        low, high = np.where(stops, level, low), np.where(stops, high, level)
        # a query that reads as much as a scan and does not stop there has to read on, which threshold() leaves to the scan
        going = stops | (depth.sum(1) < n)
        open_, low, high, need = open_[going], low[going], high[going], need[going]
        q = all_[open_]
        if not len(q):
            break
    return best


def threshold(q: np.ndarray, lists: Lists, bound: np.ndarray, most: bool, full: bool) -> np.ndarray:
    """Which pairs the threshold algorithms look up (queries by probes).

    Lists are read round robin or (most) greedily until unseen probes cannot reach the bound.
    full: seen probes are looked up at once; else only read values count, and a seen probe stays
    while its best possible score reaches the bound: a value that is not read is at most the edge.
    """
    n = len(lists.p)
    need = bound - slack(bound)
    depth = (greedy if most else round_robin)(q, lists, need)
    found = np.zeros((len(q), n), bool)
    far = (depth.sum(1) >= n) | ~np.isfinite(need) | ~(q != 0).any(1)
    found[far] = True  # a scan reads no more than the lists would
    edge = None if full else lists.edges(q, depth)
    for i in np.flatnonzero(~far):
        rows = lists.read(q[i], depth[i])
        if not full:
            rows = rows[np.maximum(q[i] * lists.p[rows], edge[i]).sum(1) >= need[i]]
        found[i, rows] = True
    return found


def prefix(q: np.ndarray, p: np.ndarray, bound: np.ndarray):
    """Pairs that may reach the bound, by postings of the probes' tails and bounds on partial sums.

    Coordinates are ordered by how many probes hold them.  A probe's head, the first
    coordinates that alone cannot reach the least bound against the longest query, has no
    postings.  Products are summed from the rare end, STAGE coordinates at a time, and a pair
    is dropped once its sum and the lengths of what both sides still hold miss the bound.
    """
    order = np.argsort(-(p != 0).sum(0), kind="stable")
    q, p = q[:, order], p[:, order]
    lead = lambda m: np.sqrt(np.hstack([np.zeros((len(m), 1)), np.cumsum(m * m, axis=1)]))
    qs, ps = lead(q), lead(p)
    slack = TOL * (1 + np.abs(np.where(np.isfinite(bound), bound, 0)))
    need = bound - slack
    skip = (ps[:, 1:] * qs[:, -1].max() < need.min()).sum(1) if need.min() > 0 else np.zeros(len(p), int)
    posted = np.where(np.arange(p.shape[1]) < skip[:, None], 0, p)
    total = np.zeros((len(q), len(p)))
    live = None
    for hi in range(p.shape[1], 0, -STAGE):
        lo = max(0, hi - STAGE)
        end = np.maximum(lo, skip)  # what is not summed yet lies before it
        rest = ps[np.arange(len(p)), end]
        if live is None:
            total += q[:, lo:hi] @ posted[:, lo:hi].T
            held = qs[:, end] if (end > lo).any() else qs[:, lo, None]
            left = held * rest >= need[:, None] - total
            if not lo or left.mean() < FEW:
                live = np.nonzero(left)
                part = total[live]
        else:
            i, j = live
            part = part + np.einsum("nc,nc->n", q[i, lo:hi], posted[j, lo:hi])
            stay = part + qs[i, end[j]] * rest[j] >= need[i]
            live, part = (i[stay], j[stay]), part[stay]
    return live if live is not None else np.nonzero(total >= need[:, None])


class Group:
    """The rows of one group: queries (q, qn, bound, local threshold, longest probe of the bucket) and probes (p, pn, node)."""

    def __init__(self, a: pa.Table, b: pa.Table):
        self.qid, self.pid = a["qid"].to_numpy(), b["pid"].to_numpy()
        self.q, self.p = _matrix(a["qv"]), _matrix(b["pv"])
        self.qn, self.bound, self.local, self.longest = (a[c].to_numpy() for c in ("qn", "bound", "local", "longest"))
        self.pn, self.node = b["pn"].to_numpy(), b["node"].to_numpy()
        self.axes = np.ascontiguousarray(self.q.T), np.ascontiguousarray(self.p.T)  # a coordinate's values lie together

    def by_length(self, at: slice) -> np.ndarray:
        return self.qn[at, None] * self.pn * SLACK >= self.bound[at, None]


def _looker(method: str, g: Group, recall: float, stages: list[list[int]] | None) -> Callable[[slice], np.ndarray | None]:
    """For some queries, which pairs the method looks up: a mask, or None for all."""
    if method in ("naive", "dense"):
        return lambda at: None
    if method in ("length", "bucketed"):
        return g.by_length
    if method in ("coord", "incr"):
        return in_ranges(g, method == "incr")
    if method == "tree":
        return within_reach(g)
    if method in ("lsh", "blsh", "simple_lsh"):
        return meets(g, recall, method, stages)
    if method == "ap":

        def look(at: slice) -> np.ndarray:
            mask = np.zeros((len(g.q[at]), len(g.p)), bool)
            mask[prefix(g.q[at], g.p, g.bound[at])] = True
            return mask

        return look
    held = Lists(g.p)
    return lambda at: threshold(g.q[at], held, g.bound[at], method.endswith("max"), method.startswith("ta_"))


def _verify(g: Group, at: slice, mask: np.ndarray | None, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the looked up pairs whose score reaches the bound; with k, the k best a query."""
    q, bound = g.q[at], g.bound[at]
    s = q @ g.p.T
    reach = 1e-12 * g.qn[at] * (g.pn.max() if len(g.pn) else 0)  # a product is rounded by far less
    need = bound - slack(bound) - reach
    hit = s >= need[:, None]
    if mask is not None:
        hit &= mask
    if k is not None and len(g.p) > k and np.count_nonzero(hit) > 2 * k * len(q):
        top = np.partition(np.where(hit, s, -np.inf), len(g.p) - k, axis=1)[:, len(g.p) - k]
        hit &= s >= np.maximum(need, top - slack(top) - reach)[:, None]
    flat = np.flatnonzero(hit)
    i = flat // len(g.p) if len(flat) else flat
    j = flat - i * len(g.p)
    score = np.zeros(len(i))
    for x, y in zip(*g.axes):  # left to right, as the JVM's fold adds
        score += x[at][i] * y[j]
    ok = score >= bound[i]
    i, j, score = i[ok], j[ok], score[ok]
    if k is not None:
        order = np.lexsort((g.pid[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        ok = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j, score = i[ok], j[ok], score[ok]
    return i, j, score


def block_join(
    q: DataFrame, p: DataFrame, method: str, only: DataFrame | None = None, k: int | None = None, recall: float = 0.97,
    complete: bool = False, counted: bool = False,
) -> DataFrame:
    """(query_id, probe_id, score) of pairs whose score reaches the query's bound.

    only: the (qid, bucket) pairs to look at; p has a bucket column then, or log buckets of the
    length are its buckets; its nodes, where it has them, go to chunks by spread.  k: at least the k best pairs of each query.  complete: pairs that an
    approximate method does not look up are checked as well.  counted: and, beside them, rows
    without ids with (compared), how many pairs the method looked up.
    """
    from .joins import log_bucket

    if "bucket" not in p.columns:
        # a norm bucket holds one length's tenth; methods that do not go by length have all probes in one
        p = p.withColumn("bucket", F.lit(0).cast("long") if method in ("naive", "tree") else log_bucket(F.col("pn")))
    if "node" not in p.columns:
        p = p.withColumns({"node": F.lit(1).cast("long"), "spread": F.xxhash64("pid")})
    stats = p.groupBy("bucket").agg(F.max("pn").alias("longest"), F.count(F.lit(1)).alias("probes"))
    per_bucket, spark = stats.collect(), q.sparkSession

    def met(queries: DataFrame, buckets: DataFrame) -> DataFrame:
        if only is not None:
            return queries.join(only, "qid").join(buckets, "bucket")
        return queries.join(buckets, F.lit(True) if method == "naive" else F.col("qn") * F.col("longest") * SLACK >= F.col("bound"))

    # one row a bucket
    asked = met(q.select("qid", "qn", "bound"), F.broadcast(spark.createDataFrame(per_bucket, stats.schema))).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    asked = {r.bucket: r.n for r in asked.collect()}
    block = int(min(GROW * BLOCK, max(BLOCK, math.sqrt(sum(r.probes * asked.get(r.bucket, 0) for r in per_bucket) / LEAST))))
    sized = [(r.bucket, r.longest, math.ceil(r.probes / block), math.ceil(asked.get(r.bucket, 0) / block)) for r in per_bucket]
    tasks = max(1, math.ceil(max((parts for *_, parts in sized), default=1) * sum(chunks for _, _, chunks, _ in sized) * block / BLOCK / GROUPS))
    hot = F.broadcast(spark.createDataFrame(sized, "bucket long, longest double, chunks int, parts int").where("parts > 0"))
    left = met(q.select("qid", "qv", "qn", "bound"), hot).withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int"))
    span = F.col("qn") * F.col("longest")
    left = left.withColumn("local", F.when((span > 0) & (F.col("bound") > 0), F.col("bound") / span).otherwise(F.lit(0.0)))
    left = left.select(F.col("bucket").alias("b"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"), F.col("part").alias("d"), "qid", "qv", "qn", "bound", "local", "longest")
    right = p.join(hot, "bucket").select(
        "bucket", F.pmod("spread", F.col("chunks")).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "pid", "pv", "pn", "node",
    )
    stages = match_table(recall) if method == "blsh" else None
    names = {"query_id": pa.int64(), "probe_id": pa.int64(), "score": pa.float64()} | ({"compared": pa.int64()} if counted else {})

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({n: pa.array([], t) for n, t in names.items()})
        g = Group(a, b)
        if g.q.shape[1] != g.p.shape[1]:
            raise ValueError("vectors of different lengths")
        look, step, out, compared = _looker(method, g, recall, stages), max(1, PAIRS // len(g.p)), [], 0
        for lo in range(0, len(g.q), step):
            at = slice(lo, lo + step)
            mask = look(at)
            compared += len(g.q[at]) * len(g.p) if mask is None else int(np.count_nonzero(mask))
            i, j, score = _verify(g, at, None if complete else mask, k)
            out.append(pa.table({"query_id": g.qid[at][i], "probe_id": g.pid[j], "score": score}))
        out = pa.concat_tables(out)
        if counted:
            out = out.append_column("compared", pa.nulls(len(out), pa.int64()))
            out = pa.concat_tables([out, pa.table({n: pa.array([compared if n == "compared" else None], t) for n, t in names.items()})])
        return out

    schema = "query_id long, probe_id long, score double" + (", compared long" if counted else "")
    # with a number of its own, so that a task sorts some GROUPS groups however many there are
    left, right = left.repartition(tasks, "b", "c", "d"), right.repartition(tasks, "bucket", "chunk", "part")
    out = left.groupBy("b", "c", "d").cogroup(right.groupBy("bucket", "chunk", "part")).applyInArrow(run, schema)
    kept = (k or 0) * sum(asked.get(bucket, 0) * chunks for bucket, _, chunks, _ in sized)
    return out.repartition(math.ceil(kept / KEPT), "query_id") if kept > KEPT else out
