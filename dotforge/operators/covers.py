"""Nested covers of the probes, level by level, and their use for pruning.

Level 0 is one node over all probes.  A node of more than LEAF probes is split: FANOUT of
its distinct vectors, picked by a hash of their ids, are the centres of its children, and
every probe goes to the nearest of them.  So each level covers all probes by balls whose
members lie in a ball of the level before, and each is one table: node, parent, centre,
radius (the farthest member), probes.  A node is not split further if what is picked from
it is one vector.  Nodes of up to WHOLE probes are split to their leaves in one task each.

A query walks down level by level: children of the nodes it still holds stay if
ip(q, centre) + |q| * radius can reach its bound; what it holds when there are no more
children are leaves, whose probes it meets.  The join walks inside the kernel's groups, over
the nodes of a block of whole nodes of at most COARSE probes, which are split on there to leaves
(in_leaves, within_reach), so vectors are not copied a node; visits() walks over blocks of the tables' nodes.
Nodes number a fraction of the probes and are joined, never collected.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.shared import materialize, numbered

LEAF = 256
WHOLE = 4096  # probes of a node up to which one task splits it to its leaves
COARSE = 2048  # probes of a node from which on a group splits it by itself
NEAR = 8192  # vectors of a block of near_pairs()
PAIRS = 1 << 20  # of them looked at together
FANOUT = 8
PICKS = 4  # as many times FANOUT vectors are picked on average, since some are equal
LEVELS = 14  # child numbers take four bits each of a long
EPS = 1e-9
NODE = "level int, node long, parent long, centre array<double>, radius double, probes long"


def _share(level: int) -> Column:
    """A number in [0, 1) by a hash of the id, another one on each level."""
    return F.pmod(F.xxhash64("pid", F.lit(level)), F.lit(1 << 40)).cast("double") / float(1 << 40)


def build(p: DataFrame, leaf: int = LEAF, fanout: int = FANOUT, balls: bool = True) -> tuple[DataFrame, list[DataFrame]]:
    """((pid, node) of the leaves, the node table of each level below the root, if balls); p has pid and pv.

    Nodes of more than WHOLE probes are split level by level, as joins; one that has fewer is
    split to its leaves in one task (grow()), with the same centres.
    """
    held = materialize(p.select("pid", "pv", F.lit(1).cast("long").alias("node")))
    leaves, levels, aside, whole = [], [], [], max(leaf, WHOLE)
    for level in range(1, LEVELS + 1):
        large = F.broadcast(held.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole))  # a row for WHOLE probes at most
        aside.append(held.join(large, "node", "left_anti").select("pid", "pv", "node", F.lit(level).alias("level")))
        held = held.join(large, "node")
        picked = held.where(_share(level) * F.col("n") < PICKS * fanout)
        picked = picked.groupBy("node", "pv").agg(F.min(F.struct(_share(level).alias("s"), "pid")).alias("o"))
        nth = F.row_number().over(Window.partitionBy("node").orderBy("o"))  # some PICKS * fanout rows a node
        picked = picked.withColumn("i", nth).where(F.col("i") <= fanout)
        centres = picked.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("i", F.col("pv").alias("centre")))).alias("centres"))
        centres = materialize(centres.where(F.size("centres") > 1))
        if centres.isEmpty():
            break
        leaves.append(held.join(centres.select("node"), "node", "left_anti").select("pid", "node"))
        near = F.array_min(F.transform("centres", lambda c: F.struct(V.l2_squared("pv", c["centre"]).alias("d"), c["i"].alias("i"))))
        child = (F.col("node") * 16 + F.col("near.i")).alias("node")
        moved = materialize(held.join(centres, "node").select("pid", "pv", "node", near.alias("near")).select("pid", "pv", child, F.sqrt("near.d").alias("far")))
        if balls:
            reach = moved.groupBy("node").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("probes"))
            centre = centres.select(F.col("node").alias("parent"), F.explode("centres").alias("c")).select((F.col("parent") * 16 + F.col("c.i")).alias("node"), "parent", "c.centre")
            levels.append(materialize(centre.join(reach, "node").select(F.lit(level).alias("level"), "node", "parent", "centre", "radius", "probes")))
        held = moved.drop("far")
    leaves.append(held.select("pid", "node"))
    types = {"pid": pa.int64(), "level": pa.int32(), "node": pa.int64(), "parent": pa.int64(), "centre": pa.list_(pa.float64()), "radius": pa.float64(), "probes": pa.int64()}

    def run(key: tuple, t: pa.Table) -> pa.Table:
        m, shares = (t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) for c in ("pv", "shares"))
        at, nodes = grow(t["pid"].to_numpy(), m, shares, key[0].as_py(), key[1].as_py(), leaf, fanout)
        rows = pa.table({n: t["pid"] if n == "pid" else pa.array(at) if n == "node" else pa.nulls(len(t), x) for n, x in types.items()})
        below = pa.table({n: pa.nulls(len(nodes), x) if n == "pid" else pa.array([row[n] for row in nodes], x) for n, x in types.items()})
        return pa.concat_tables([rows, below]) if balls else rows

    aside = reduce(DataFrame.union, aside).withColumn("shares", F.array(*map(_share, range(1, LEVELS + 1))))
    grown = materialize(aside.groupBy("node", "level").applyInArrow(run, f"pid long, {NODE}"))
    leaves.append(grown.where("pid IS NOT NULL").select("pid", "node"))
    below = grown.where("pid IS NULL").drop("pid")
    for level in range(1, (below.agg(F.max("level")).first()[0] or 0) + 1 if balls else 0):
        some = below.where(F.col("level") == level)
        levels[level - 1 : level] = [levels[level - 1].union(some) if level <= len(levels) else some]
    return materialize(reduce(DataFrame.union, leaves)), levels


def grow(pid: np.ndarray, m: np.ndarray, shares: np.ndarray, node: int, level: int, leaf: int, fanout: int) -> tuple[np.ndarray, list[dict]]:
    """(the leaf of each vector, the nodes below) of a node whose children are of that level, split as build() does; shares: a column a level."""
    m, at, nodes, todo = m + 0.0, np.full(len(m), node), [], [(np.arange(len(m)), node, level)]  # no negative zeros
    while todo:
        rows, up, level = todo.pop()
        if len(rows) <= leaf or level > LEVELS:
            continue
        picked = rows[shares[rows, level - 1] * len(rows) < PICKS * fanout]
        picked = picked[np.lexsort((pid[picked], shares[picked, level - 1]))]
        centres = m[picked[np.sort(np.unique(m[picked], axis=0, return_index=True)[1])[:fanout]]] if len(picked) else m[:0]
        if len(centres) < 2:
            continue
        square = np.zeros((len(rows), len(centres)))
        for x, c in zip(m[rows].T, centres.T):  # left to right, as the JVM's fold adds
            square += (x[:, None] - c) ** 2
        near, far = square.argmin(1), np.sqrt(square.min(1))
        for i in np.unique(near).tolist():
            its, child = near == i, up * 16 + 1 + i
            at[rows[its]] = child
            nodes.append({"level": level, "node": child, "parent": up, "centre": centres[i], "radius": far[its].max(), "probes": int(its.sum())})
            todo.append((rows[its], child, level + 1))
    return at, nodes


def in_leaves(p: DataFrame, leaf: int = COARSE, fanout: int = FANOUT) -> DataFrame:
    """p with node, its leaf, and spread, which is one for the probes of a leaf unless they are more than a block."""
    from .kernels import BLOCK

    p = materialize(p)
    members, _ = build(p, leaf, fanout, balls=False)
    parts = members.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    spread = F.xxhash64("node", F.pmod(F.xxhash64("pid"), F.col("parts")))
    return p.join(members.join(parts, "node").select("pid", "node", spread.alias("spread")), "pid")


def split(m: np.ndarray, node: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT) -> np.ndarray:
    """The leaf of each vector when nodes of more than leaf of these vectors are split as in build(), with centres evenly from them."""
    node = node.copy()
    todo = [np.flatnonzero(node == x) for x in np.unique(node)]
    while todo:
        rows = todo.pop()
        up = int(node[rows[0]])
        if len(rows) <= leaf or up >> 4 * LEVELS:
            continue
        centres = np.unique(m[rows[np.linspace(0, len(rows) - 1, fanout).astype(int)]], axis=0)
        near = ((centres * centres).sum(1) - 2 * m[rows] @ centres.T).argmin(1)
        if (near == near[0]).all():
            continue
        node[rows] = up * 16 + 1 + near
        todo += [rows[near == x] for x in np.unique(near)]
    return node


def _balls(m: np.ndarray, node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(the ball of each leaf, centres, radii) level by level, leaves first, of the nodes over some vectors."""
    leaves, at_leaf = np.unique(node, return_inverse=True)
    up, out = leaves, []
    while True:
        which = np.unique(up, return_inverse=True)[1]
        rows = which[at_leaf]
        order = np.argsort(rows, kind="stable")
        starts = np.searchsorted(rows[order], np.arange(which.max() + 1))
        centre = np.add.reduceat(m[order], starts, axis=0) / np.diff(np.append(starts, len(m)))[:, None]
        out.append((which, centre, np.maximum.reduceat(np.sqrt(((m - centre[rows]) ** 2).sum(1))[order], starts)))
        if (up == 1).all():
            return out
        up = np.where(up > 1, up >> 4, up)  # child numbers take four bits


def within_reach(g) -> Callable[[slice], np.ndarray]:
    """For some queries of a kernels.Group: the probes of the leaves that a walk down the nodes over the group's probes leaves over."""
    node = split(g.p, g.node)
    balls, at_leaf = _balls(g.p, node), np.unique(node, return_inverse=True)[1]

    def look(at: slice) -> np.ndarray:
        held = None
        for which, centre, radius in reversed(balls):
            reach = g.q[at] @ centre.T + g.qn[at, None] * radius
            stay = (reach + EPS * (1 + np.abs(reach)) >= g.bound[at, None])[:, which]
            held = stay if held is None else held & stay
        return held[:, at_leaf]

    return look


def visits(q: DataFrame, p: DataFrame, leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """(level, nodes, visits): how many nodes each level has and how often a query (qid, qv, qn, bound) holds one of them.

    Nodes are dealt to blocks of about kernels.BLOCK in the order of their paths, so what a block
    lacks is only what lies above its first node, which it gets as well.  Every block meets every block
    of queries in one task, which walks down its nodes for PAIRS pairs at a time and counts.
    """
    from .kernels import BLOCK

    _, levels = build(p, leaf, fanout)
    if not levels:
        return q.sparkSession.createDataFrame([], "level int, nodes long, visits long")
    # leaves under one node have its number as the first bits, whatever their level
    nodes = reduce(DataFrame.union, levels).drop("probes").withColumn("path", F.call_function("shiftleft", "node", (LEVELS - F.col("level")) * 4))
    nodes = numbered(nodes, "path", name="place")
    count, parts = nodes.count(), max(1, -(-q.count() // BLOCK))
    blocks = -(-count // BLOCK)
    nodes = nodes.withColumn("block", F.floor(F.col("place") * blocks / count))
    above = F.transform(F.sequence(F.lit(1), F.col("level")), lambda i: F.call_function("shiftright", F.col("node"), (i - 1) * 4))
    needed = nodes.select("block", F.posexplode(above).alias("i", "node")).groupBy("block", "node").agg((F.min("i") == 0).alias("own"))
    right = needed.join(nodes.select("level", "node", "parent", "centre", "radius"), "node")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    left = q.select("qv", "qn", "bound", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("c"))
    pairs = PAIRS

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        seen = np.zeros(LEVELS + 1, np.int64)
        if len(x) and len(y):
            m, w = (t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) for t, c in ((x, "qv"), (y, "centre")))
            qn, bound, radius = x["qn"].to_numpy(), x["bound"].to_numpy(), y["radius"].to_numpy()
            level, own, place = y["level"].to_numpy(), y["own"].to_numpy(zero_copy_only=False), {n: i for i, n in enumerate(y["node"].to_pylist())}
            up = np.array([place[n] if n > 1 else -1 for n in y["parent"].to_pylist()])
            below = [np.flatnonzero(level == n) for n in range(2, level.max() + 1)]
            close = 1e-12 * (1 + qn.max() * (np.sqrt((w * w).sum(1)) + radius).max())  # a product is rounded by far less
            rows = max(1, pairs // len(y))
            for lo in range(0, len(m), rows):
                at = slice(lo, lo + rows)
                reach = m[at] @ w.T + qn[at, None] * radius
                i, j = np.nonzero(np.abs(reach + EPS * (1 + np.abs(reach)) - bound[at, None]) <= close)
                if len(i):
                    total = np.zeros(len(i))
                    for k in range(m.shape[1]):  # left to right, as the JVM's fold adds
                        total += m[at][i, k] * w[j, k]
                    reach[i, j] = total + qn[at][i] * radius[j]
                held = reach + EPS * (1 + np.abs(reach)) >= bound[at, None]
                for these in below:
                    held[:, these] &= held[:, up[these]]
                seen += np.bincount(level[own], held[:, own].sum(0), LEVELS + 1).astype(np.int64)
        some = np.flatnonzero(seen)
        return pa.table({"level": pa.array(some, pa.int32()), "visits": pa.array(seen[some])})

    # with a number of its own, so that a task walks one block on average
    left, right = left.repartition(blocks * parts, "c", "d"), right.repartition(blocks * parts, "block", "part")
    met = left.groupBy("c", "d").cogroup(right.groupBy("block", "part")).applyInArrow(run, "level int, visits long")
    out = nodes.groupBy("level").agg(F.count(F.lit(1)).alias("nodes")).join(met.groupBy("level").agg(F.sum("visits").alias("visits")), "level", "left")
    return out.select("level", "nodes", F.coalesce("visits", F.lit(0).cast("long")).alias("visits")).orderBy("level")


def near_pairs(df: DataFrame, radius: float, leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """(id, other, distance) of all pairs id < other of (id, vec) whose distance is the radius or less.

    Whole leaves are dealt to blocks of about NEAR vectors (a larger leaf to several), by the
    order of their numbers, so neighbours lie together; every two blocks
    meet in one task, which leaves out pairs of leaves whose balls lie too far apart and works out
    the others, PAIRS at a time.  So a vector is sent once a block, not once a leaf.
    """
    from . import joins

    p = materialize(joins.prepare(df, "p").drop("pn", "pu"))
    members, _ = build(p, leaf, fanout)
    sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("probes"))
    parts = sizes.select("node", "probes", F.explode(F.sequence(F.lit(0), F.ceil(F.col("probes") / NEAR).cast("int") - 1)).alias("sub"), F.ceil(F.col("probes") / NEAR).cast("int").alias("subs"))
    # leaves under one node have its number as the first bits, whatever their level
    depth = F.floor(F.log2("node") / 4).cast("int")
    parts = numbered(parts.withColumn("path", F.call_function("shiftleft", "node", (LEVELS - depth) * 4)), "path", "sub", name="place")
    size = sizes.agg(F.coalesce(F.sum("probes"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.ceil(F.col("probes") / NEAR)), F.lit(0)).alias("parts")).first()
    count = -(-size.n // NEAR)
    blocks = parts.select("node", "sub", "subs", F.floor(F.col("place") * count / max(1, size.parts)).alias("block"))
    held = p.join(members, "pid").join(blocks, "node").where(F.pmod(F.xxhash64("pid"), F.col("subs")) == F.col("sub")).select("pid", "pv", "node", "block")
    held = materialize(held)
    right = held.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))).alias("c"), F.col("block").alias("d"), F.col("pid").alias("id"), F.col("pv").alias("v"), F.col("node").alias("leaf"))
    left = held.withColumnRenamed("block", "a").withColumn("block", F.explode(F.sequence("a", F.greatest(F.col("a"), F.lit(count - 1).cast("long")))))
    step, tolerance = PAIRS, EPS

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        names = {"id": pa.int64(), "other": pa.int64(), "distance": pa.float64()}
        if not len(x) or not len(y):
            return pa.table({n: pa.array([], t) for n, t in names.items()})
        same = x["a"][0].as_py() == x["block"][0].as_py()
        m, w = (t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) for t, c in ((x, "pv"), (y, "v")))
        u, v, mid, wid = x["node"].to_numpy(), y["leaf"].to_numpy(), x["pid"].to_numpy(), y["id"].to_numpy()
        (_, c, r), (_, d, s) = _balls(m, u)[0], _balls(w, v)[0]
        apart = np.sqrt(np.maximum((c * c).sum(1)[:, None] + (d * d).sum(1) - 2 * c @ d.T, 0)) - r[:, None] - s
        near = apart <= radius + 1e-6 * (1 + radius + np.abs(c).max() + np.abs(d).max())
        at_u, at_v = np.unique(u, return_inverse=True)[1], np.unique(v, return_inverse=True)[1]
        mm, ww, out = (m * m).sum(1), (w * w).sum(1), []
        rows = max(1, step // len(w))
        for lo in range(0, len(m), rows):
            at = slice(lo, lo + rows)
            square = mm[at, None] + ww - 2 * m[at] @ w.T
            hit = square <= radius * radius + tolerance * (1 + radius * radius + mm[at, None] + ww)
            i, j = np.nonzero(hit & near[at_u[at]][:, at_v])
            total = np.zeros(len(i))
            for k in range(m.shape[1]):  # left to right, as the JVM's fold adds
                total += (m[at][i, k] - w[j, k]) ** 2
            far = np.sqrt(total)
            a, b = mid[at][i], wid[j]
            ok = (far <= radius) & ((a < b) if same else True)
            out.append(pa.table({"id": np.minimum(a, b)[ok], "other": np.maximum(a, b)[ok], "distance": far[ok]}))
        return pa.concat_tables(out)

    return left.groupBy("a", "block").cogroup(right.groupBy("c", "d")).applyInArrow(run, "id long, other long, distance double")
