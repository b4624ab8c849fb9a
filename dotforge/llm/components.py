"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex u links to one smaller v that links to no other, so that v is the smallest of its component."""
    ends = edges.select("u", F.lit(1).alias("up")).union(edges.select(F.col("v").alias("u"), F.lit(0).alias("up")))
    seen = ends.groupBy("u").agg(F.sum("up").alias("up"), F.min("up").alias("low"))
    return not seen.agg(F.bool_or((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("low") == 0)))).first()[0]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: every vertex links (larger or smaller) neighbours to its smallest one.

    The smallest neighbour comes from a map-side-combined min, and the join that
    hands it out is an ordinary equi-join, so a hub of any degree is split.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.join(low, "u")
    if large:
        out = out.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        )
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(u, v) links of any sortable type -> (node, root): the smallest node of each component.

    Nodes without links do not appear.  Self links and repeated links are
    harmless; links with a null end are ignored; no links give an empty table.
    Each round writes its (shrinking) edge table to the shared folder, so a lost
    executor costs one round at most; there are none if the links are stars already.
    """
    edges = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        if _settled(edges):
            break
        edges = materialize(_star(_star(edges, True), False))
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
