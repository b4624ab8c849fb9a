"""Sparse-matrix operators over triples (row BIGINT, col INT, val DOUBLE).

A missing triple is a zero.  `axis` names the side that an operator groups by: "row" or "col".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import numbered

POWERS = {"sqrt": 0.5, "pow25": 0.25, "pow65": 0.65, "pow75": 0.75, "pow85": 0.85}


def _other(axis: str) -> str:
    return "col" if axis == "row" else "row"


def from_dense(df: DataFrame, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """Dense vectors to triples; exact zeros drop out."""
    out = df.select(F.col(id_col).alias("row"), F.posexplode(vec_col).alias("col", "val"))
    return out.where(F.col("val") != 0)


def to_dense(m: DataFrame, width: int) -> DataFrame:
    """Triples to (id, vec) of a given width."""
    got = m.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "val"))).alias("e"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("e", i), F.lit(0.0)))
    return got.select(F.col("row").alias("id"), vec.alias("vec"))


def submatrix(m: DataFrame, start: int, rows: int) -> DataFrame:
    """`rows` consecutive rows from `start`, renumbered from 0."""
    return m.where(F.col("row").between(start, start + rows - 1)).withColumn("row", F.col("row") - start)


def extract_rows(m: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows by a table (row, pos): the row at position pos becomes row pos; a row may be taken several times."""
    return m.join(ids, "row").select(F.col("pos").alias("row"), "col", "val")


def partition(m: DataFrame, parts: DataFrame, part: int) -> DataFrame:
    """Rows of one part of (row, part), renumbered in row order."""
    mine = parts.where(F.col("part") == part).select("row")
    return compact_rows(m.join(mine, "row", "left_semi"), mine)


def split(m: DataFrame, colour: Column) -> dict[int, DataFrame]:
    """One matrix per colour of its entries."""
    return {r[0]: m.where(colour == r[0]) for r in m.select(colour.alias("c")).distinct().collect()}


def prune(m: DataFrame, axis: str, least: int, most: int) -> DataFrame:
    """Entries of rows (columns) with least..most entries."""
    kept = m.groupBy(axis).agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most)).select(axis)
    return m.join(kept, axis, "left_semi").select("row", "col", "val")


def low_filter(m: DataFrame, axis: str, norm: int, fraction: float) -> DataFrame:
    """The largest entries of each row (column) until their sum (norm 1) or sum of squares passes a fraction of the whole; the entry that crosses stays."""
    weight = F.col("val") if norm == 1 else F.col("val") * F.col("val")
    w = Window.partitionBy(axis)
    order = w.orderBy(F.desc("val"), _other(axis))
    ahead = F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = m.withColumn("w", weight).withColumn("ahead", ahead).withColumn("all", F.sum("w").over(w))
    # with negative entries a sum may fall again: nothing stays after the first that crosses
    out = out.withColumn("most", F.max("ahead").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where(F.col("most") <= fraction * F.col("all")).select("row", "col", "val")


def top_k_plus(m: DataFrame, axis: str, k: int, least: float) -> DataFrame:
    """The k largest entries of each row (column), and any of at least `least`."""
    rank = F.row_number().over(Window.partitionBy(axis).orderBy(F.desc("val"), _other(axis)))
    return m.withColumn("r", rank).where((F.col("r") <= k) | (F.col("val") >= least)).select("row", "col", "val")


def z_score(m: DataFrame, z: float) -> DataFrame:
    """Entries above z / (entries of their row)."""
    n = m.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    return m.join(n, "row").where(F.col("val") > z / F.col("n")).select("row", "col", "val")


def compact_cols(m: DataFrame) -> DataFrame:
    """Columns renumbered by decreasing frequency (ties by column)."""
    n = m.groupBy("col").agg(F.count(F.lit(1)).alias("n"))
    new = numbered(n, F.desc("n"), "col", name="new").select("col", F.col("new").cast("int").alias("new"))
    return m.join(new, "col").select("row", F.col("new").alias("col"), "val")


def compact_rows(m: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Rows renumbered from 0 in order; by default those with entries."""
    new = numbered((m if rows is None else rows).select("row").distinct(), "row", name="new")
    return m.join(new, "row").select(F.col("new").cast("long").alias("row"), "col", "val")


def reorder_rows(m: DataFrame) -> DataFrame:
    """Rows renumbered by decreasing greatest weight (ties by row)."""
    top = m.groupBy("row").agg(F.max(F.abs("val")).alias("top"))
    new = numbered(top, F.desc("top"), "row", name="new").select("row", "new")
    return m.join(new, "row").select(F.col("new").cast("long").alias("row"), "col", "val")


def sort_indices(m: DataFrame, axis: str = "row") -> DataFrame:
    return m.repartition(axis).sortWithinPartitions(axis, _other(axis))


def sorted_check(m: DataFrame, axis: str, position: str) -> DataFrame:
    """(is_sorted): whether every row (column) lists its entries in rising order of `position`."""
    w = Window.partitionBy(axis).orderBy(position)
    ok = F.coalesce(F.lag(_other(axis)).over(w) <= F.col(_other(axis)), F.lit(True))
    return m.select(ok.alias("ok")).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("is_sorted"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").cast("long").alias("row"), F.col("row").cast("int").alias("col"), "val")


def normalize(m: DataFrame, axis: str, norm: int) -> DataFrame:
    """Rows (columns) at L1 or L2 length 1; zero ones stay."""
    size = F.sum(F.abs("val")) if norm == 1 else F.sqrt(F.sum(F.col("val") * F.col("val")))
    out = m.join(m.groupBy(axis).agg(size.alias("s")), axis)
    return out.select("row", "col", F.when(F.col("s") > 0, F.col("val") / F.col("s")).otherwise(F.col("val")).alias("val"))


def scale(m: DataFrame, kind: str) -> DataFrame:
    """Weighting by term frequency (maxtf, maxtf2, sqrt, pow25 .. pow85, log) or by rarity (idf, idf2)."""
    v, size = F.col("val"), F.abs("val")
    if kind in ("maxtf", "maxtf2"):
        a = 0.5 if kind == "maxtf" else 0.1
        out = m.join(m.groupBy("row").agg(F.max(F.abs("val")).alias("top")), "row")
        new = a + (1 - a) * v / F.col("top")
    elif kind in POWERS:
        out, new = m, F.when(v != 0, 0.1 + F.signum(v) * F.power(size, F.lit(POWERS[kind]))).otherwise(v)
    elif kind == "log":
        out, new = m, F.when(v != 0, 1 + F.signum(v) * F.log2(size)).otherwise(v)
    elif kind in ("idf", "idf2"):
        df = m.groupBy("col").agg(F.count(F.lit(1)).alias("df"))
        whole = m.agg(F.countDistinct("row").alias("rows"), F.count(F.lit(1)).alias("nnz"), F.countDistinct("col").alias("cols"))
        out = m.join(df, "col").crossJoin(F.broadcast(whole))  # one row
        bg = F.greatest(F.lit(10.0), 0.5 * F.col("nnz") / F.col("cols"))
        new = v * (F.log(F.col("rows") / F.col("df")) if kind == "idf" else F.log((F.col("rows") + 2 * bg) / (bg + F.col("df"))))
    else:
        raise ValueError(f"unknown scaling {kind!r}")
    return out.select("row", "col", new.alias("val"))


def sums(m: DataFrame, axis: str, squared: bool = False) -> DataFrame:
    """(axis, total): sums, or squared norms, of rows or columns."""
    v = F.col("val") * F.col("val") if squared else F.col("val")
    return m.groupBy(axis).agg(F.sum(v).alias("total"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """(left, right, dot) of all rows of a and b that share a column."""
    x = a.select(F.col("row").alias("left"), "col", F.col("val").alias("x"))
    y = b.select(F.col("row").alias("right"), "col", F.col("val").alias("y"))
    return x.join(y, "col").groupBy("left", "right").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))


def similarity(m: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """(a, b, sim) for the row pairs (a, b): cos, jac (Tanimoto), min or amin, over full rows."""
    x = pairs.join(m.select(F.col("row").alias("a"), "col", F.col("val").alias("x")), "a")
    y = pairs.join(m.select(F.col("row").alias("b"), "col", F.col("val").alias("y")), "b")
    both = x.join(y, ["a", "b", "col"], "full").na.fill(0.0, ["x", "y"])
    xv, yv = F.col("x"), F.col("y")
    xy, xx, yy = F.sum(xv * yv), F.sum(xv * xv), F.sum(yv * yv)
    low, high = F.sum(F.least(xv, yv)), F.sum(F.greatest(xv, yv))
    sim = {"cos": F.try_divide(xy, F.sqrt(xx * yy)), "jac": F.try_divide(xy, xx + yy - xy), "min": F.try_divide(low, high), "amin": F.try_divide(low, F.sum(xv))}[kind]
    return both.groupBy("a", "b").agg(F.coalesce(sim, F.lit(0.0)).alias("sim"))


def similar_rows(m: DataFrame, query: DataFrame, rid: int, least: float, most: int, skip_self: bool = True) -> DataFrame:
    """(row, sim): the `most` rows up to rid whose dot product with the query (col, val) is least or more."""
    mine = m.where((F.col("row") < rid) if skip_self else (F.col("row") <= rid))
    met = mine.join(query.select("col", F.col("val").alias("q")), "col").groupBy("row").agg(F.sum(F.col("val") * F.col("q")).alias("sim"))
    return met.where(F.col("sim") >= least).orderBy(F.desc("sim"), "row").limit(most)


def compare(a: DataFrame, b: DataFrame, precision: float) -> DataFrame:
    """(is_equal): whether no entry differs by more than the precision."""
    both = a.select("row", "col", F.col("val").alias("x")).join(b.select("row", "col", F.col("val").alias("y")), ["row", "col"], "full")
    ok = F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))) <= precision
    return both.select(ok.alias("ok")).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("is_equal"))


def kv_top(m: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    """The k entries of largest (smallest) value."""
    return m.orderBy(F.asc("val") if ascending else F.desc("val"), "row", "col").limit(k)


def volume(m: DataFrame) -> float:
    """The sum of all entries."""
    return m.agg(F.coalesce(F.sum("val"), F.lit(0.0))).first()[0]
