"""Readers and writers of vector files, sparse matrices and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import numbered


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): lines with their position, files in the order of their names.

    Lines are counted per file block, blocks get running offsets (one row a block), and a
    line's number is its block's offset plus its place in the block, which is how far its id
    lies from the block's least: a task reads a block's lines one after the other.  So no line is shuffled.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m")
    )
    before = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lines.groupBy("f", "b").agg(F.count(F.lit(1)).alias("c"), F.min("m").alias("least"))
    offsets = sizes.select("f", "b", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("least")).alias("ahead"))
    return lines.join(F.broadcast(offsets), ["f", "b"]).select((F.col("ahead") + F.col("m")).alias("n"), "value")


def read_mma(spark: SparkSession, path: str, left: bool = True) -> DataFrame:
    """MatrixMarket array file -> (id, vec): rows as vectors (left), or columns."""
    lines = _numbered(spark, path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    head = lines.orderBy("n").first()
    rows, cols = (int(x) for x in head.value.split()[:2])
    at = F.col("n") - head.n - 1
    row, col = F.pmod(at, F.lit(rows)), F.floor(at / rows)
    vec, coord = (row, col) if left else (col, row)
    cells = lines.where(F.col("n") > head.n).select(vec.cast("long").alias("id"), coord.cast("int").alias("coord"), F.trim("value").cast("double").alias("val"))
    return cells.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("coord", "val"))), lambda s: s["val"]).alias("vec"))


def write_mma(df: DataFrame, path: str) -> None:
    """(id, vec) as the rows of an array file, values column by column; ids must be 0..n-1."""
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("vec")).alias("cols")).first()
    cells = df.select("id", F.posexplode("vec").alias("coord", "val")).orderBy("coord", "id").select(F.col("val").cast("string").alias("value"))
    head = df.sparkSession.createDataFrame([("%%MatrixMarket matrix array real general",), (f"{size.rows} {size.cols}",)], "value string").coalesce(1)
    head.union(cells).write.text(path)


def read_csv(spark: SparkSession, path: str, width: int, rows: int | None = None) -> DataFrame:
    """Lines of `width` comma-separated values -> (id, vec); the id is the line's number."""
    if not width or rows == 0:
        raise ValueError("vectors need a width")
    vec = F.transform(F.slice(F.split("value", ","), 1, width), lambda x: F.trim(x).cast("double"))
    out = _numbered(spark, path).where(F.trim("value") != "").select(F.col("n").alias("id"), vec.alias("vec"))
    return out.where(F.col("id") < rows) if rows else out


def write_csv(df: DataFrame, path: str) -> None:
    df.orderBy("id").select(F.array_join(F.transform("vec", lambda x: x.cast("string")), ",").alias("value")).write.text(path)


def read_vectors(spark: SparkSession, path: str, width: int = 0, left: bool = True) -> DataFrame:
    """By suffix: .mma, .csv or .parquet."""
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    if kind == "mma":
        return read_mma(spark, path, left)
    if kind == "csv":
        return read_csv(spark, path, width)
    if kind == "parquet":
        return spark.read.parquet(path).select("id", "vec")
    raise ValueError(f"unknown format of {path}")


def from_memory(spark: SparkSession, vectors: list[list[float]]) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vec array<double>")


def write_ijv(m: DataFrame, path: str, numbering: int = 0) -> None:
    """Triples as lines "row col value"."""
    m.select(F.format_string("%d %d %.8f", F.col("row") + numbering, F.col("col") + numbering, F.col("val")).alias("value")).write.text(path)


def read_ijv(spark: SparkSession, path: str, numbering: int = 0, values: bool = True) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    val = F.element_at(parts, 3).cast("double") if values else F.lit(1.0)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select((parts[0].cast("long") - numbering).alias("row"), (parts[1].cast("int") - numbering).cast("int").alias("col"), val.alias("val"))


def write_csr(m: DataFrame, path: str, rows: int, numbering: int = 0, header: bool = False) -> None:
    """One line "col val col val ..." per row, empty rows included; with header, "rows cols entries" first (1-based)."""
    base = 1 if header else numbering
    got = m.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "val"))).alias("e"))
    # ordered before they become text, so that finding the ranges of rows does not write them all once more
    lines = m.sparkSession.range(rows).withColumnRenamed("id", "row").join(got, "row", "left").orderBy("row")
    text = F.array_join(F.transform("e", lambda s: F.concat_ws(" ", (s["col"] + base).cast("string"), s["val"].cast("string"))), " ")
    lines = lines.select(F.coalesce(text, F.lit("")).alias("value"))
    if header:
        s = m.agg(F.coalesce(F.max("col") + 1, F.lit(0)), F.count(F.lit(1))).first()
        lines = m.sparkSession.createDataFrame([(f"{rows} {s[0]} {s[1]}",)], "value string").coalesce(1).union(lines)
    lines.write.text(path)


def read_csr(spark: SparkSession, path: str, numbering: int = 0, header: bool | None = None) -> DataFrame:
    """Rows of "col val" pairs -> triples; header None: recognised by its three numbers."""
    lines = _numbered(spark, path)
    if header is None:
        header = is_cluto(spark, path)
    base, skip = (1, 1) if header else (numbering, 0)
    parts = F.split(F.trim("value"), r"\s+")
    # a line is split twice; inside a function of each entry it would be split again for every one
    pairs = F.arrays_zip(F.filter(parts, lambda _, i: i % 2 == 0).alias("c"), F.filter(parts, lambda _, i: i % 2 == 1).alias("v"))
    out = lines.where((F.col("n") >= skip) & (F.trim("value") != "")).select((F.col("n") - skip).alias("row"), F.explode(pairs).alias("p"))
    return out.where("p.v IS NOT NULL").select("row", (F.col("p.c").cast("int") - base).cast("int").alias("col"), F.col("p.v").cast("double").alias("val"))


def write_smat(m: DataFrame, path: str) -> None:
    """Lines "row, column, value" (1-based, tabs) ordered by column and row, and a last one of value 0 at the far corner if no entry is there."""
    size = m.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    line = F.format_string("%d\t%d\t%.17g", F.col("row") + 1, F.col("col") + 1, F.col("val"))
    out = m.orderBy("col", "row").select(line.alias("value"))
    if size.r is not None and m.where((F.col("row") == size.r) & (F.col("col") == size.c)).isEmpty():
        out = out.union(m.sparkSession.createDataFrame([(f"{size.r + 1}\t{size.c + 1}\t0",)], "value string").coalesce(1))
    out.write.text(path)


def read_smat(spark: SparkSession, path: str) -> DataFrame:
    return read_ijv(spark, path, 1).where(F.col("val") != 0)


def read_metis(spark: SparkSession, path: str) -> DataFrame:
    """A graph file as triples: line i lists the (1-based) neighbours of vertex i, after the header "vertices edges [format [weights]]".

    The format's digits say whether a line holds the vertex's size, its weights, and a value after each neighbour;
    without values entries are 1.  Lines that start with % are comments.
    """
    lines = _numbered(spark, path).where(~F.col("value").startswith("%"))
    first = lines.orderBy("n").first()
    head = first.value.split()
    kind = (head[2] if len(head) > 2 else "0").zfill(3)
    weights = int(head[3]) if len(head) > 3 else 1
    lead = (kind[0] == "1") + (weights if kind[1] == "1" else 0)
    step = 2 if kind[2] == "1" else 1
    rows = numbered(lines.where(F.col("n") > first.n), "n", name="row")
    parts = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    at = lambda n: F.filter(F.slice(parts, lead + 1, 1 << 30), lambda _, i: i % step == n)
    cells = rows.select("row", F.explode(F.arrays_zip(at(0).alias("c"), at(step - 1).alias("v"))).alias("x")).where("x.v IS NOT NULL")
    return cells.select("row", (F.col("x.c").cast("int") - 1).alias("col"), (F.col("x.v").cast("double") if step == 2 else F.lit(1.0)).alias("val"))


def is_cluto(spark: SparkSession, path: str) -> bool:
    """Whether the first line is a header of three numbers (rows of pairs have an even count)."""
    first = _numbered(spark, path).where(F.col("n") == 0).first()
    return bool(first) and len(first.value.split()) == 3


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """(lines, tokens, most_tokens, bytes) of the lines that are no % comments."""
    n = F.size(F.filter(F.split("value", r"\s+"), lambda x: x != ""))
    lines = spark.read.text(path).where(~F.col("value").startswith("%"))
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.sum(n).cast("long").alias("tokens"), F.max(n).cast("long").alias("most_tokens"), F.sum(F.octet_length("value") + 1).cast("long").alias("bytes"))


def write_results(results: DataFrame, path: str) -> None:
    """Lines "query probe score"."""
    results.select(F.concat_ws(" ", "query_id", "probe_id", F.col("score").cast("string")).alias("value")).write.text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="query_id long, probe_id long, score double")
