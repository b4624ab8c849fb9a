"""Binary sparse matrices: rows (`binrow`), columns (`bincol`) or triples (`bijv`), in 32-bit little-endian words.

    binrow   rows, columns, rows + 1 offsets of the rows, the column of every entry, the value of every entry (32-bit float)
    bincol   rows, columns, columns + 1 offsets of the columns, the row of every entry, the value of every entry
    bijv     rows, columns, entries (64 bits), 1 if there are values, then row, column, value of every entry

Values may be missing, and then are 1.  Indices start at 0.

A matrix is one such file, or a folder of files, each a whole matrix of consecutive rows
(columns for bincol) that follow those of the files before it, in the order of their names;
triples hold whole coordinates in each.  The reader is a data source whose splits are ranges of
rows, columns or triples found by their offsets, so a large file is read by many tasks, each
seeking to its own parts.  Files are opened by pyarrow's file systems, in every store that
these know.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

KINDS = ("binrow", "bincol", "bijv")
SPLIT = 1 << 20  # entries of a split, about
BATCH = 1 << 16  # entries of a batch
PART = 1 << 22  # entries of a written file, about
TRIPLE = np.dtype([("row", "<i4"), ("col", "<i4"), ("val", "<f4")])
PATTERN = np.dtype([("row", "<i4"), ("col", "<i4")])
SCHEMA = "row long, col int, val double"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _words(f, at: int, n: int, kind: str = "<i4") -> np.ndarray:
    f.seek(at)
    data = f.read(n * 4)
    if len(data) != n * 4:
        raise ValueError("file is shorter than its header says")
    return np.frombuffer(data, kind)


class Split(InputPartition):
    def __init__(self, path: str, lo: int, hi: int, ahead: int, lines: int, entries: int, values: bool):
        self.path, self.lo, self.hi, self.ahead, self.lines, self.entries, self.values = path, lo, hi, ahead, lines, entries, values


class Reader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def _files(self) -> tuple[fs.FileSystem, list[tuple[str, int]]]:
        store, path = _open(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return store, [(path, info.size)]
        found = store.get_file_info(fs.FileSelector(path))
        return store, sorted((x.path, x.size) for x in found if x.is_file and not x.base_name.startswith(("_", ".")))

    def partitions(self) -> list[Split]:
        store, files = self._files()
        out, ahead = [], 0
        for path, size in files:
            with store.open_input_file(path) as f:
                rows, cols = _words(f, 0, 2).tolist()
                if self.kind == "bijv":
                    entries = int(np.frombuffer(_words(f, 8, 2).tobytes(), "<i8")[0])
                    values = bool(_words(f, 16, 1)[0])
                    out += [Split(path, lo, min(entries, lo + SPLIT), 0, 0, entries, values) for lo in range(0, entries, SPLIT)]
                    continue
                lines = rows if self.kind == "binrow" else cols
                entries = int(_words(f, 8 + 4 * lines, 1)[0])
                values = size >= 8 + 4 * (lines + 1) + 8 * entries
                # lines are as long as they are: a split takes as many as hold SPLIT entries on average
                step = max(1, lines * SPLIT // max(1, entries))
                out += [Split(path, lo, min(lines, lo + step), ahead, lines, entries, values) for lo in range(0, lines, step)]
                ahead += lines
        return out or [Split("", 0, 0, 0, 0, 0, False)]

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        names = ["row", "col", "val"]
        if not part.path:
            return
        with _open(self.path)[0].open_input_file(part.path) as f:
            if self.kind == "bijv":
                kind = TRIPLE if part.values else PATTERN
                for lo in range(part.lo, part.hi, BATCH):
                    n = min(part.hi, lo + BATCH) - lo
                    got = np.frombuffer(_words(f, 20 + lo * kind.itemsize, n * kind.itemsize // 4).tobytes(), kind)
                    val = got["val"].astype(float) if part.values else np.ones(n)
                    yield pa.RecordBatch.from_arrays([pa.array(got["row"].astype(np.int64)), pa.array(got["col"].astype(np.int32)), pa.array(val)], names)
                return
            ends = _words(f, 8 + 4 * part.lo, part.hi - part.lo + 1).astype(np.int64)
            start = 8 + 4 * (part.lines + 1)
            for lo in range(int(ends[0]), int(ends[-1]), BATCH):
                n = min(int(ends[-1]), lo + BATCH) - lo
                other = _words(f, start + 4 * lo, n)
                val = _words(f, start + 4 * (part.entries + lo), n, "<f4").astype(float) if part.values else np.ones(n)
                line = np.searchsorted(ends, np.arange(lo, lo + n), "right") - 1 + part.lo + part.ahead
                row, col = (line, other) if self.kind == "binrow" else (other, line)
                yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int64)), pa.array(col.astype(np.int32)), pa.array(val)], names)


class BinaryMatrix(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dotforge_matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        if self.options.get("kind") not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        return Reader(self.options["path"], self.options["kind"])


def read_binary(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(row, col, val) of a binary matrix file or a folder of them."""
    spark.dataSource.register(BinaryMatrix)
    return spark.read.format(BinaryMatrix.name()).option("kind", kind).load(path)


def write_binary(m: DataFrame, path: str, kind: str, rows: int, cols: int, values: bool = True, part: int = PART) -> None:
    """(row, col, val) as a folder of binary files of about `part` entries, in which consecutive rows (columns) stay together.

    Each file is written by one task, which holds its entries (12 bytes each), under a name
    of its own attempt, and moved to its place at the end; a line of more entries than
    `part` is a file of its own.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    line, lines = ("col", cols) if kind == "bincol" else ("row", rows)
    entries = m.count()
    files = max(1, min(lines, -(-entries // part)))
    step = max(1, -(-lines // files))
    store, base = _open(path)
    store.create_dir(base, recursive=True)
    # every file has one row of its number, so that files without entries are written too
    numbers = m.sparkSession.range(-(-lines // step) or 1).select(F.col("id").alias("file"))
    dealt = m.select(F.floor(F.col(line) / step).cast("long").alias("file"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("val").cast("double").alias("val"))

    def write(key: tuple, own: pa.Table, got: pa.Table) -> pa.Table:
        number = key[0].as_py()
        first = number * step
        count = max(0, min(lines, first + step) - first)
        row, col, val = (got[c].to_numpy() for c in ("row", "col", "val"))
        order = np.lexsort((row, col) if kind == "bincol" else (col, row))
        row, col, val = row[order], col[order], val[order]
        if kind == "bijv":
            head = np.array([rows, cols], "<i4").tobytes() + np.array([len(row)], "<i8").tobytes() + np.array([values], "<i4").tobytes()
            body = np.empty(len(row), TRIPLE if values else PATTERN)
            body["row"], body["col"] = row, col
            if values:
                body["val"] = val
            parts = [head, body.tobytes()]
        else:
            at, other = (col, row) if kind == "bincol" else (row, col)
            ends = np.searchsorted(at - first, np.arange(count + 1))
            shape = [rows, count] if kind == "bincol" else [count, cols]
            parts = [np.array(shape, "<i4").tobytes(), ends.astype("<i4").tobytes(), other.astype("<i4").tobytes()]
            parts += [val.astype("<f4").tobytes()] if values else []
        from pyspark import TaskContext

        there, folder = _open(path)
        fresh = f"{folder}/.{number}-{TaskContext.get().taskAttemptId()}"
        with there.open_output_stream(fresh) as f:
            for x in parts:
                f.write(x)
        there.move(fresh, f"{folder}/part-{number:08d}.{kind}")
        return pa.table({"n": [len(row)]})

    numbers.groupBy("file").cogroup(dealt.groupBy("file")).applyInArrow(write, "n long").agg(F.sum("n")).collect()
