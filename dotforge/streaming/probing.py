"""Streams of query vectors against a static set of probes, and of probes against a static set of queries."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import joins, kernels
from ..plans.shared import materialize


def stream_above_theta(queries: DataFrame, probes: DataFrame, theta: float) -> DataFrame:
    """Streaming (query_id, probe_id, score): a stateless stream-static equi-join of blocks.

    The probes are packed and written once, a row a chunk of a norm bucket.  The queries of a micro-batch,
    longest first, are packed into rows of at most joins.BLOCK, which meet the chunks that the
    length bound leaves; what two blocks make is worked out at once.  So the probes are
    shuffled, not broadcast; only the bounds of their chunks, one row each, are.
    """
    first = probes.where("vec IS NOT NULL").select(F.size("vec")).first()
    width = first[0] if first else None
    p, stats = joins.with_buckets(joins.prepare(probes, "p", width=width))
    chunk = F.pmod(F.xxhash64("pid"), F.ceil(F.col("probes") / joins.BLOCK)).cast("int").alias("chunk")
    p = p.join(F.broadcast(stats.select("bucket", "probes")), "bucket").select("bucket", chunk, "pid", "pv", "pn")
    block = joins.BLOCK

    def chunks(key: tuple, t: pa.Table) -> pa.Table:
        row = _packed(t.select(["pid", "pv"]), 0, "pids", "ps").drop_columns("part")
        return pa.table({"bucket": [key[0].as_py()], "chunk": pa.array([key[1].as_py()], pa.int32()), "longest": [max(t["pn"].to_pylist())], "pids": row["pids"], "ps": row["ps"]})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch]).sort_by([("qn", "descending")])
            for lo in range(0, len(rows), block):
                some = rows.slice(lo, block).combine_chunks()
                row = _packed(some.select(["qid", "qv"]), 0).drop_columns("part")
                yield from row.append_column("qn", pa.array([some["qn"][0].as_py()])).to_batches()

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                qid, q, pid, p = (batch.column(n)[row].values.to_numpy(zero_copy_only=False) for n in ("qids", "qs", "pids", "ps"))
                yield from _reaching(qid, q.reshape(len(qid), -1), pid, p.reshape(len(pid), -1), theta)

    held = materialize(p.groupBy("bucket", "chunk").applyInArrow(chunks, "bucket long, chunk int, longest double, pids array<bigint>, ps array<double>"))
    q = joins.prepare(queries, "q", width=width).select("qid", "qv", "qn").mapInArrow(pack, "qids array<bigint>, qs array<double>, qn double")
    bounds = F.broadcast(held.select("bucket", "chunk", "longest"))
    met = q.join(bounds, F.col("qn") * F.col("longest") * joins.SLACK >= theta).join(held.drop("longest"), ["bucket", "chunk"])
    # a row holds two blocks, so few rows make a batch
    return met.select("qids", "qs", "pids", "ps").mapInArrow(reaching, "query_id long, probe_id long, score double")


def top_k_sink(probes: DataFrame, k: int, path: str, **how) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the k best probes of each query of the batch, written once per batch number."""

    def run(batch: DataFrame, number: int) -> None:
        joins.row_top_k(batch, probes, k, **how).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RANKED = "query_id long, probe_id long, score double, rank long"


def _best(query: np.ndarray, probe: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each query, ties by the smaller probe id."""
    order = np.lexsort((probe, -score, query))
    q = query[order]
    head = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q))))
    return order[rank < k]


def _packed(t: pa.Table, part: int, ids: str = "qids", vecs: str = "qs") -> pa.Table:
    """One row of (part, ids, vectors one after the other)."""
    id_, vec = (c.combine_chunks() for c in t.columns)
    whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.table({"part": pa.array([part], pa.int32()), ids: whole(id_), vecs: whole(vec.flatten())})


def _best_of(qid: np.ndarray, q: np.ndarray, pid: np.ndarray, p: np.ndarray, k: int, pairs: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The k best of the probes for each query, some queries at a time."""
    if q.shape[1] != p.shape[1]:
        raise ValueError("vectors of different lengths")
    step = max(1, pairs // len(pid))
    for lo in range(0, len(qid), step):
        s = q[lo : lo + step] @ p.T
        i, j = np.nonzero(np.ones(s.shape, bool))
        if len(pid) > k:
            least = np.partition(s, len(pid) - k, axis=1)[:, len(pid) - k]
            size = np.sqrt((q[lo : lo + step] ** 2).sum(1) * (p * p).sum(1).max())
            i, j = np.nonzero(s >= (least - 1e-12 * size)[:, None])
        score = np.zeros(len(i))
        for c in range(q.shape[1]):  # left to right, as the JVM's fold adds
            score += q[lo + i, c] * p[j, c]
        at = _best(qid[lo + i], pid[j], score, k)
        yield pa.RecordBatch.from_arrays([pa.array(qid[lo + i][at]), pa.array(pid[j][at]), pa.array(score[at])], ["query_id", "probe_id", "score"])


def _reaching(qid: np.ndarray, q: np.ndarray, pid: np.ndarray, p: np.ndarray, theta: float) -> Iterator[pa.RecordBatch]:
    """The pairs whose score is theta or more, some queries at a time."""
    if q.shape[1] != p.shape[1]:
        raise ValueError("vectors of different lengths")
    qn, longest = np.sqrt((q * q).sum(1)), np.sqrt((p * p).sum(1).max())
    stay = qn * longest * (1 + 1e-9) >= theta
    qid, q, qn = qid[stay], q[stay], qn[stay]
    step = max(1, kernels.PAIRS // len(pid))
    axes = np.ascontiguousarray(q.T), np.ascontiguousarray(p.T)  # a coordinate's values lie together
    for lo in range(0, len(qid), step):
        need = theta - kernels.slack(np.float64(theta)) - 1e-12 * qn[lo : lo + step] * longest
        i, j = np.nonzero(q[lo : lo + step] @ p.T >= need[:, None])
        i += lo
        score = np.zeros(len(i))
        for x, y in zip(*axes):  # left to right, as the JVM's fold adds
            score += x[i] * y[j]
        ok = score >= theta
        yield pa.RecordBatch.from_arrays([pa.array(qid[i[ok]]), pa.array(pid[j[ok]]), pa.array(score[ok])], ["query_id", "probe_id", "score"])


class RunningTopK(StatefulProcessor):
    """One value a query: the k best probes that have come so far."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "probes array<bigint>, scores array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.held.get() if self.held.exists() else ([], [])
        probe, score = np.array(old[0], np.int64), np.array(old[1], np.float64)
        for part in rows:
            probe, score = np.append(probe, part["probe_id"].to_numpy()), np.append(score, part["score"].to_numpy())
            probe, at = np.unique(probe, return_index=True)  # a probe that came twice counts once
            score = score[at]
            at = _best(np.zeros(len(probe), np.int64), probe, score, self.k)
            probe, score = probe[at], score[at]
        self.held.update((probe.tolist(), score.tolist()))
        yield pd.DataFrame({"query_id": key[0], "probe_id": probe, "score": score, "rank": np.arange(1, len(probe) + 1)})

    def close(self) -> None:
        pass


def running_top_k(probes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Streaming (query_id, probe_id, score, rank): after each micro-batch of new probes, the k best so far of the queries it met.

    Both sides are packed into rows of at most about joins.BLOCK vectors, every new block of probes meets
    every block of queries, and what they make is worked out at once, of which only the k best
    a query go on.  The state of a query is those k, however many probes have come.  The state lives in the store that STORE names, which this sets for
    the session; output mode update, of which the last rows of a query count.
    """
    spark = queries.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    q = joins.prepare(queries, "q").select("qid", "qv")
    parts = max(1, math.ceil(q.count() / joins.BLOCK))
    q = q.groupBy(F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("part")).applyInArrow(lambda key, t: _packed(t, key[0].as_py()), "part int, qids array<bigint>, qs array<double>")
    block = joins.BLOCK

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                yield from _packed(pa.Table.from_batches([batch.slice(lo, block)]), 0, "pids", "ps").drop_columns("part").to_batches()

    p = joins.prepare(probes, "p").select("pid", "pv").mapInArrow(pack, "pids array<bigint>, ps array<double>")
    p = p.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                qid, q, pid, p = (batch.column(n)[row].values.to_numpy(zero_copy_only=False) for n in ("qids", "qs", "pids", "ps"))
                if len(qid) and len(pid):
                    yield from _best_of(qid, q.reshape(len(qid), -1), pid, p.reshape(len(pid), -1), k)

    # a row holds two blocks, so few rows make a batch
    pairs = p.join(q, "part").select("qids", "qs", "pids", "ps").mapInArrow(fewer, "query_id long, probe_id long, score double")
    return pairs.groupBy("query_id").transformWithStateInPandas(RunningTopK(k), RANKED, "update", "none")


def latest_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch's rows once per batch number."""

    def run(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/part={number}")

    return run


def latest(written: DataFrame) -> DataFrame:
    """The rows of each query's last batch, of what latest_sink() wrote."""
    last = written.groupBy("query_id").agg(F.max("batch").alias("batch"))
    return written.join(last, ["query_id", "batch"]).select("query_id", "probe_id", "score", "rank")
