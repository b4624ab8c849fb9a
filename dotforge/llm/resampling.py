"""Importance resampling towards a target distribution, over identical texts collapsed.

Method.  Texts are lower-cased (A-Z) and cut into words (digits, letters and everything
beyond ASCII); features are runs of one and two consecutive words, hashed to BUCKETS
buckets by the crc32 of their bytes.  Rows are grouped by their whole text, so each
distinct text is cut once for the counts and once for its weight, and its features count
as often as it has rows.  A bucket's gain is the log ratio of its smoothed shares in the
target and in the corpus, a text's weight the floored mean of its features' gains.  The
weights are joined back to the rows, each adds the Gumbel noise of its own id, and the
highest scores are drawn, which is sampling without replacement by weight.

Scale.  The grouping combines equal texts before the shuffle; counts leave a task as one
vector of BUCKETS values, and the gains, BUCKETS values, are all that the driver holds.
Digests meet their weights by spread_join, so a text of a third of all rows stays spread.
The order over all rows is dealt in ranges.

Defined results: null and empty texts have no features and weight 0; a null id counts as
an empty string in the noise and comes last among equal scores; rows equal in id and text
get ranks of their own in any order; texts of any length are cut as a whole; without
a target every gain compares with the smoothing alone; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import numbered
from . import textcore as tc
from .common import materialize, spread_join

BUCKETS = 10_000
PERCENT = 25
LEAST_WORDS = 20
SEED = 7
SHORT = 48  # bytes up to which words are hashed side by side
GAP = np.ones(256, bool)
GAP[48:58] = GAP[65:91] = GAP[97:123] = GAP[128:] = False
_STEP = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _STEP = np.where(_STEP & 1, (_STEP >> 1) ^ np.uint32(0xEDB88320), _STEP >> 1).astype(np.uint32)


def crc_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """crc32 of data[start:end] for every run, continued from the crc32 of what stands before it."""
    size = ends - starts
    out = np.zeros(len(starts), np.uint32) if before is None else before.astype(np.uint32)
    order = np.argsort(-size, kind="stable")
    longer = int(np.searchsorted(-size[order], -SHORT, "left"))
    for i in order[:longer]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]], int(out[i]))
    order = order[longer:]
    state, at = ~out[order], starts[order]
    less = -size[order]
    for j in range(-int(less[0]) if len(order) else 0):
        n = int(np.searchsorted(less, -j, "left"))
        state[:n] = _STEP[(state[:n] ^ data[at[:n] + j]) & 255] ^ (state[:n] >> np.uint32(8))
    out[order] = ~state
    return out


def buckets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature, and the number of words of each text."""
    low = tc.FOLD[data]
    starts, ends, first = tc.word_spans(low, offsets, GAP)
    words = np.diff(first)
    owner = np.repeat(np.arange(len(words)), words)
    one = crc_runs(low, starts, ends)
    pair = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # words with one before them
    space = ~(_STEP[(~one[pair - 1] ^ np.uint32(32)) & np.uint32(255)] ^ (~one[pair - 1] >> np.uint32(8)))
    two = crc_runs(low, starts[pair], ends[pair], space)
    return np.concatenate([owner, owner[pair]]), np.concatenate([one, two]).astype(np.int64) % BUCKETS, words


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of each bucket over (text, copies); what a task sends is one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            copies = batch.column(batch.schema.get_field_index("copies")).to_numpy()
            for lo, hi, data, off in tc.batches_of(batch):
                text, bucket, _ = buckets_of(data, off)
                for n in np.unique(copies[lo:hi]):  # whole numbers, so that sums stay exact
                    total += int(n) * np.bincount(bucket[copies[lo:hi][text] == n], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text", "copies").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of the smoothed shares, floored."""
    t, s = target.astype(np.float64), source.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def collapsed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(text, copies) of every distinct text; null counts as empty."""
    return docs.groupBy(F.coalesce(F.col(text_col), F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("copies"))


def text_weights(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(digest, n_words, n_features, weight) of every distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weight = [], [], []
            for lo, hi, data, off in tc.batches_of(batch):
                text, bucket, n = buckets_of(data, off)
                count = np.bincount(text, minlength=hi - lo)
                total = np.zeros(hi - lo, np.int64)
                np.add.at(total, text, gain[bucket])
                words.append(n)
                features.append(count)
                weight.append(total // np.maximum(count, 1))
            if words:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (words, features, weight))], ["digest", "n_words", "n_features", "weight"])

    return texts.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text").mapInArrow(run, "digest binary, n_words long, n_features long, weight long")


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row; rank from 1 for the rows drawn, else null."""
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest")))
    texts = materialize(collapsed(docs, text_col))
    weights = materialize(text_weights(texts, gains(bucket_counts(collapsed(target)), bucket_counts(texts))))
    known = spread_join(rows, weights, "digest").drop("digest")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    # written with a number of its own for each row, so that the order over all rows is the same whenever a task runs again
    scored = materialize(known.withColumn("score", F.col("weight") + noise).withColumn("nth", F.monotonically_increasing_id()))
    able = scored.where(F.col("n_words") >= LEAST_WORDS)
    drawn = PERCENT * able.count() // 100
    placed = numbered(able, F.desc("score"), F.col("doc_id").asc_nulls_last(), "nth", name="place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long")
    rest = scored.where(F.col("n_words") < LEAST_WORDS).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", rank).drop("place", "nth").unionByName(rest.drop("nth"))


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids drawn, in the order of their ranks."""
    return importance(docs, target, id_col, text_col).where(F.col("rank").isNotNull()).orderBy("rank").select("doc_id", "rank", "score")
