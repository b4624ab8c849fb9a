"""Document fingerprints by consistent weighted sampling.

Method.  A text is a weighted set: its words (folded A-Z), each weighing its count
times the square of its length in bytes, so that what tells texts apart outweighs
what every text holds.  For each of SAMPLES samples and each word, two gamma(2, 1)
variates r, c and a uniform b follow from a hash of (word, sample).  The word's
weight w is quantised to t = floor(ln w / r + b), and the word with the least
ln c - r (t - b + 1) is drawn with its t.  Two texts draw the same (word, t) with
probability equal to their generalised Jaccard similarity, so the share of equal
samples estimates it.  A sample is kept as 16 bits; equal texts have equal prints.

Neighbours.  near_edited and near_next need the next document in descending id
order.  Ids, texts' hashes and lengths alone are put in order first, range by range, and
cut where another RANGE_BYTES of text are reached (more of it if there would be more than
MOST_RANGES ranges); the first row of each cut is broadcast.  Each of these ranges is a
partition of its own, whose task walks its rows in order, a batch at a time, and the first
document of a range also travels, as a guest, to the range before it (from the first range
to the last).  Texts cross one shuffle, once.

Defined results: null text counts as empty; empty texts have an all-zero print, and
two of them are alike (1.0); null ids come last in the order; rows with equal ids are
ordered by a hash of the text, so many rows of one id, or of none, are spread over ranges;
rows repeated in full are each other's neighbours, in one range; texts of any length are
read as a whole; a single row is its own next document; empty input gives an empty
result; columns other than the id and the text, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .common import materialize

SAMPLES = 64
RANGE_BYTES = 8 << 20
MOST_RANGES = 50_000
LAST = -(1 << 63)  # stands for a null id in the order
_SEEDS = tc.seeds(SAMPLES, 501)[:, None]


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of gamma(2, 1) at the n cell centres, by Newton steps on its distribution function."""
    u = (np.arange(n) + 0.5) / n
    x = np.where(u < 0.5, np.sqrt(2 * u), 2 - 1.3 * np.log1p(-u))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-12), x / 2)
    return x


_GAMMA = _gamma_quantiles().astype(np.float32)
_LN_GAMMA = np.log(_gamma_quantiles()).astype(np.float32)
_LOW = np.uint64(0xFFFF)


def draws(words: np.ndarray, lnw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the sampling value, and the quantised weight t, of every (sample, weighted word)."""
    x = (words[None, :] ^ _SEEDS) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    r = _GAMMA[(x >> np.uint64(48)).astype(np.int64)]
    b = ((x >> np.uint64(32)) & _LOW).astype(np.float32) * np.float32(2.0**-16)
    t = np.floor(lnw / r + b)
    b -= t
    b -= np.float32(1)
    b *= r
    b += _LN_GAMMA[((x >> np.uint64(16)) & _LOW).astype(np.int64)]
    return b, t


def prints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, SAMPLES) 16-bit samples."""
    n = len(offsets) - 1
    out = np.zeros((n, SAMPLES), np.uint16)
    starts, ends, first = tc.word_spans(data, offsets)
    if not len(starts):
        return out
    vocabulary, at, inverse = np.unique(tc.run_hash(tc.FOLD[data], starts, ends), return_index=True, return_inverse=True)
    length = (ends - starts)[at].astype(np.float64)
    owner = np.repeat(np.arange(n), np.diff(first))
    pair, count = np.unique(owner * len(vocabulary) + inverse, return_counts=True)
    text, word = pair // len(vocabulary), pair % len(vocabulary)
    begin = np.searchsorted(text, np.arange(n + 1))
    # a draw depends on the word and its count only: each such pair is drawn once
    span = int(count.max()) + 1
    kinds, kind = np.unique(word * span + count, return_inverse=True)
    word, count = kinds // span, kinds % span
    value, t = draws(vocabulary[word], np.log(count * length[word] ** 2).astype(np.float32))
    sample = np.arange(SAMPLES)
    for d in range(n):
        k = kind[begin[d] : begin[d + 1]]
        if len(k):
            p = k[value.take(k, axis=1).argmin(1)]
            out[d] = tc.mix(vocabulary[word[p]] + t[sample, p].astype(np.int64).view(np.uint64)) >> np.uint64(48)
    return out


def fingerprints(texts: pa.Array, near: list[int] | None = None) -> np.ndarray:
    """Prints of texts.  Texts with close numbers in `near` are drawn together, to share their words' draws."""
    order = np.argsort(near, kind="stable") if near else np.arange(len(texts))
    data, off = tc.utf8(texts.take(pa.array(order)) if near else texts)
    got = [prints(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in tc.slices(off, 1 << 19)]
    out = np.zeros((len(texts), SAMPLES), np.uint16)
    if got:
        out[order] = np.concatenate(got)
    return out


def hexed(print_: np.ndarray) -> str:
    return print_.astype(">u2").tobytes().hex()


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hexed(p) for p in fingerprints(batch.column(1))], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, other: str) -> str:
    """text with its last third replaced by the first as many characters of other."""
    m = len(text) // 3
    return text[: len(text) - m] + other[:m]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _emit(rows: list, nxt: list, new: list, own: np.ndarray, alter: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    """rows: (id, text); nxt, new: the text after each, and its edited text; own, alter, after: their prints."""
    cols = [
        pa.array([None if k == LAST else k for k, _ in rows], pa.int64()),
        pa.array([len(t) for _, t in rows], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
        pa.array([hexed(p) for p in own], pa.string()),
        pa.array([hexed(p) for p in alter], pa.string()),
        pa.array((own == alter).mean(1) if len(rows) else [], pa.float64()),
        pa.array((own == after).mean(1) if len(rows) else [], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _OUT.split(", ")])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, guest, k, h, text) in order: each row that is no guest meets the row after it."""
    held = []  # the last row, not emitted yet
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            rows = held + list(zip(*(part.column(i).to_pylist() for i in (0, 1, 2, 4))))
            ok = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i + 1][0] == rows[i][0]]
            after = [rows[i + 1][3] for i in ok]
            new = [edited(rows[i][3], o) for i, o in zip(ok, after)]
            texts = {i: rows[i][3] for i in sorted({*ok, *(i + 1 for i in ok)})}
            place = {i: j for j, i in enumerate(texts)}
            marks = fingerprints(pa.array([*texts.values(), *new], pa.string()), [*texts, *ok])
            own, follow = [place[i] for i in ok], [place[i + 1] for i in ok]
            yield _emit([rows[i][2:] for i in ok], after, new, marks[own], marks[len(texts) :], marks[follow])
            held = rows[-1:]


def heads_of(rows: DataFrame, range_bytes: int, most: int = MOST_RANGES) -> tuple[np.ndarray, np.ndarray]:
    """(~k, h) of the first row of every range of (k, h, text), in order; at most about `most` ranges."""
    order = (F.desc("k"), "h")
    slim = rows.select("k", "h", F.octet_length("text").cast("long").alias("size")).repartitionByRange(*order).sortWithinPartitions(*order)
    slim = materialize(slim.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
    sums = slim.groupBy("part").agg(F.sum("size").alias("bytes"))
    total = sums.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    width = max(1, range_bytes, -(-total // most))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    ahead = sums.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    cut = slim.join(F.broadcast(ahead), "part").select("k", "h", "place", "part", F.floor(at / width).alias("range"))
    heads = cut.groupBy("range").agg(F.min(F.struct("part", "place", "k", "h")).alias("f")).orderBy("range").select("f.k", "f.h").toArrow()
    k, h = ~heads["k"].to_numpy(), heads["h"].to_numpy()
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])  # a range of rows repeated in full is not cut
    return k[new], h[new]


def range_of(heads: tuple[np.ndarray, np.ndarray], k: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the range that each row (~k, h) falls in, whether it is the first row of it)."""
    hk, hh = heads
    lo, hi = np.searchsorted(hk, k), np.searchsorted(hk, k, "right")
    for i in np.flatnonzero(hi > lo).tolist():  # ranges that start within the same id
        hi[i] = lo[i] + np.searchsorted(hh[lo[i] : hi[i]], h[i], "right")
    at = np.maximum(hi - 1, 0)
    return at, (hk[at] == k) & (hh[at] == h)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The fingerprints of every text and of its edited text, and how near they are; see the module's text."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))
    heads = heads_of(rows, range_bytes)
    shared, ranges = spark.sparkContext.broadcast(heads), max(1, len(heads[0]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "guest", "k", "h", "text"]
        for batch in batches:
            at, is_head = range_of(shared.value, ~batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.zeros(len(at), bool)), *batch.columns], names)
            also = np.flatnonzero(is_head)
            if len(also):
                part = batch.take(pa.array(also))
                yield pa.RecordBatch.from_arrays([pa.array(((at[also] - 1) % ranges).astype(np.int32)), pa.array(np.ones(len(also), bool)), *part.columns], names)

    dealt = rows.mapInArrow(deal, "range int, guest boolean, k long, h long, text string")
    dealt = dealt.repartitionById(ranges, "range").sortWithinPartitions("range", "guest", F.desc("k"), "h", "text")
    return dealt.mapInArrow(_walk, _OUT)
