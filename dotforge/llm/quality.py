"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

Method.  Features of a text: hash buckets of its words and of their two-byte endings
(log term frequency, scaled to unit length), structure statistics (shares of byte
classes, word and line figures) and metadata (length in code points).  The machine
adds to a linear score all pairwise interactions through low-rank factors, computed
in linear time as half of (sum of v x)^2 - sum of (v x)^2.

Training (numpy, on the driver) sees a bounded sample of labelled texts (MOST_TEXTS
texts of at most learn.LONGEST bytes).  Labels, language, source and ids are never inputs.  The weights have a
fixed size (about 2.5 MB) and are broadcast.

Scale.  Scoring maps batches independently; it never shuffles a text.

Defined results: null text counts as empty, and an empty text is scored by its (zero)
statistics; without labels of both kinds the score is the share of good training
labels (0.0 without labels); texts of any length are scored as a whole; equal texts score
alike, and of several labels of one id the largest counts; an empty table gives an empty
result; extra columns pass through score(), whose column takes one more leading underscore
as long as the input has a column of its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import crc_mod, fresh_name
from .learn import Adam, labelled_sample, sigmoid

MOST_TEXTS = 6000
BUCKETS = 1 << 15
ENDINGS = 1 << 12
STATS = 14
FACTORS = 8
EPOCHS = 6
THRESHOLD = 0.3
_KIND = np.zeros(256, np.int64)  # 1 upper, 2 lower, 3 digit, 4 blank, 5 ASCII mark, 0 other
_KIND[33:127] = 5
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each text, feature index, value), at least STATS entries a text."""
    n = len(offsets) - 1
    starts, ends, first = tc.word_spans(data, offsets)
    owner = np.repeat(np.arange(n), np.diff(first))
    low = tc.FOLD[data]
    word = (tc.run_hash(low, starts, ends) >> np.uint64(49)).astype(np.int64)
    tail = low[ends - 1].astype(np.int64) * 256 + np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0) if len(ends) else word
    tail = (tail * 2654435761 & 0xFFFFFFFF) >> 20
    span = BUCKETS + ENDINGS
    pair, count = np.unique(np.concatenate([owner * span + word, owner * span + BUCKETS + tail]), return_counts=True)
    text, index = pair // span, pair % span
    value = np.log1p(count).astype(np.float32)
    norm = np.sqrt(np.bincount(text, value * value, n)).astype(np.float32)
    value /= np.maximum(norm, np.float32(1e-6))[text]

    size = np.diff(offsets).astype(np.float64)
    at = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(at * 6 + _KIND[data], minlength=6 * n).reshape(n, 6) / np.maximum(size, 1)[:, None]
    words = np.diff(first).astype(np.float64)
    is_word = index < BUCKETS
    distinct = np.bincount(text[is_word], minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, text[is_word], count[is_word])
    points = np.bincount(at[(data & 0xC0) != 0x80], minlength=n)
    lines = np.bincount(at[data == 10], minlength=n)
    some = np.maximum(words, 1)
    ends_mark = np.bincount(owner[_KIND[data[ends - 1]] == 5], minlength=n) if len(ends) else np.zeros(n)
    stats = np.column_stack([
        np.ones(n), *(kinds[:, k] * 3 for k in range(6)), np.minimum(size / some, 40) / 10, distinct / some, most / some * 3,
        lines / some * 5, np.log1p(words) / 5, np.log1p(points) / 8, ends_mark / some,
    ]).astype(np.float32)
    text = np.concatenate([text, np.repeat(np.arange(n), STATS)])
    index = np.concatenate([index, np.tile(np.arange(STATS) + span, n)])
    value = np.concatenate([value, stats.ravel()])
    order = np.argsort(text, kind="stable")
    return np.searchsorted(text[order], np.arange(n)), index[order], value[order]


def machine(model: dict, begin: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(logits, sum of v x) of texts; linear in the entries."""
    vx = model["v"][index] * value[:, None]
    total = np.add.reduceat(vx, begin, axis=0)
    own = np.add.reduceat((vx * vx).sum(1), begin)
    line = np.add.reduceat(model["w"][index] * value, begin)
    return model["b"][0] + line + 0.5 * ((total * total).sum(1) - own), total


def train(texts: pa.Array, y: np.ndarray, weight: np.ndarray, seed: int = 9) -> dict:
    prior = float((y * weight).sum() / max(1e-9, weight.sum())) if len(y) else 0.0
    if not len(y) or not 0 < y.mean() < 1:
        return {"prior": prior}
    rng = np.random.default_rng(seed)
    data, off = tc.utf8(texts)
    rows = []
    for lo, hi in tc.slices(off):
        begin, index, value = features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        stop = np.append(begin[1:], len(index))
        rows += [(index[b:e], value[b:e]) for b, e in zip(begin, stop)]
    m = BUCKETS + ENDINGS + STATS
    model = {"v": rng.normal(0, 0.05, (m, FACTORS)).astype(np.float32), "w": np.zeros(m, np.float32), "b": np.array([np.log(prior / (1 - prior))], np.float32)}
    adam = Adam(model, 0.02)
    for _ in range(EPOCHS):
        for pick in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 100)):
            sizes = np.array([len(rows[i][0]) for i in pick])
            begin = np.cumsum(sizes) - sizes
            index = np.concatenate([rows[i][0] for i in pick])
            value = np.concatenate([rows[i][1] for i in pick])
            logit, total = machine(model, begin, index, value)
            g = ((sigmoid(logit) - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            ge = np.repeat(g, sizes) * value
            inner = np.repeat(total, sizes, axis=0) - model["v"][index] * value[:, None]
            gv, gw = np.zeros_like(model["v"]), np.zeros_like(model["w"])
            np.add.at(gv, index, ge[:, None] * inner)
            np.add.at(gw, index, ge)
            adam.step({"v": gv + 1e-4 * model["v"], "w": gw, "b": np.array([g.sum()], np.float32)})
    return {k: v.astype(np.float32) for k, v in model.items()} | {"prior": prior}


def score_texts(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if "v" not in model:
        return np.full(len(offsets) - 1, model["prior"])
    return sigmoid(machine(model, *features(data, offsets))[0])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_TEXTS) -> dict:
    return train(*labelled_sample(docs, labels, "quality", 5, 0, most))


def score(docs: DataFrame, model: dict, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs plus the quality of each whole text (0 to 1), as fresh_name(out_col)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [score_texts(shared.value, data, off) for _, _, data, off in tc.batches_of(batch, f"c{at}")]
            got = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(got.astype(np.float64), 6))], [*batch.schema.names, "s"])

    out = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema)
    out = out.mapInArrow(scan, f"{schema}, s double")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("s").alias(fresh_name(out_col, names)))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (F.coalesce(crc_mod("doc_id", 5), F.lit(-1)) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
