"""Substring deduplication by content-defined chunking with a gear rolling hash.

Method.  A gear hash rolls over the last 16 bytes of a text; where it falls below
a threshold (on average every MEAN_BYTES bytes) the next word starts a new chunk, and a
chunk that would pass 16 words is cut there.  Cuts depend on nearby bytes only, so
an insertion shifts text but not the cuts after it.  From every chunk start the
variable-length piece made of whole chunks up to at least 16 words is digested (128
bits); a piece whose digest occurs in an earlier text is a repeat.  Overlapping repeats
of a text are merged, and merged stretches of 20 words or more are removed.  The
first text always keeps its own, however often it says it: a text that only repeats
itself does not change.  Passages of over 50 words hold such pieces, unless their first
and last common cuts lie less than 20 words apart (about one in 2000 of 51 words); a few
words at their ends, outside the common cuts, remain.

Order of texts: a key that hashes doc_id and text, so which copy stays is arbitrary but
the same in every run.

Scale.  Each Arrow batch settles its own repeats first, so a passage that a third
of all texts hold reaches the one shuffle at most once per batch (or as often as one text
repeats it); that shuffle carries digests and positions, never text.  Digests are sorted
by Spark, which spills, and streamed: a task holds one batch and at most FLUSH repeats.
Pieces of repeats return to their texts by one equi-join on a 96-bit key.

Defined results: null text counts as empty and stays null; texts below 16 words
never change; texts of any length are cut as a whole; rows repeated in full (same doc_id
and text) count as one text and both stay as they are with respect to each other; a null
doc_id is an ordinary value; an empty table gives an empty result; extra columns pass
through, and the two added columns take one more leading underscore as long as the input
has a column of their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore as tc

WINDOW = 16
MEAN_BYTES = 18
MOST_WORDS = 16
PIECE_WORDS = 16
LEAST_WORDS = 20
FLUSH = 500_000
_GEAR = (tc.seeds(256, 101) >> np.uint64(17)).astype(np.uint16)
_STEPS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd factors of the two halves of a digest


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash of the WINDOW bytes that end at each byte, by doubling."""
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        shifted = h[:-width] << np.uint16(width)
        h = h.copy()
        h[width:] += shifted
        width *= 2
    return h


def cuts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each word starts a chunk."""
    n = len(starts)
    cut = np.zeros(n + 1, bool)
    at = np.flatnonzero(gear(data) < 65536 // MEAN_BYTES)
    begin = offsets[np.searchsorted(offsets, at, "right") - 1]
    at = at[at - begin >= WINDOW]
    cut[np.searchsorted(starts, at, "right")] = True
    cut[first] = True
    cut = cut[:n]
    idx = np.arange(n)
    since = idx - np.maximum.accumulate(np.where(cut, idx, 0))
    return cut | (since % MOST_WORDS == 0)


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first word within it, words, both halves of the digest) of every piece."""
    starts, ends, first = tc.word_spans(data, offsets)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = tc.run_hash(data, starts, ends)
    n = len(h)
    begin = np.flatnonzero(cuts(data, offsets, starts, first))
    end = np.append(begin[1:], n)
    text = np.searchsorted(first, begin, "right") - 1
    reach = np.searchsorted(end, begin + PIECE_WORDS)
    ok = reach < len(end)
    ok[ok] &= end[reach[ok]] <= first[text[ok] + 1]
    begin, stop, text = begin[ok], end[reach[ok]], text[ok]
    halves = []
    for step in _STEPS:
        p, q = np.full(n + 1, step, np.uint64), np.full(n + 1, pow(step, -1, 1 << 64), np.uint64)
        p[0] = q[0] = 1
        p, q = np.cumprod(p), np.cumprod(q)
        acc = np.zeros(n + 1, np.uint64)
        np.cumsum(tc.mix(h ^ np.uint64(step)) * p[:n], out=acc[1:])
        halves.append(tc.mix((acc[stop] - acc[begin]) * q[begin] + (stop - begin).astype(np.uint64)))
    return text, begin - first[text], stop - begin, *halves


def _merge(key: np.ndarray, pos: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching [pos, pos + size) by key."""
    if not len(key):
        return key, pos, size
    order = np.lexsort((pos, key))
    key, pos, end = key[order], pos[order], (pos + size)[order]
    new = np.ones(len(key), bool)
    same = key[1:] == key[:-1]
    group = np.concatenate([[0], np.cumsum(~same)])
    span = int(end.max()) + 1
    far = np.maximum.accumulate(end + group * span) - group * span
    new[1:] = ~same | (pos[1:] > far[:-1])
    at = np.flatnonzero(new)
    return key[at], pos[at], np.maximum.reduceat(end, at) - pos[at]


# spot: first word << 17 | words << 1 | whether it is known to be a repeat; code tells texts of one key apart
_ROWS = "high long, low long, key long, code int, spot long"
_SPANS = "key long, code int, pos int, size int"


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, code, text) -> the places of each digest in its first text of the batch, and known repeats."""
    for batch in batches:
        keys, codes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        found = []
        for lo, _, data, off in tc.batches_of(batch):
            text, pos, size, high, low = pieces(data, off)
            found.append((high, low, keys[lo + text], codes[lo + text], pos, size))
        if not found:
            continue
        high, low, key, code, pos, size = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((pos, code, key, low, high))
        high, low, key, code, pos, size = (x[order] for x in (high, low, key, code, pos, size))
        new = np.ones(len(high), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(high)), 0))
        own = (key == key[head]) & (code == code[head])
        k, c, p, s = _merge_by(key[~own], code[~own], pos[~own], size[~own])
        spread = tc.mix(k.view(np.uint64) + p.astype(np.uint64))
        for h, w, a, b, spot in (
            (high[own], low[own], key[own], code[own], pos[own] << 17 | size[own] << 1),
            # merged stretches may be longer than a spot can say: they go in parts
            *((spread[at], spread[at], k[at], c[at], q << 17 | z << 1 | 1) for at, q, z in _parts(p, s)),
        ):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(w.view(np.int64)), pa.array(a), pa.array(b.astype(np.int32)), pa.array(spot.astype(np.int64))], [f.split()[0] for f in _ROWS.split(", ")])


def _parts(pos: np.ndarray, size: np.ndarray, most: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, start, words) of stretches in parts of at most `most` words."""
    at, done = np.arange(len(pos)), 0
    while len(at):
        yield at, pos[at] + done, np.minimum(size[at] - done, most)
        done += most
        at = at[size[at] > done]


def _merge_by(key: np.ndarray, code: np.ndarray, pos: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_merge by (key, code)."""
    order = np.lexsort((code, key))
    key, code, pos, size = key[order], code[order], pos[order].astype(np.int64), size[order].astype(np.int64)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (code[1:] != code[:-1])
    head = np.flatnonzero(new)
    number, pos, size = _merge(np.cumsum(new) - 1, pos, size)
    return key[head][number], code[head][number], pos, size


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by digest, text and place: the repeats, merged by text as far as they are held together."""

    def flush():
        k, c, p, s = _merge_by(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(s.astype(np.int32))], [f.split()[0] for f in _SPANS.split(", ")])

    held, size, last = [], 0, None
    for batch in batches:
        high, low, key, code, spot = (batch.column(i).to_numpy() for i in range(5))
        if not len(high):
            continue
        new = np.ones(len(high), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(high)), 0))
        first_key, first_code = key[head], code[head]
        if last is not None and (high[0], low[0]) == last[:2]:  # the digest of the batch before goes on
            run = head == 0
            first_key[run], first_code[run] = last[2:]
        last = (high[-1], low[-1], first_key[-1], first_code[-1])
        take = (spot & 1 == 1) | (key != first_key) | (code != first_code)
        held.append((key[take], code[take], spot[take] >> 17, (spot[take] >> 1) & 0xFFFF))
        size += int(take.sum())
        if size >= FLUSH:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def text_key(id_col: str, text_col: str) -> list[Column]:
    """64 and 32 bits that stand for a row's id and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(F.col(id_col), text).alias("key"), F.hash(text, F.col(id_col)).alias("code")]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, code, spans): for each text with repeats, its repeated stretches (first word, words), unmerged."""
    rows = docs.select(*text_key(id_col, text_col), F.col(text_col).alias("text")).mapInArrow(_chunk, _ROWS)
    spans = rows.repartition("high", "low").sortWithinPartitions("high", "low", "key", "code", "spot").mapInArrow(_resolve, _SPANS)
    return spans.groupBy("key", "code").agg(F.collect_list(F.struct("pos", "size")).alias("spans"))


def cut_text(text: str, spans: list[dict]) -> tuple[str, int, int]:
    """(text without its repeated stretches, its words, words removed)."""
    raw = text.encode()
    data, off = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    starts, _, _ = tc.word_spans(data, off)
    pos, size = np.array([s["pos"] for s in spans]), np.array([s["size"] for s in spans])
    _, pos, size = _merge(np.zeros(len(pos), np.int64), pos, size)
    long = size >= LEAST_WORDS
    edge = np.append(starts, len(raw))
    out, at = [], 0
    for p, s in zip(pos[long].tolist(), size[long].tolist()):
        out.append(raw[at : edge[p]])
        at = int(edge[p + s])
    out.append(raw[at:])
    return b"".join(out).decode(), len(starts), int(size[long].sum())


def _cut(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = batch.column(batch.num_columns - 1), batch.column(text_at)
            new, total, gone = [], [], []
            for lo in range(0, batch.num_rows, 500):
                for s, t in zip(spans.slice(lo, 500).to_pylist(), texts.slice(lo, 500).to_pylist()):
                    if s and t:
                        t, n, g = cut_text(t, s)
                    else:
                        n, g = -1, 0
                    new.append(t)
                    total.append(n)
                    gone.append(g)
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            cols[text_at] = pa.array(new, pa.string())
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*names, "_words", "_removed"])

    return run


def added_names(names: list[str]) -> tuple[str, str]:
    """The names under which drop_repeats adds the words of a text and the words removed from it."""
    own, lead = {n.lower() for n in names}, "_"
    while {f"{lead}words", f"{lead}removed"} & own:
        lead += "_"
    return f"{lead}words", f"{lead}removed"


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages cut out of the text, plus _words (-1: no repeat found) and _removed, see added_names."""
    names = docs.columns
    tagged = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], *text_key(id_col, text_col))
    found = repeats(docs, id_col, text_col)
    joined = tagged.join(found, ["key", "code"], "left").drop("key", "code")
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    out = joined.mapInArrow(_cut(names.index(text_col)), f"{schema}, _words long, _removed long")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *[F.col(x).alias(y) for x, y in zip(("_words", "_removed"), added_names(names))])
