"""Benchmark decontamination: CGK random walks, bit-sampling LSH, exact edit verification.

Question answered: which benchmark items occur in a text as a run of words within a
word edit distance of floor(0.15 n) of the item's n words (folded A-Z)?

Method.  For every item length, windows of that many words slide over the text.
Each window and item is embedded by CGK random walks: step j emits the current
word and moves on if a hash of (walk, j, word) says so, which turns edit distance
into Hamming distance.  Each repetition draws its own walk and samples two
positions of its output as an LSH key; the number of repetitions is worked out
from the target recall and the least share of output positions that a match within
the bound keeps.  Window and item with an equal key are a candidate, and an exact
dynamic programme (the item against any run of words near the window) decides.

Before embedding, windows that cannot match are skipped without loss: k edits break
at most 3k of the n - 2 three-word runs, and a shift of k words loses k more, so a
window with fewer than n - 2 - 4k runs known from any item is out.

Scale.  Items, a stated query set, go out in blocks of bounded size (BLOCK_WORDS), each block against
all rows; texts are never shuffled, and a row needs only itself, so hot sources or
copies make no hot task.

Defined results: null or blank texts match nothing; items without words match
nothing; items of up to six words match exactly only; repeated rows and repeated
items each give their own rows; of places where an item is equally near the first is
given; texts and items of any length are read as a whole; a null id is reported as null;
ids of items keep their numbers, and are strings if the table has no numbers; an empty
table on either side matches nothing; extra columns of docs, whatever their names, are
not read, and pass through drop_contaminated untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import textcore as tc

EDITS = 0.15
RECALL = 0.95
KEPT = 0.25  # share of embedded positions that survive at the edit bound in items of up to KEPT_WORDS words
KEPT_WORDS = 250  # beyond, walks drift apart as random walks do, and the share falls with the root of the length
SAMPLED = 2
BLOCK_WORDS = 1_000_000


def repetitions(words: int, recall: float = RECALL, sampled: int = SAMPLED) -> int:
    """Walks that find a match of an item of so many words with probability `recall`."""
    kept = KEPT * min(1.0, math.sqrt(KEPT_WORDS / words))
    return math.ceil(math.log(1 - recall) / math.log(1 - kept**sampled))


def bound(n: int) -> int:
    return int(EDITS * n)


def walk_keys(x: np.ndarray, reps: int) -> np.ndarray:
    """LSH keys (rows, reps) of word sequences of equal length (rows, n)."""
    rows, n = x.shape
    steps = 2 * n
    pick = np.sort((tc.seeds(reps * SAMPLED, 7 + n) >> np.uint64(20)).reshape(reps, SAMPLED) % np.uint64(steps), axis=1).astype(np.int64)
    seed = tc.seeds(reps, 1009)[None, :]
    padded = np.concatenate([x, np.zeros((rows, 1), np.uint64)], axis=1)
    at = np.zeros((rows, reps), np.int64)
    keys = np.broadcast_to(tc.seeds(reps, 77)[None, :], (rows, reps)).copy()
    take = np.arange(rows)[:, None]
    stride = tc.seeds(steps, 4099)
    for j in range(int(pick.max()) + 1):
        sym = padded[take, at]
        for s in range(SAMPLED):
            r = np.flatnonzero(pick[:, s] == j)
            if len(r):
                keys[:, r] = tc.mix(keys[:, r] * np.uint64(31) + sym[:, r])
        move = ((sym ^ (seed + stride[j])) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(63)
        at = np.minimum(at + move.astype(np.int64), n)
    return keys


def edit_in(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edit distance of item to any run of words of text, where that run ends)."""
    row = np.zeros(len(text) + 1, np.int64)
    ramp = np.arange(len(text) + 1)
    for i, w in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    end = int(row.argmin())
    return int(row[end]), end


def _member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


class Items:
    """A block of benchmark items, indexed by length and LSH key."""

    def __init__(self, ids: list, texts: list[str]):
        data, off = tc.utf8(pa.array(texts, pa.string()))
        h, first = tc.words(data, off)
        self.words = [h[first[i] : first[i + 1]] for i in range(len(texts))]
        self.ids = ids
        by: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            if len(w):
                by.setdefault(len(w), []).append(i)
        self.lengths = {}
        self.known = {}
        for n, members in sorted(by.items()):
            keys = walk_keys(np.stack([self.words[i] for i in members]), repetitions(n))
            order = np.argsort(keys, axis=0, kind="stable")
            self.lengths[n] = (np.array(members), np.take_along_axis(keys, order, 0), order)
        self.runs = {n: np.unique(np.concatenate([tc.grams(self.words[i], min(3, n)) for i in members])) for n, members in by.items()}
        for g in {min(3, n) for n in by}:
            known = np.unique(np.concatenate([r for n, r in self.runs.items() if min(3, n) == g]))
            bits = np.zeros(1 << 20, bool)
            bits[(known >> np.uint64(44)).astype(np.int64)] = True
            self.known[g] = (known, bits)

    @classmethod
    def of(cls, state: dict) -> Items:
        """From the plain data that is broadcast."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def hits(self, h: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
        """Places whose g words are a run of some item, and those runs."""
        r = tc.grams(h, g)
        known, bits = self.known[g]
        maybe = np.flatnonzero(bits[(r >> np.uint64(44)).astype(np.int64)])
        maybe = maybe[_member(r[maybe], known)]
        return maybe, r[maybe]

    def windows(self, n: int, places: np.ndarray, total: int) -> np.ndarray:
        """Starts of the n-word windows that hold enough of the (rising) places of known runs."""
        g = min(3, n)
        need = max(1, n - g + 1 - 4 * bound(n))
        if len(places) < need:
            return np.zeros(0, np.int64)
        lo, hi = places[: len(places) - need + 1], places[need - 1 :]
        ok = hi - lo <= n - g
        lo, hi = lo[ok], hi[ok]
        step = np.zeros(total + 2, np.int64)
        np.add.at(step, np.maximum(hi - (n - g), 0), 1)
        np.add.at(step, lo + 1, -1)
        return np.flatnonzero(np.cumsum(step)[:total] > 0) if len(lo) else np.zeros(0, np.int64)

    def search(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text number, item number, distance, last word + 1) of every match, best place of each pair."""
        if not len(h):
            return []
        hits = {g: self.hits(h, g) for g in self.known}
        found: dict[tuple[int, int], list[int]] = {}
        for n, (members, keys, order) in self.lengths.items():
            places, runs = hits[min(3, n)]
            s = self.windows(n, places[_member(runs, self.runs[n])], len(h))
            if not len(s):
                continue
            # a window may run past its text's end; the shorter window there keeps the edits in bound
            text = np.searchsorted(first, s, "right") - 1
            padded = np.append(h, np.zeros(n, np.uint64))
            for lo in range(0, len(s), 8192):
                part, tx = s[lo : lo + 8192], text[lo : lo + 8192]
                x = padded[part[:, None] + np.arange(n)]
                x = np.where(part[:, None] + np.arange(n) < first[tx + 1][:, None], x, np.uint64(0))
                mine = walk_keys(x, keys.shape[1])
                for r in range(keys.shape[1]):
                    col = keys[:, r]
                    left = np.searchsorted(col, mine[:, r])
                    right = np.searchsorted(col, mine[:, r], "right")
                    for w in np.flatnonzero(right > left):
                        for m in order[left[w] : right[w], r]:
                            found.setdefault((int(tx[w]), int(members[m])), []).append(int(part[w]))
        out = []
        for (t, i), places in found.items():
            n = len(self.words[i])
            d = bound(n)
            best = None
            places = np.unique(places)
            for block in np.split(places, np.flatnonzero(np.diff(places) > n) + 1):
                lo, hi = max(first[t], block[0] - d), min(first[t + 1], block[-1] + n + d)
                dist, end = edit_in(self.words[i], h[lo:hi])
                if dist <= d and (best is None or dist < best[0]):
                    best = (dist, int(lo - first[t]) + end)
            if best:
                out.append((t, i, *best))
        return out


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The query set in blocks of at most BLOCK_WORDS words (a longer item stands alone)."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).toLocalIterator():
        ids.append(row.i)
        texts.append(row.t)
        size += row.t.count(" ") + 1
        if size >= BLOCK_WORDS:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def _find(shared, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items.of(shared.value)
        for batch in batches:
            rows, which, dist, end = [], [], [], []
            for lo, _, data, off in tc.batches_of(batch):
                for t, i, d, e in items.search(*tc.words(data, off)):
                    rows.append(lo + t)
                    which.append(i)
                    dist.append(d)
                    end.append(e)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([items.ids[i] for i in which], kind), pa.array([len(items.words[i]) for i in which], pa.int64()), pa.array(dist, pa.int64()), pa.array(end, pa.int64())],
                ["doc_id", "item_id", "item_words", "distance", "end_word"],
            )

    return run


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, item_words, distance, end_word): every text and item that match, at the best place."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    number = isinstance(items.schema["item_id"].dataType, IntegralType)
    items = items.select(F.col("item_id").cast("long" if number else "string").alias("item_id"), "text")
    schema = f"doc_id long, item_id {'long' if number else 'string'}, item_words long, distance long, end_word long"
    out = spark.createDataFrame([], schema)
    for block in item_blocks(items):
        found = _find(spark.sparkContext.broadcast(vars(block)), pa.int64() if number else pa.string())
        out = out.union(slim.mapInArrow(found, schema))
    return out


def _filter(shared, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items.of(shared.value)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for lo, _, data, off in tc.batches_of(batch, f"c{text_at}"):
                for t, *_rest in items.search(*tc.words(data, off)):
                    clean[lo + t] = False
            yield batch.filter(pa.array(clean))

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text holds a benchmark item."""
    names = docs.columns
    out = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    schema = out.schema
    for block in item_blocks(items):
        out = out.mapInArrow(_filter(docs.sparkSession.sparkContext.broadcast(vars(block)), names.index(text_col)), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
