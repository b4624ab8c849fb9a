"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Method.  A word enters as the embedding of its hash bucket (word input) beside two
character inputs: the mean embedding of its four-byte pieces and that of its beginnings
of 5 to 8 bytes, which carry stems to unseen forms.  Beside the embeddings stand three
fixed figures: the label log-odds of the word's bucket, and the highest of its pieces'
and of its beginnings'.  Two GRUs read a window of words in both directions, attention
pools their states, and a logistic unit scores the pool.  All windows of WIDTH words,
starting every WIDTH / 2 words, are scored over the whole text, and a text's score
is that of its most toxic window.

Training (numpy, in one task, so that the driver holds no texts) sees a bounded sample of
labelled texts (MOST_TEXTS texts of at most learn.LONGEST bytes).  Log-odds are cross-fitted: while the network
learns from a text, they come from the other FOLDS - 1 parts of the sample, so it learns
what they are worth on unseen texts; scoring uses those of the whole sample.  Each epoch
picks every text's highest window under the current weights (and a random one of each
clean text) and descends on those.  Labels, language, source and ids are never inputs.
The trained weights have a fixed size (about 4 MB) and are broadcast.

Scale.  Scoring maps batches independently; it never shuffles a text.

Defined results: null and blank texts get the score of an empty window; texts of any
length are scored as a whole, window by window; equal texts score alike, and of texts
with several labels the largest counts; without any label of both kinds the score is the
share of toxic training labels (0.0 without labels); an empty table gives an empty
result; extra columns pass through score() and drop_toxic(), and a score column takes one
more leading underscore as long as the input has a column of its name.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import crc_mod, fresh_name
from .learn import Adam, by_row, in_order, labelled_rows, sigmoid

MOST_TEXTS = 3000
WIDTH = 32
HOP = WIDTH // 2
SIZE = 8  # state of one direction
EMBED = 4
INPUTS = 3 * EMBED + 3
BUCKETS = 1 << 16
GRAM = 4
HEADS = (5, 6, 7, 8)
FOLDS = 4
BATCH = 64
STRETCH = 1 << 16  # words or pieces that are counted at a time
SLICE = 1 << 17  # bytes of texts whose words are taken at a time
FEW = 512  # windows that are scored at a time
EPOCHS = 4
LEAST_STEPS = 400  # small samples are gone through more often
EMBED_RATE = 0.05  # embeddings move this much slower than the rest, so that they do not learn texts by heart
PARTS = ("words", "chars", "heads")
THRESHOLD = 0.3


class Words:
    """The words of some texts: bucket of each, buckets of its pieces and of its beginnings (-1: the word is shorter)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.first = tc.word_spans(data, offsets)
        n = len(starts)
        low = np.append(tc.FOLD[data], np.zeros(max(GRAM, *HEADS), np.uint8))
        self.word = (tc.run_hash(low, starts, ends) >> np.uint64(48)).astype(np.int32)
        size = ends - starts
        # pieces of GRAM bytes inside a word, with one closing blank
        pieces = np.maximum(size - GRAM + 2, 1)
        self.at = np.cumsum(pieces) - pieces
        self.count = pieces.astype(np.int32)
        owner = np.repeat(np.arange(n), pieces)
        begin = np.arange(int(pieces.sum())) - self.at[owner] + starts[owner]
        stop, code = ends[owner], np.zeros(len(begin), np.uint32)
        for j in range(GRAM):
            code = code * np.uint32(257) + np.where(begin + j < stop, low[begin + j], np.uint8(32))
        self.piece = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)
        self.head, code = np.full((n, len(HEADS)), -1, np.int32), np.zeros(n, np.uint64)
        for j in range(max(HEADS)):
            code = code * np.uint64(257) + low[starts + j]
            if j + 1 in HEADS:
                bucket = (tc.mix(code * np.uint64(31) + np.uint64(j)) >> np.uint64(48)).astype(np.int32)
                self.head[:, HEADS.index(j + 1)] = np.where(size > j, bucket, -1)

    def __len__(self) -> int:
        return len(self.word)

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, limit: int = SLICE) -> Words:
        """The same, made slice by slice, so that what is needed on the way stays small."""
        cuts = list(tc.slices(offsets, limit))
        if len(cuts) < 2:
            return cls(data, offsets)
        parts = [cls(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in cuts]
        for x in parts:
            del x.at  # counted anew over all
        out = cls.__new__(cls)
        ahead = np.cumsum([0, *(len(x) for x in parts)])
        for name in ("word", "count", "piece", "head"):
            # a part gives up what is taken over
            setattr(out, name, np.concatenate([x.__dict__.pop(name) for x in parts]))
        out.at = np.cumsum(out.count, dtype=np.int64) - out.count
        out.first = np.concatenate([*(x.first[:-1] + n for x, n in zip(parts, ahead)), ahead[-1:]])
        return out

    def pieces_of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of all pieces of the given words, first piece of each)."""
        size = self.count[which]
        at = np.cumsum(size) - size
        return self.piece[np.arange(int(size.sum())) - np.repeat(at, size) + np.repeat(self.at[which], size)], at


def window_starts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of every window, its text); every text has one at least."""
    size = np.diff(first)
    count = np.maximum(1, -(-(size - HOP) // HOP))
    text = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return first[text] + nth * HOP, text


def odds_of(odds: dict, words: Words) -> np.ndarray:
    """Log-odds of each word, its best piece and its best beginning."""
    if not len(words):
        return np.zeros((0, 3), np.float32)
    best = np.where(words.head >= 0, odds["heads"][words.head], np.float32(-2)).max(1)
    best = np.where(words.head[:, 0] >= 0, best, np.float32(0))
    return np.column_stack([odds["words"][words.word], np.maximum.reduceat(odds["chars"][words.piece], words.at), best])


def inputs(model: dict, words: Words, odds: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Word and character inputs of the words lo to hi."""
    if hi <= lo:
        return np.zeros((0, INPUTS), np.float32)
    a, b = words.at[lo], words.at[hi - 1] + words.count[hi - 1]
    chars = np.add.reduceat(model["chars"][words.piece[a:b]], words.at[lo:hi] - a, axis=0) / words.count[lo:hi, None].astype(np.float32)
    return np.concatenate([model["words"][words.word[lo:hi]], chars, heads(model, words.head[lo:hi]), odds[lo:hi]], axis=1)


def heads(model: dict, head: np.ndarray) -> np.ndarray:
    """Mean embedding of the beginnings that a word has."""
    got = model["heads"][head] * (head >= 0)[:, :, None]
    return got.sum(1) / np.maximum((head >= 0).sum(1), 1)[:, None].astype(np.float32)


def run(model: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """x (T, B, INPUTS), mask (T, B) -> logits (B,); with keep also what backward needs.

    Both directions advance together: axis 1 is the direction, and the second reads time reversed.
    """
    steps, n, _ = x.shape
    both = np.stack([x @ model["in"][0], x[::-1] @ model["in"][1]], axis=1) + model["bias"][:, None, :]
    live = np.stack([mask, mask[::-1]], axis=1)[..., None]
    h = np.zeros((2, n, SIZE), np.float32)
    hidden = np.zeros((steps + 1, 2, n, SIZE), np.float32)
    gates = np.zeros((steps, 2, n, 4 * SIZE), np.float32) if keep else None
    u = model["rec"]
    for t in range(steps):
        hu = h @ u
        zr = sigmoid(both[t, :, :, : 2 * SIZE] + hu[..., : 2 * SIZE])
        z, r = zr[..., :SIZE], zr[..., SIZE:]
        new = np.tanh(both[t, :, :, 2 * SIZE :] + r * hu[..., 2 * SIZE :])
        if keep:
            gates[t] = np.concatenate([zr, new, hu[..., 2 * SIZE :]], axis=-1)
        h = h + (1 - z) * (new - h) * live[t]
        hidden[t + 1] = h
    states = np.concatenate([hidden[1:, 0], hidden[:0:-1, 1]], axis=2)
    scores = states @ model["look"]
    scores = np.where(mask > 0, scores, np.float32(-30))
    weights = np.exp(scores - scores.max(0))
    weights *= mask
    weights /= np.maximum(weights.sum(0), np.float32(1e-6))
    pooled = np.einsum("tb,tbh->bh", weights, states)
    logits = pooled @ model["out"] + model["base"][0]
    return (logits, (states, hidden, gates, live, weights, pooled)) if keep else logits


def back(model: dict, x: np.ndarray, mask: np.ndarray, kept, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the recurrent part, and of the inputs."""
    states, hidden, gates, live, weights, pooled = kept
    grads = {"out": pooled.T @ dlogit, "base": np.array([dlogit.sum()], np.float32)}
    dpool = dlogit[:, None] * model["out"]
    gap = np.einsum("tbh,bh->tb", states, dpool)
    dscore = weights * (gap - (weights * gap).sum(0))
    grads["look"] = np.einsum("tb,tbh->h", dscore, states)
    dstates = weights[:, :, None] * dpool + dscore[:, :, None] * model["look"]
    dstates = np.stack([dstates[:, :, :SIZE], dstates[::-1, :, SIZE:]], axis=1)
    z, r, new, hn = (gates[..., i * SIZE : (i + 1) * SIZE] for i in range(4))
    turn = (1 - new * new) * (1 - z) * live
    keepz = (hidden[:-1] - new) * z * (1 - z) * live
    reset = hn * r * (1 - r)
    stay = 1 - (1 - z) * live
    inner, outer = np.empty((*z.shape[:-1], 3 * SIZE), np.float32), np.empty((*z.shape[:-1], 3 * SIZE), np.float32)
    u = model["rec"].transpose(0, 2, 1)
    carry = np.zeros(z.shape[1:], np.float32)
    for t in range(len(z) - 1, -1, -1):
        total = dstates[t] + carry
        dn = total * turn[t]
        rec = np.concatenate([total * keepz[t], dn * reset[t], dn * r[t]], axis=-1)
        outer[t], inner[t] = rec, np.concatenate([rec[..., : 2 * SIZE], dn], axis=-1)
        carry = total * stay[t] + rec @ u
    grads["rec"] = np.einsum("tdbs,tdbg->dsg", hidden[:-1], outer, optimize=True)
    grads["bias"] = inner.sum((0, 2))
    ahead, behind = inner[:, 0], inner[::-1, 1]
    flat = x.reshape(-1, x.shape[2]).T
    grads["in"] = np.stack([flat @ ahead.reshape(-1, 3 * SIZE), flat @ behind.reshape(-1, 3 * SIZE)])
    return grads, ahead @ model["in"][0].T + behind @ model["in"][1].T


def gather(x: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-major windows: inputs (T, B, :), mask (T, B)."""
    place = start[None, :] + np.arange(WIDTH)[:, None]
    mask = (place < stop[None, :]).astype(np.float32)
    place = np.where(mask > 0, place, len(x))
    return np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])[place], mask


def _odds(bucket: np.ndarray, text: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Label log-odds of each bucket by the texts that hold it, shrunk to 0 for rare ones."""
    prior = (y * weight).sum() / weight.sum()
    pos, all_ = np.zeros(BUCKETS), np.zeros(BUCKETS)
    lo = 0
    while lo < len(text):  # texts come one after the other: some at a time
        hi = int(np.searchsorted(text, text[min(len(text), lo + STRETCH) - 1], "right"))
        pair = np.unique(text[lo:hi].astype(np.int64) * BUCKETS + bucket[lo:hi])
        pos += np.bincount(pair % BUCKETS, (y * weight)[pair // BUCKETS], BUCKETS)
        all_ += np.bincount(pair % BUCKETS, weight[pair // BUCKETS], BUCKETS)
        lo = hi
    share = (pos + 4 * prior) / (all_ + 4)
    return (np.log(share / (1 - share + 1e-9)) - np.log(prior / (1 - prior))).clip(-4, 4).astype(np.float32) / 2


def all_odds(words: Words, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """The log-odds tables of a sample; rows of weight 0 count for nothing."""
    held = words.head >= 0
    return {
        "words": _odds(words.word, owner, y, weight), "chars": _odds(words.piece, np.repeat(owner, words.count), y, weight),
        "heads": _odds(words.head[held], np.repeat(owner, held.sum(1)), y, weight),
    }


def train(texts: pa.Array, y: np.ndarray, weight: np.ndarray, seed: int = 5) -> dict:
    """Weights of the network from a labelled sample."""
    rng = np.random.default_rng(seed)
    prior = float((y * weight).sum() / max(1e-9, weight.sum())) if len(y) else 0.0
    if not len(y) or not 0 < y.mean() < 1:
        return {"prior": prior}
    small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    model = {k: small(BUCKETS, EMBED) for k in PARTS}
    model |= {"in": 3 * small(2, INPUTS, 3 * SIZE), "rec": 3 * small(2, SIZE, 3 * SIZE), "bias": np.zeros((2, 3 * SIZE), np.float32)}
    model |= {"look": 3 * small(2 * SIZE), "out": 3 * small(2 * SIZE), "base": np.array([np.log(prior / (1 - prior))], np.float32)}
    words = Words.of(*tc.utf8(texts))
    first = words.first
    owner = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(first))
    fold = rng.permutation(len(y)) % FOLDS
    odds = np.zeros((len(words), 3), np.float32)
    for f in range(FOLDS):
        mine = fold[owner] == f
        rest = weight * (fold != f)
        if mine.any() and 0 < (y * rest).sum() < rest.sum():
            odds[mine] = odds_of(all_odds(words, owner, y, rest), words)[mine]
    adam = Adam(model, 0.01, dict.fromkeys(PARTS, EMBED_RATE))
    starts, text = window_starts(first)
    stops = first[text + 1]
    steps = -(-(len(y) + min(len(y) // 2, int((y[text] == 0).sum()))) // BATCH)
    for epoch in range(max(EPOCHS, -(-LEAST_STEPS // steps))):
        # the untrained network knows nothing: the first windows are those with the highest log-odds
        logits = window_logits(model, words, odds, starts, stops, FEW) if epoch else window_odds(odds, starts, stops)
        order = np.lexsort((logits, text))
        top = order[np.append(text[order][1:] != text[order][:-1], True)]
        clean = np.flatnonzero(y[text] == 0)
        extra = rng.choice(clean, min(len(clean), len(y) // 2), replace=False)
        pick = rng.permutation(np.concatenate([top, extra]))
        for lo in range(0, len(pick), BATCH):
            w = pick[lo : lo + BATCH]
            place = starts[w][None, :] + np.arange(WIDTH)[:, None]
            mask = (place < stops[w][None, :]).astype(np.float32)
            which, slot = np.unique(place[mask > 0], return_inverse=True)
            if not len(which):
                continue
            piece, at = words.pieces_of(which)
            head, size = words.head[which], words.count[which, None].astype(np.float32)
            chars = np.add.reduceat(model["chars"][piece], at, axis=0) / size
            fresh = np.concatenate([model["words"][words.word[which]], chars, heads(model, head), odds[which]], axis=1)
            x = np.zeros((*place.shape, INPUTS), np.float32)
            x[mask > 0] = fresh[slot]
            out, kept = run(model, x, mask, keep=True)
            dlogit = ((sigmoid(out) - y[text[w]]) * weight[text[w]] / len(w)).astype(np.float32)
            grads, dx = back(model, x, mask, kept, dlogit)
            slot, dword = by_row(slot, dx[mask > 0])
            gw, gc, gh = (dword[:, i * EMBED : (i + 1) * EMBED] for i in range(3))
            some = head >= 0
            gh = np.broadcast_to((gh / np.maximum(some.sum(1), 1)[:, None])[:, None, :], (*head.shape, EMBED))
            grads |= {"words": by_row(words.word[which], gw), "chars": by_row(piece, np.repeat(gc / size, words.count[which], axis=0))}
            if some.any():
                grads["heads"] = by_row(head[some], gh[some])
            adam.step(grads)
    tables = all_odds(words, owner, y, weight)
    return {k: v.astype(np.float32) for k, v in model.items()} | {f"{k}_odds": v for k, v in tables.items()} | {"prior": prior}


def window_odds(odds: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Highest sum of a word's log-odds in each window."""
    best = np.full(len(starts), -np.inf)
    total = np.append(odds.sum(1), -np.inf)
    for j in range(WIDTH):
        at = starts + j
        np.maximum(best, total[np.where(at < stops, at, len(odds))], out=best)
    return best


def window_logits(model: dict, words: Words, odds: np.ndarray, starts: np.ndarray, stops: np.ndarray, step: int = 2048) -> np.ndarray:
    """Logit of every window, from the words that a step's neighbouring windows cover."""
    out = []
    for i in range(0, len(starts), step):
        s, e = starts[i : i + step], stops[i : i + step]
        lo, hi = int(s[0]), min(len(words), int(s[-1]) + WIDTH)
        out.append(run(model, *gather(inputs(model, words, odds, lo, hi), s - lo, e - lo)))
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def score_texts(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Score of each text: that of its highest window."""
    n = len(offsets) - 1
    if "out" not in model:
        return np.full(n, model["prior"])
    words = Words(data, offsets)
    starts, text = window_starts(words.first)
    best = np.full(n, -np.inf)
    np.maximum.at(best, text, window_logits(model, words, odds_of({k: model[f"{k}_odds"] for k in PARTS}, words), starts, words.first[text + 1], FEW))
    return sigmoid(best)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_TEXTS) -> dict:
    """Weights learned from a sample of at most `most` labelled texts; only they come to the driver."""
    rows, counts = labelled_rows(docs, labels, "toxic", 4, 2, most)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := list(batches):
            model = train(*in_order(pa.Table.from_batches(got), counts))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)])], ["model"])

    got = rows.repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(got[0].model) if got else {"prior": 0.0}


def score(docs: DataFrame, model: dict, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs plus the toxicity of each whole text (0 to 1), as fresh_name(out_col)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [score_texts(shared.value, data, off) for _, _, data, off in tc.batches_of(batch, f"c{at}", SLICE)]
            got = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(got.astype(np.float64), 6))], [*batch.schema.names, "s"])

    out = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema)
    out = out.mapInArrow(scan, f"{schema}, s double")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("s").alias(fresh_name(out_col, names)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (F.coalesce(crc_mod("doc_id", 4), F.lit(-1)) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text scores THRESHOLD or more."""
    name = fresh_name("score", docs.columns)
    return score(docs, model, text_col, name).where(F.col(name) < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
