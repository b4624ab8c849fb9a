"""Language-model scoring by a hierarchical Pitman-Yor model over words.

Model.  A token is a word (folded A-Z) or the end of its text.  Every word that occurs,
and the end (which stands before a text's first word), is the context of a restaurant,
whose dishes are the tokens that follow it.  All context restaurants share one parent,
the restaurant of single tokens, whose customers are the tables of the contexts.  The
parent is cut into parts by the leading bits of the words' hashes: a part is chosen by
its share of the training tokens, and within a part the base is uniform over its known
words and one unknown word.  So with c customers and t tables,
P(w | u) = (c(u,w) - d t(u,w) + (s + d t(u)) P(w)) / (s + c(u)), and likewise for P(w).

Inference.  Seating is sampled by Gibbs.  A sweep takes all customers of a dish out of
its restaurant and seats them again in turn, given the tables of the other dishes;
seat() takes them one by one, and from the 40th on a twentieth of those seated at a time,
and takes one of DRAWS such seatings by importance weights.
COLOURS classes of dishes take turns, with the restaurants'
tables brought up to date between them.  Discounts follow from the counts of ones and twos,
and strengths are fitted to the seating during the burn-in, both part by part.  After the
burn-in they stand fixed, so that a context's probabilities are linear in its tables: those
at the mean tables, which travel, are the mean of the sweeps' probabilities.  The
parent's probabilities are averaged as such.  A part holds a hash sample of the contexts and seats
the parent along with them, sweep by sweep, on its own tables: a sample of all the parent's
customers, in which the tables of the dish being seated weigh as one part in all.  The
parent that words are scored by is then seated on the tables of all parts.

Scale.  Texts are dealt into blocks of about BLOCK_BYTES.  A block sends, to each part,
the distinct contexts and pairs of its texts with their training counts (0 for pairs
that only held-out texts have), sorted and packed without loss; the part adds them up, seats its
restaurants, and answers with the figures of the same contexts and pairs in the same
order.  So what is gathered grows with the corpus, and a frequent pair costs one entry a
block.  A context that makes up one token in HOT of all texts is split by the hashes of
its dishes into ROOMS rooms that go to different parts, which seat them apart.  The text
is shuffled once.  Words
are told apart by a 64-bit hash, the dishes of one context by its upper half.

Defined results: null text counts as empty and is one end token; a null doc_id is not
held out and is used for learning; without training texts known counts are 0 and the
model falls back to its uniform base; texts of any length are scored as a whole, and a
long one makes its block as large as itself; ties and repeated rows count and are scored
as often as they occur (rows of equal id and text in one block); an empty table gives an empty result; columns other than the id and the
text, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import crc_mod, materialize

SWEEPS = 6
BURN_IN = 3
DRAWS = 8  # seatings of a dish, of which one is taken
SLICE = 1 << 15  # pairs that are seated at a time
FIT_STEPS = 4  # of the strength, after a sweep of the burn-in
COLOURS = 4
BLOCK_BYTES = 10 << 20
PART_BYTES = 16 << 20  # text that one part of the model stands for
FLUSH_TOKENS = 4_000_000
HOT = 500
ROOMS = 256
END = np.uint64(0xFFFFFFFFFFFFFFFF)  # stands for the end token among word hashes
_U32 = np.uint64(32)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, first token of each text); each text closes with END."""
    starts, ends, first = tc.word_spans(data, offsets)
    n = len(offsets) - 1
    word = tc.run_hash(tc.FOLD[data], starts, ends)
    word = np.where(word == END, END - np.uint64(1), word)
    at = np.arange(len(word)) + np.repeat(np.arange(n), np.diff(first))
    token = np.full(len(word) + n, END, np.uint64)
    token[at] = word
    return token, first + np.arange(n + 1)


def text_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """tokens() of a whole column, slice by slice."""
    data, off = tc.utf8(column)
    parts, first = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for lo, hi in tc.slices(off):
        t, f = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        parts.append(t)
        first.append(f[1:] + first[-1][-1])
    return np.concatenate(parts), np.concatenate(first)


# packed columns: bytes of equal weight stand together and are compressed, which loses nothing
def pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1) if len(x) else b""


def unpack(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.decompress(raw) if raw else b"", np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).reshape(-1).view(kind)


def pack_repeated(x: np.ndarray) -> bytes:
    """32-bit values of which most occur often: the distinct ones, commonest first, and the place of each among them."""
    values, at, n = np.unique(x, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    place = np.empty(len(values), np.uint32)
    place[order] = np.arange(len(values), dtype=np.uint32)
    head = pack(values[order])
    return len(head).to_bytes(4, "big") + head + pack(place[at])


def unpack_repeated(raw: bytes, kind) -> np.ndarray:
    end = 4 + int.from_bytes(raw[:4], "big")
    return unpack(raw[4:end], kind)[unpack(raw[end:], np.uint32)]


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


def room(context: np.ndarray, dish: np.ndarray) -> np.ndarray:
    """Key of the room of a split context that serves a dish."""
    return tc.mix(context + (tc.mix(dish) % np.uint64(ROOMS) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def rooms_of(hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all rooms, the context of each), sorted by key."""
    nth = np.arange(1, ROOMS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = tc.mix((hot[:, None] + nth[None, :]).ravel())
    order = np.argsort(keys)
    return keys[order], np.repeat(hot, ROOMS)[order]


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, place of each among them), with no array held longer than needed."""
    order = np.argsort(x, kind="stable")
    x = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    place = np.empty(len(x), np.uint32)
    place[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return x[new], place


class Block:
    """The distinct contexts and pairs of some texts, sorted; the same texts always give the same arrays."""

    def __init__(self, texts: pa.Array, hot: np.ndarray):
        pa.default_memory_pool().release_unused()  # what the block before left
        token, self.first = text_tokens(texts)
        words, self.word = numbered(token)  # every text has an end, so END is the last
        del token
        pair = np.empty(len(self.word), np.uint64)
        pair[1:] = self.word[:-1]
        pair[self.first[:-1]] = max(0, len(words) - 1)
        pair = pair * np.uint64(len(words)) + self.word
        pair, self.pair = numbered(pair)
        context, dish = (pair // np.uint64(max(1, len(words)))).astype(np.int64), (pair % np.uint64(max(1, len(words)))).astype(np.int64)
        del pair
        self.words, self.context_of, self.dish_of = words, context.astype(np.uint32), dish.astype(np.uint32)
        key, dish = words[context], words[dish]
        if len(hot):
            split = np.isin(key, hot)
            key[split] = room(key[split], dish[split])
        dish = (dish >> _U32).astype(np.uint32)
        order = np.lexsort((dish, key))
        self.order = order.astype(np.uint32)  # sorted place -> pair
        key, self.dish = key[order], dish[order]
        rooms = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        self.keys = np.union1d(words, rooms)  # all contexts: words, and rooms of split ones
        self.size = np.bincount(np.searchsorted(self.keys, key), minlength=len(self.keys))
        self.is_word = np.isin(self.keys, words)

    def counts(self, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(training count of each context, of each pair), in sorted order; trained: a flag a text."""
        use = np.repeat(trained, np.diff(self.first))
        n = np.zeros(len(self.keys), np.int64)
        n[self.is_word] = np.bincount(self.word[use], minlength=len(self.words))
        return n, np.bincount(self.pair[use], minlength=len(self.order))[self.order]


_MESSAGE = "part long, block long, keys binary, n binary, size binary, dish binary, m binary"


def part_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _message(shared, bits: int):
    def run(table: pa.Table) -> pa.Table:
        b = Block(table["text"], shared.value)
        n, m = b.counts(~table["held_out"].to_numpy())
        ends = np.cumsum(b.size)
        part = part_of(b.keys, bits)
        cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        rows = []
        for lo, hi in zip(cut, np.append(cut[1:], len(part))):
            p, q = ends[lo] - b.size[lo], ends[hi - 1]
            rows.append((
                int(part[lo]), pack_sorted(b.keys[lo:hi]), pack(n[lo:hi].astype(np.uint32)), pack(b.size[lo:hi].astype(np.uint32)),
                pack(b.dish[p:q]), pack(m[p:q].astype(np.uint32)),
            ))
        cols = list(zip(*rows))
        block = pa.array(np.full(len(rows), table["block"][0].as_py()), pa.int64())
        return pa.table([pa.array(cols[0], pa.int64()), block, *(pa.array(c, pa.binary()) for c in cols[1:])], ["part", "block", "keys", "n", "size", "dish", "m"])

    return run


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    low, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        small = y < 8
        low += np.where(small, 1 / np.where(small, y, 1.0), 0.0)
        y = np.where(small, y + 1, y)
    r = 1 / (y * y)
    return np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r / 252)) - low


def seat(
    count: np.ndarray, other: np.ndarray, parent: np.ndarray, discount: float, strength: float, rng: np.random.Generator, slope: np.ndarray | None = None, draws: int = 1
) -> np.ndarray:
    """Tables that `count` customers of one dish take, seated in turn, per row; other: the restaurant's tables of other dishes.

    With j seated at t tables, the next one opens a table with odds a : j - d t, where a is
    (strength + d * all tables) * (parent + slope * t): the tables opened so far are customers of the parent.
    A step seats a twentieth of those seated, and one at least; more than one at a time open
    tables with the probability halfway through the step.  Seating in turn looks at no later
    customer, so it is off the posterior by the product of a + j - d t over the steps: of
    several draws one is taken with odds in that proportion.
    """
    slope = np.zeros(len(count)) if slope is None else slope
    out = np.minimum(count, 1).astype(np.int64)
    for lo in range(0, len(count), SLICE):
        at = slice(lo, lo + SLICE)
        own, p0, more, rest = count[at], parent[at], slope[at], strength + discount * other[at]
        tables = np.tile(out[at], (draws, 1))
        weight = np.zeros(tables.shape)
        live, seated = np.flatnonzero(own > 1), 1
        while len(live):
            t, p, up, r = tables[:, live], p0[live], more[live], rest[live]
            add = np.minimum(own[live] - seated, max(1, seated // 20))

            def odds(j, t):
                opened = (r + discount * t) * np.minimum(p + up * t, 1.0)
                return opened, opened + np.maximum(j - discount * t, 1e-9)

            new, every = odds(seated, t)
            if seated >= 40:
                new, every = odds(seated + (add - 1) / 2, t + new / every * (add - 1) / 2)
                t += rng.binomial(add, np.minimum(new / every, 1.0))
            else:
                t += rng.random(t.shape) * every < new
            tables[:, live] = t
            if draws > 1:
                weight[:, live] += add * np.log(every)
            seated += max(1, seated // 20)
            live = live[own[live] > seated]
        # the largest of the weights' logarithms with Gumbel noise falls on each draw with odds in proportion to its weight
        pick = (weight - np.log(-np.log(rng.random(weight.shape)))).argmax(0) if draws > 1 else np.zeros(len(own), np.int64)
        out[at] = tables[pick, np.arange(len(own))]
    return out


def discount_of(count: np.ndarray) -> float:
    ones, twos = int((count == 1).sum()), int((count == 2).sum())
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones else 0.5


def fit_strength(strength: float, discount: float, customers: np.ndarray, tables: np.ndarray) -> float:
    """One step towards the strength under which the restaurants' tables are likeliest (a gamma(2, 1) prior)."""
    some = customers > 1
    if not some.any():
        return strength
    c, t = customers[some].astype(np.float64), np.maximum(tables[some], 1).astype(np.float64)
    opened = strength / discount * (digamma(strength / discount + t) - digamma(np.array([strength / discount + 1])))
    return float(np.clip((1 + opened.sum()) / (1 + (digamma(strength + c) - digamma(np.array([strength + 1]))).sum()), 0.01, 100))


def seat_part(context: np.ndarray, dish: np.ndarray, count: np.ndarray, customers: np.ndarray, scale: np.ndarray, parts: int, seed: list[int]) -> tuple[np.ndarray, float, float]:
    """(mean tables of each pair, discount, strength) of a part's restaurants.

    context and dish of each pair as numbers from 0, count > 0; customers and scale of each
    context: the tables of a context of which the part holds some rooms stand for scale times as many.
    """
    rng = np.random.default_rng(seed)
    discount, strength = discount_of(count), 1.0
    tables, kept = np.minimum(count, 1), np.zeros(len(count))
    contexts, dishes = len(customers), int(dish.max()) + 1 if len(dish) else 0
    unsplit = scale == 1
    above, above_strength = np.ones(dishes, np.int64), 1.0  # the parent's tables, seated on the tables of the part
    colour = dish % COLOURS
    many = [np.flatnonzero((count > 1) & (colour == k)) for k in range(COLOURS)]
    for sweep in range(SWEEPS if len(count) else 0):
        taken = np.bincount(dish, tables, dishes).astype(np.int64)
        above_discount = discount_of(taken)
        above = seat(taken, above.sum() - above, np.full(dishes, 1 / (dishes + 1)), above_discount, above_strength, rng, draws=DRAWS)
        above_strength = fit_strength(above_strength, above_discount, taken.sum(keepdims=True), above.sum(keepdims=True))
        everyone = above_strength + taken.sum()
        back = (above_strength + above_discount * above.sum()) / everyone / (dishes + 1)
        left = (1 - above_discount * above / np.maximum(taken, 1)) / everyone  # what each table of a dish adds to its probability
        for at in many:
            if not len(at):
                continue
            own = tables[at]
            whole = np.bincount(context, tables, contexts)[context[at]] * scale[context[at]] - own
            served = np.bincount(dish, tables, dishes)[dish[at]] - own
            each = left[dish[at]]
            tables[at] = seat(count[at], whole, each * served + back, discount, strength, rng, each / parts, DRAWS)
        if sweep >= BURN_IN:
            kept += tables
            continue
        all_tables = np.bincount(context, tables, contexts)[unsplit]
        for _ in range(FIT_STEPS):
            strength = fit_strength(strength, discount, customers[unsplit], all_tables)
    return kept / (SWEEPS - BURN_IN), discount, strength


# kind 0: words of a part (keys, n, left, strength); 1: customers that a part's tables take from words (keys: dishes, own); 2: an answer
_SEATED = "part long, kind int, block long, keys binary, n binary, own binary, strength double"
_SEATED_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]


def _columns(rows: list, schema: str, kinds: list) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in schema.split(", ")])


def _seat(shared, bits: int):
    def run(table: pa.Table) -> pa.Table:
        """All messages to one part -> its words, what its tables take from the words of all parts, and an answer a block."""
        part = table["part"][0].as_py()
        rooms, owner = rooms_of(shared.value)  # a table of HOT * ROOMS entries at most
        got = {c: table[c].to_pylist() for c in ("keys", "n", "size", "dish", "m")}
        keys = [unpack_sorted(x) for x in got["keys"]]
        n, size, dish, m = ([unpack(x, np.uint32) for x in got[c]] for c in ("n", "size", "dish", "m"))
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        customers = np.bincount(place, np.concatenate(n), len(every)).astype(np.int64)
        pair = (np.repeat(place, np.concatenate(size)).astype(np.uint64) << _U32) | np.concatenate(dish).astype(np.uint64)
        pairs, at = np.unique(pair, return_inverse=True)
        count = np.bincount(at, np.concatenate(m), len(pairs)).astype(np.int64)
        del pair
        context = (pairs >> _U32).astype(np.int64)
        half, served = np.unique(pairs & np.uint64(0xFFFFFFFF), return_inverse=True)
        base = np.searchsorted(rooms, every)
        is_room = np.zeros(len(every), bool)
        if len(rooms):
            is_room = rooms[np.minimum(base, len(rooms) - 1)] == every
        known = np.flatnonzero(count)
        # rooms of one context are one restaurant, which stands for all its rooms by the share that this part has, empty ones included
        whose = every.copy()
        whose[is_room] = owner[base[is_room]]
        restaurants, restaurant = np.unique(whose, return_inverse=True)
        scale = np.ones(len(restaurants))
        if is_room.any():
            here = owner[part_of(rooms, bits) == part]
            held = np.searchsorted(np.sort(here), restaurants, "right") - np.searchsorted(np.sort(here), restaurants)
            split = np.unique(restaurant[is_room])
            scale[split] = ROOMS / held[split]
        seated = np.bincount(restaurant[context[known]], count[known], len(restaurants)).astype(np.int64)
        mean, discount, strength = seat_part(restaurant[context[known]], served[known], count[known], seated, scale, 1 << bits, [11, part])
        tables = np.zeros(len(pairs))
        tables[known] = mean
        own = np.maximum(count - discount * tables, 0).astype(np.float32)
        left = np.bincount(context, count - own.astype(np.float64), len(every))  # with what 32 bits cut off, so that all still adds up
        rows = []
        # what a room leaves goes to its context's part, what the tables take from words to the words' parts
        sent = [(owner[np.minimum(base, len(rooms) - 1)][is_room], left[is_room], 3)] if is_room.any() else []
        less = np.bincount(served, count - tables, len(half))
        sent.append((half[less > 0] << _U32, less[less > 0], 1))
        for key, value, kind in sent:
            order = np.argsort(key)
            key, value, to = key[order], value[order].astype(np.float32), part_of(key[order], bits)
            cut = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else []
            rows += [(int(to[lo]), kind, part, pack_sorted(key[lo:hi]), None, pack_repeated(value[lo:hi]), 0.0) for lo, hi in zip(cut, [*cut[1:], len(to)])]
        word = np.flatnonzero(~is_room & (customers > 0))
        rows.append((part, 0, -1, pack_sorted(every[word]), pack(customers[word].astype(np.int64)), pack_repeated(left[word].astype(np.float32)), strength))
        lo = 0
        for block, k, d in zip(table["block"].to_pylist(), keys, dish):
            rows.append((part, 2, block, pack_sorted(k), None, pack_repeated(own[at[lo : lo + len(d)]]), 0.0))
            lo += len(d)
        return _columns(rows, _SEATED, _SEATED_TYPES)

    return run


_ANSWER = "block long, part long, n binary, left binary, strength double, parent binary, own binary"
_ANSWER_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.binary(), pa.binary()]


def parent_of(customers: np.ndarray, share: float, seed: list[int]) -> tuple[np.ndarray, float]:
    """(P(w) of each word of a part, P of a word unknown to it) from its tables in all contexts."""
    v = len(customers)
    base = 1 / (v + 1)
    c = np.maximum(np.round(customers), 1).astype(np.int64)
    discount, strength, rng = discount_of(c), 1.0, np.random.default_rng(seed)
    tables, p, unknown, kept = np.minimum(c, 1), np.zeros(v), 0.0, 0
    for sweep in range(SWEEPS):
        if v:
            tables = seat(c, tables.sum() - tables, np.full(v, base), discount, strength, rng, draws=DRAWS)
            strength = fit_strength(strength, discount, np.array([c.sum()]), np.array([tables.sum()]))
        if sweep >= BURN_IN:
            back = (strength + discount * tables.sum()) / (strength + c.sum()) * base
            p += np.maximum(c - discount * tables, 0) / (strength + c.sum()) + back
            unknown += back
            kept += 1
    return share * p / kept, share * unknown / kept


def _answer(total: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        """What _seat sent to one part -> its answer to each block."""
        part = table["part"][0].as_py()
        rows = list(zip(*(table[c].to_pylist() for c in ("kind", "block", "keys", "n", "own", "strength"))))
        words, n, left, strength = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0), 1.0
        for kind, _, k, c, own, s in rows:
            if kind == 0:
                words, n, left, strength = unpack_sorted(k), unpack(c, np.int64), unpack_repeated(own, np.float32).astype(np.float64), s
        customers = n.astype(np.float64)
        # in a fixed order, so that sums do not depend on what arrives first
        for kind, _, k, _, own, _ in sorted((r for r in rows if r[0] in (1, 3)), key=lambda r: r[:2]):
            k, value = unpack_sorted(k), unpack_repeated(own, np.float32)
            at = np.minimum(np.searchsorted(words, k), max(0, len(words) - 1))
            ok = (words[at] >> _U32) == (k >> _U32) if len(words) else np.zeros(len(k), bool)
            np.add.at(customers if kind == 1 else left, at[ok], -value[ok] if kind == 1 else value[ok])
        share = (int(n.sum()) + 1) / (total + (1 << bits))
        parent, unknown = parent_of(customers, share, [13, part])
        out = []
        for kind, block, k, _, own, _ in rows:
            if kind == 2:
                k = unpack_sorted(k)
                at = np.minimum(np.searchsorted(words, k), max(0, len(words) - 1))
                ok = words[at] == k if len(words) else np.zeros(len(k), bool)
                pick = lambda x, other: np.where(ok, x[at], other) if len(words) else np.full(len(k), other)
                out.append((
                    block, part, pack(pick(n, 0).astype(np.int64)), pack_repeated(pick(left, 0.0).astype(np.float32)), strength,
                    pack_repeated(pick(parent, unknown).astype(np.float32)), own,
                ))
        return _columns(out, _ANSWER, _ANSWER_TYPES)

    return run


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pair_probabilities(b: Block, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(P of each pair of a block, training count of each of its words) from the answers of all parts that it has words in."""
    answers = answers.sort_by("part")
    both = lambda c: np.concatenate([np.zeros(0, np.float32), *(unpack_repeated(x, np.float32) for x in answers[c].to_pylist())])
    at = np.searchsorted(b.keys, b.words)
    counts = [unpack(x, np.int64) for x in answers["n"].to_pylist()]
    n, left, parent = np.concatenate([np.zeros(0, np.int64), *counts])[at], both("left")[at].astype(np.float64), both("parent")[at].astype(np.float64)
    strength = np.repeat(answers["strength"].to_numpy(), [len(x) for x in counts])[at]
    own = np.empty(len(b.order))
    own[b.order] = both("own")
    u = b.context_of
    return (own + (strength[u] + left[u]) * parent[b.dish_of]) / (strength[u] + n[u]), n


def _score(shared, total: int, distinct: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(docs["text"], shared.value)
        p, n = pair_probabilities(b, answers)
        head = b.first[:-1]
        # a figure a word or pair first, then one text's at a time
        base = np.log10((n + 0.5) / (total + 0.5 * (distinct + 1)))
        return pa.table({
            "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": np.diff(b.first), "n_known": np.add.reduceat((n > 0).astype(np.int64)[b.word], head),
            "train_tokens": np.full(len(head), total), "base_score": np.add.reduceat(base[b.word], head), "score": np.add.reduceat(np.log10(p)[b.pair], head),
        })

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> (word, n), added up over FLUSH_TOKENS tokens."""

    def flush(parts):
        w, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["word", "n"])

    held, size = [], 0
    for batch in batches:
        for _, _, data, off in tc.batches_of(batch):
            held.append(tokens(data, off)[0])
            size += len(held[-1])
            if size >= FLUSH_TOKENS:
                yield flush(held)
                held, size = [], 0
    if size:
        yield flush(held)


def _word_sets(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """text -> (part, its distinct words packed, tokens), over FLUSH_TOKENS tokens."""
        for b in _word_counts(batches):
            words = b.column(0).to_numpy().view(np.uint64)
            n, order = b.column(1).to_numpy(), np.argsort(words)
            words, part = words[order], part_of(words[order], bits)
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            sets = [pack_sorted(words[lo:hi]) for lo, hi in zip(cut, np.append(cut[1:], len(part)))]
            yield pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array(sets, pa.binary()), pa.array(np.add.reduceat(n[order], cut))], ["part", "words", "n"])

    return run


def _sizes(table: pa.Table) -> pa.Table:
    words = np.concatenate([unpack_sorted(x) for x in table["words"].to_pylist()])
    return pa.table({"n": [sum(table["n"].to_pylist())], "v": [len(np.unique(words))]})


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the words that make up one token in 8 HOT of a flush, and of all its tokens as word 0."""
    for b in _word_counts(batches):
        n = b.column(1).to_numpy()
        often = pa.array(np.flatnonzero(n * (8 * HOT) >= n.sum()))
        yield b.take(often)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([int(n.sum())], pa.int64())], b.schema.names)


def hot_contexts(rows: DataFrame) -> np.ndarray:
    """Words that make up one token in HOT of all texts: HOT of them at most, and the same however the rows are dealt.

    A first scan sends on what is frequent in a flush, which leaves out less than one token in
    8 HOT of any word.  So every hot word has 7 / (8 HOT) of the tokens there, as 8 HOT / 7
    words at most can have; a second scan counts those exactly.
    """
    counts = rows.select("text").mapInArrow(_frequent, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    seen = materialize(counts)
    first = seen.where(F.col("word") == 0).first()
    total = first.n if first else 0
    maybe = np.array(sorted(r.word for r in seen.where((F.col("word") != 0) & (F.col("n") * (8 * HOT) >= 7 * total)).collect()), np.int64)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _word_counts(batches):
            yield b.take(pa.array(np.flatnonzero(np.isin(b.column(0).to_numpy(), maybe))))

    got = rows.select("text").mapInArrow(exact, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return np.array(sorted(r.word % (1 << 64) for r in got if r.n * HOT >= total), np.uint64)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from rows not held out."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False))
    rows = rows.withColumn("held_out", out)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(size // part_bytes).bit_length())
    sets = rows.where(~F.col("held_out")).select("text").mapInArrow(_word_sets(bits), "part long, words binary, n long")
    sizes = sets.groupBy("part").applyInArrow(_sizes, "n long, v long")
    total, distinct = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    blocks = int(size // block_bytes) + 1
    hot = spark.sparkContext.broadcast(hot_contexts(rows))
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), blocks).alias("block"), "doc_id", "text", "held_out").repartition("block")
    sent = dealt.groupBy("block").applyInArrow(_message(hot, bits), _MESSAGE)
    seated = sent.groupBy("part").applyInArrow(_seat(hot, bits), _SEATED)
    answers = seated.groupBy("part").applyInArrow(_answer(total, bits), _ANSWER)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(hot, total, distinct), _OUT)
