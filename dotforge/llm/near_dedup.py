"""Near-duplicate groups by Order MinHash, verified by banded alignment.

Method.  A text is the sequence of its five-word k-mers (words folded A-Z), each
labelled with its occurrence number, so every labelled k-mer is unique.  A sketch
entry hashes all labelled k-mers, takes the two smallest and keeps them in text
order: two texts share it only if they share both k-mers in the same order, which
follows edit similarity rather than set overlap.  Two entries make a band; texts
that share a band key are candidates.  A candidate pair is verified by a sparse
alignment of its labelled k-mers inside a diagonal band: the longest rising chain
m of shared k-mers gives the similarity m / (|a| + |b| - m), and links of 0.8 or
more join groups.  With that threshold, aligned k-mers lie at most (|a| + |b|) / 9
diagonals apart, so the band loses nothing.

Scale.  Exact copies collapse first (combined on the map side).  In a band bucket
of any size each member is compared with two centres of the bucket (one global
order, one order of the bucket's own); sixteen bands with independent centres tie
most groups together.  Where members that are no centre still lie in different
components, their texts meet once more by an exact prefix filter: ordered by rarity,
two texts with a similarity of 0.8 share one of the rarest 20 % of their labelled
k-mers, early enough that 0.8 can still be reached.  A k-mer whose texts lie in
several components first compares them with one text of its largest component, in
ROUNDS rounds with other texts, which is linear and joins what belongs together; the
pairs that then still lie in different components are verified one by one.  So no pair
that shares a band key and could join two components goes unverified, and a k-mer
whose texts are all in one component makes no pair.  The order comes from k-mer counts
in SLOTS slots; slots that collide change only the order, never the result.
Stars are salted, so a hot centre is spread over tasks.  Groups are
connected components found by distributed star contraction.  Texts that make up one
row in HOT or more (HOT of them at most) hand out their class by broadcast, so a text
that a third of all rows share is never gathered in one task.

Defined results: null text counts as empty; texts below five words have one k-mer
made of all their words; empty texts are copies of each other; a null doc_id is
kept and is never a class id unless its class has no other; rows repeated in full
share a class, and one of them is kept; of unlike texts that tie for the smallest id,
or that all have a null one, the one with the smallest digest stays; texts of any length
are read as a whole; an empty table gives an empty result; extra columns of any name
pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import fresh_name, materialize, text_digest
from .components import components

K = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 2
SLOTS_LOG = 20  # the k-mer counts that order the prefixes: 2 ** SLOTS_LOG of them, 8 MB
RARE = 8  # counts up to here are not told apart
ROUNDS = 4  # star rounds over k-mers before pairs are verified one by one
HOT = 1000
STAR = 256  # members that one task-side star holds next to its centre


def labelled(words: np.ndarray, k: int = K) -> np.ndarray:
    """Occurrence-labelled k-mers of one text, in text order."""
    if not len(words):
        return np.zeros(0, np.uint64)
    g = tc.grams(words, min(k, len(words)))
    order = np.argsort(g, kind="stable")
    s = g[order]
    new = np.empty(len(s), bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    if new.all():
        return g
    at = np.arange(len(s))
    occ = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(g)
    out[order] = np.where(occ > 0, tc.mix(s + occ.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), s)
    return out


_SEED = tc.seeds(BANDS * ROWS, 11)[:, None]
_ODD = tc.seeds(BANDS * ROWS, 23)[:, None]
_BAND = tc.seeds(BANDS, 37)


def sketch(x: np.ndarray, block: int = 1 << 12) -> np.ndarray:
    """Band keys of one text's labelled k-mers (at least one)."""
    n = len(_SEED)
    low = np.full((n, 2), np.iinfo(np.uint64).max, np.uint64)
    pos = np.zeros((n, 2), np.int64)
    rows = np.arange(n)
    for lo in range(0, len(x), block):
        y = (x[None, lo : lo + block] ^ _SEED) * _ODD
        for _ in range(min(2, y.shape[1])):
            p = y.argmin(1)
            v = y[rows, p]
            y[rows, p] = np.iinfo(np.uint64).max
            better = v < low[:, 1]
            low[better, 1], pos[better, 1] = v[better], p[better] + lo
            swap = low[:, 1] < low[:, 0]
            low[swap], pos[swap] = low[swap][:, ::-1], pos[swap][:, ::-1]
    pos.sort(axis=1)
    entry = tc.mix(x[pos[:, 0]] * np.uint64(3) + tc.mix(x[pos[:, 1]]))
    keys = np.zeros(BANDS, np.uint64)
    for j in range(ROWS):
        keys = tc.mix(keys * np.uint64(31) + entry[j::ROWS])
    return tc.mix(keys + _BAND)


def chain(p: np.ndarray) -> int:
    """Length of the longest rising subsequence."""
    if len(p) < 2 or (p[1:] > p[:-1]).all():
        return len(p)
    from bisect import bisect_left

    tails: list[int] = []
    for v in p.tolist():
        i = bisect_left(tails, v)
        if i == len(tails):
            tails.append(v)
        else:
            tails[i] = v
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Order-preserving overlap of two labelled k-mer sequences; 0.0 once `least` is out of reach."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    need = least / (1 + least) * (len(a) + len(b)) - 1e-9
    if len(ia) < need:
        return 0.0
    order = np.argsort(ia)
    ia, ib = ia[order], ib[order]
    if least > 0:
        ib = ib[np.abs(ia - ib) <= len(a) + len(b) - 2 * need]
    m = chain(ib)
    return m / (len(a) + len(b) - m)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, text) -> (tid, band keys); copies within a batch are sketched once."""
    for batch in batches:
        seen: dict[bytes, int] = {}
        for i, t in enumerate(batch.column(0).to_pylist()):
            seen.setdefault(t, i)
        if len(seen) < batch.num_rows:
            batch = batch.take(pa.array(list(seen.values()), pa.int64()))
        keys = []
        for lo, hi, data, off in tc.batches_of(batch):
            h, first = tc.words(data, off)
            for i in range(hi - lo):
                x = labelled(h[first[i] : first[i + 1]])
                keys.append(sketch(x) if len(x) else np.zeros(0, np.uint64))
        sizes = np.array([len(k) for k in keys])
        flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["tid", "bands"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by star, its centre first: emits the members alike to their centre."""
    star, centre, head = None, None, None
    for batch in batches:
        stars, tids, centres = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        u, v = [], []
        for lo, hi, data, off in tc.batches_of(batch):
            h, first = tc.words(data, off)
            for i in range(hi - lo):
                x = labelled(h[first[i] : first[i + 1]])
                if centres[lo + i]:
                    star, centre, head = stars[lo + i], x, tids[lo + i]
                elif star == stars[lo + i] and similarity(centre, x) >= SIMILARITY:
                    u.append(head)
                    v.append(tids[lo + i])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])


def buckets(texts: DataFrame) -> DataFrame:
    """(key, tid, c1, c2): the members of every band bucket of two texts or more, and its two centres."""
    keys = texts.select("tid", F.explode("bands").alias("key"))
    own = F.struct(F.xxhash64("key", "tid").alias("o"), F.col("tid").alias("t"))
    every = F.struct(F.xxhash64("tid").alias("o"), F.col("tid").alias("t"))
    hubs = (
        keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(own)["t"].alias("c1"), F.min(every)["t"].alias("c2"))
        .where("n > 1").drop("n")
    )
    return keys.join(hubs, "key")


def candidates(met: DataFrame) -> DataFrame:
    """(a, b): every member of a bucket with the bucket's centres; linear in the members."""
    pairs = met.select("tid", F.explode(F.array_distinct(F.array("c1", "c2"))).alias("centre"))
    pairs = pairs.where(F.col("tid") != F.col("centre"))
    return pairs.select(F.least("tid", "centre").alias("a"), F.greatest("tid", "centre").alias("b")).distinct()


def open_texts(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(tid, comp) of the texts that share a bucket with a text of another component, neither of them a centre of it."""
    crowd = met.where((F.col("tid") != F.col("c1")) & (F.col("tid") != F.col("c2"))).select("key", "tid")
    crowd = crowd.join(roots.select(F.col("node").alias("tid"), "root"), "tid", "left").select("key", "tid", F.coalesce("root", "tid").alias("comp"))
    mixed = crowd.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return crowd.join(mixed, "key", "left_semi").select("tid", "comp").distinct()


def _marks(batch: pa.RecordBatch) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(row, labelled k-mers) of the texts of a batch, slice by slice."""
    for lo, hi, data, off in tc.batches_of(batch):
        h, first = tc.words(data, off)
        yield [(lo + i, labelled(h[first[i] : first[i + 1]])) for i in range(hi - lo)]


def _slot(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - SLOTS_LOG)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in _marks(batch):
            slot, n = np.unique(np.concatenate([_slot(x) for _, x in some]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n.astype(np.int64))], ["slot", "n"])


def _prefixes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for some in _marks(batch):
                at, tokens, places, sizes = [], [], [], []
                for i, x in some:
                    n = len(x)
                    x = x[np.lexsort((x, counts[_slot(x)]))][: n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1]
                    at.append(np.full(len(x), i))
                    tokens.append(x)
                    places.append(np.arange(len(x), dtype=np.int32))
                    sizes.append(np.full(len(x), n, np.int32))
                cols = [batch.column(0).take(pa.array(np.concatenate(at)))]
                cols += [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(places)), pa.array(np.concatenate(sizes))]
                yield pa.RecordBatch.from_arrays(cols, ["tid", "token", "place", "size"])

    return run


def prefixes(opened: DataFrame) -> DataFrame:
    """(tid, token, place, size): the rarest k-mers of the texts (tid, text), one of which alike texts share."""
    counts = np.zeros(1 << SLOTS_LOG, np.int64)
    seen = opened.select("text").mapInArrow(_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") > RARE).toArrow()
    counts[seen.column("slot").to_numpy()] = seen.column("n").to_numpy()
    shared = opened.sparkSession.sparkContext.broadcast(counts)
    return opened.select("tid", "text").mapInArrow(_prefixes(shared), "tid binary, token long, place int, size int")


def _reach(x: str, y: str):
    """Whether two texts that share a token at these places can still reach SIMILARITY."""
    a, b = (lambda c: F.col(f"{x}.{c}")), (lambda c: F.col(f"{y}.{c}"))
    return F.least(a("size") - a("place"), b("size") - b("place")) >= SIMILARITY / (1 + SIMILARITY) * (a("size") + b("size")) - 1e-9


def mixed_tokens(tokens: DataFrame, comps: DataFrame) -> DataFrame:
    """(tid, token, place, size, comp) of the tokens whose texts lie in several components."""
    crowd = tokens.join(comps, "tid")
    mixed = crowd.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    return materialize(crowd.join(mixed, "token", "left_semi"))


def _main(crowd: DataFrame, order: str) -> DataFrame:
    """(token, main, lead): the component that holds most texts of each token, and its first text by an order."""
    own = crowd.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.expr(order).alias("o"), "tid", "place", "size")).alias("lead"))
    return own.groupBy("token").agg(F.max(F.struct("n", "comp", "lead")).alias("m")).select("token", F.col("m.comp").alias("main"), F.col("m.lead").alias("y"))


def star_pairs(crowd: DataFrame, turn: int) -> DataFrame:
    """(a, b): the texts of each token with one text of its largest component; linear in the tokens."""
    lead = _main(crowd, "place" if turn == 0 else f"xxhash64(tid, {turn})")
    pairs = crowd.alias("x").join(lead, "token").where((F.col("comp") != F.col("main")) & _reach("x", "y"))
    return pairs.select(F.least("x.tid", "y.tid").alias("a"), F.greatest("x.tid", "y.tid").alias("b")).distinct()


def prefix_pairs(crowd: DataFrame) -> DataFrame:
    """(a, b): texts in different components that share a token and can reach SIMILARITY; loses none."""
    # of two components that meet in a token, one at least is not the token's largest
    few = crowd.join(_main(crowd, "place").select("token", "main"), "token").where(F.col("comp") != F.col("main")).alias("x")
    once = (F.col("y.comp") == F.col("x.main")) | (F.col("x.tid") < F.col("y.tid"))
    pairs = few.join(crowd.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & once & _reach("x", "y"))
    return pairs.select(F.least("x.tid", "y.tid").alias("a"), F.greatest("x.tid", "y.tid").alias("b")).distinct()


def merged(comps: DataFrame, found: DataFrame) -> DataFrame:
    """(tid, comp) after the links (u, v) between texts have joined components."""
    one, two = comps.select(F.col("tid").alias("u"), F.col("comp").alias("cu")), comps.select(F.col("tid").alias("v"), F.col("comp").alias("cv"))
    roots = components(found.join(one, "u").join(two, "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    out = comps.join(roots.select(F.col("node").alias("comp"), "root"), "comp", "left")
    return materialize(out.select("tid", F.coalesce("root", "comp").alias("comp")))


def grouped(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """(node, root) of all texts with a link: the centres first, then what they left open."""
    met = materialize(buckets(bands))
    roots = components(links(rows, candidates(met)))
    comps = materialize(open_texts(met, roots))
    if comps.isEmpty():
        return roots
    opened = materialize(one_each(rows).join(comps.select("tid"), "tid"))
    tokens = materialize(prefixes(opened))
    every = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    turn = 0
    while not (crowd := mixed_tokens(tokens, comps)).isEmpty():
        found = materialize(links(opened, star_pairs(crowd, turn) if turn < ROUNDS else prefix_pairs(crowd)))
        every = every.union(found)
        if turn >= ROUNDS:
            break
        if found.isEmpty():
            turn = ROUNDS
        else:
            comps, turn = merged(comps, found), turn + 1
    return components(every)


def one_each(rows: DataFrame) -> DataFrame:
    """(tid, text) once a text; copies are combined on the map side."""
    return rows.groupBy("tid").agg(F.first("text").alias("text"))


def links(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Verified links (u, v) of the candidate pairs (a, b); rows: (tid, text), copies of a text allowed."""
    pairs = materialize(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    # the endpoint with more pairs is the centre: its text is shipped once per STAR members
    sized = (
        pairs.join(degree.select(F.col("c").alias("a"), F.col("n").alias("na")), "a")
        .join(degree.select(F.col("c").alias("b"), F.col("n").alias("nb")), "b")
    )
    up = F.col("na") >= F.col("nb")
    star = sized.select(
        F.when(up, F.col("a")).otherwise(F.col("b")).alias("c"),
        F.when(up, F.col("b")).otherwise(F.col("a")).alias("tid"),
        F.greatest("na", "nb").alias("n"),
    ).withColumn("salt", F.pmod(F.xxhash64("tid"), F.ceil(F.col("n") / STAR)))
    star = star.withColumn("star", F.xxhash64("c", "salt"))
    need = star.select("tid", "star", F.lit(False).alias("centre")).union(
        star.select(F.col("c").alias("tid"), "star", F.lit(True).alias("centre")).distinct()
    )
    met = need.join(one_each(rows), "tid").select("star", "tid", "centre", "text")
    return met.repartition("star").sortWithinPartitions("star", F.desc("centre")).mapInArrow(_verify, "u binary, v binary")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(tid, class_id, class_size, own_min, own_rows, stays): one row per distinct text.

    class_id is the smallest id of the connected class; class_size counts rows;
    own_min is the smallest id of the text and own_rows the rows that carry it;
    stays marks the one text of the class that is kept.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(text_digest().alias("tid"), "id", "text")
    slim = materialize(rows.groupBy("tid").agg(F.min("id").alias("own_min"), F.count(F.lit(1)).alias("own_rows")))
    rows = rows.select("tid", "text")
    bands = rows.mapInArrow(_bands, "tid binary, bands array<bigint>")
    bands = bands.groupBy("tid").agg(F.first("bands").alias("bands"))
    roots = grouped(rows, materialize(bands))
    slim = slim.join(roots.withColumnRenamed("node", "tid"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    first = F.min(F.struct(F.col("own_min").isNull(), "own_min", "tid"))["tid"]
    classes = slim.groupBy("root").agg(F.min("own_min").alias("class_id"), F.sum("own_rows").alias("class_size"), first.alias("first"))
    stays = (F.col("tid") == F.col("first")).alias("stays")
    return slim.join(classes, "root").select("tid", "class_id", "class_size", "own_min", "own_rows", stays)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, class_id, class_size and whether it is the one that stays."""
    found = materialize(groups(docs, id_col, text_col)).select("tid", "class_id", "class_size", "own_rows", "stays")
    total = found.agg(F.sum("own_rows")).first()[0] or 0
    ids = docs.select(F.col(id_col).alias("doc_id"), text_digest(text_col).alias("tid"))
    # rows repeated in full are counted, and numbered when they are dealt out again
    ids = ids.groupBy("doc_id", "tid").agg(F.count(F.lit(1)).cast("int").alias("times"))
    hot = found.where(F.col("own_rows") * HOT >= total)  # HOT texts at most
    known = [F.col(c).alias(f"hot_{c}") for c in ("class_id", "class_size", "stays")]
    ids = ids.join(F.broadcast(hot.select("tid", *known)), "tid", "left")
    given = F.col("hot_class_size").isNotNull()
    same = ids.where(given).select("doc_id", "times", *[F.col(f"hot_{c}").alias(c) for c in ("class_id", "class_size", "stays")])
    rest = ids.where(~given).select("doc_id", "tid", "times").join(found.where(F.col("own_rows") * HOT < total), "tid")
    out = same.unionByName(rest.select(*same.columns)).withColumn("nth", F.explode(F.sequence(F.lit(1), "times")))
    keep = F.col("stays") & F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("nth") == 1)
    return out.select("doc_id", "class_id", "class_size", keep.alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: the one with the smallest id; among rows that tie, any one."""
    names = docs.columns
    key, tid, cid, dup = (fresh_name(n, names) for n in ("near_key", "near_tid", "near_class", "near_dup"))
    tagged = docs.withColumn(key, text_digest(text_col))
    slim = materialize(groups(docs, id_col, text_col)).where("stays")
    slim = slim.select(F.col("tid").alias(tid), F.col("class_id").alias(cid), (F.col("own_rows") > 1).alias(dup))
    # the id is part of the key, so copies of a text do not meet in one task
    kept = tagged.join(slim, (F.col(key) == F.col(tid)) & F.col(f"`{id_col}`").eqNullSafe(F.col(cid)))
    single = kept.where(~F.col(dup))
    tied = kept.where(F.col(dup)).dropDuplicates([key])
    return single.union(tied).select(*[F.col(f"`{c}`") for c in names])
