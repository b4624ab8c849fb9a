"""Personal data: fixed patterns, and the terms that would still give the found values away.

Method.  Patterns find emails, addresses of machines, card and phone numbers (below).  Each
distinct value is a protected entity c.  A term t is a lower-cased run of digits, letters
and bytes beyond ASCII outside those spans; it goes with c where it is one of the WINDOW
terms before or after a mention.  Over all documents,

    PMI(c; t) = log2(N n(c,t) / (n(c) n(t)))        IC(c) = log2(N / n(c))

with N documents, n(c) and n(t) of them with c and t, and n(c,t) with t beside a mention of
c.  t discloses c if PMI >= ALPHA * IC, that is if seeing t leaves at most 1 - ALPHA of what
c tells, and if at least WINDOWS different windows say so.  In documents that mention c,
such a term beside the mention is a span of kind `term`: it is generalised to its first
STEM characters if the class of all terms with that beginning doesn't disclose c by the
same counts, and otherwise removed.

Patterns (kinds in this order; leftmost, without overlap inside a kind, matches that fail
their test are dropped):

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)    no part above 255
    card   [0-9]([\\x20-]?[0-9])+                    12 to 19 digits that pass Luhn's test
    phone  \\+[0-9][\\x20().0-9-]+[0-9]               9 to 15 digits

They are matched in time linear in the text: an email from its @ to both sides, an address
from the start of a run of digits only.

Scale.  Texts are read by two scans and never shuffled.  What is shuffled are counts
(combined before), a row of 2 * WINDOW term hashes a mention, and the pairs that have
enough windows.  Every join is by spread_join, so an entity that a third of all documents
mention stays spread; a text's spans are worked out once, whatever its copies.

Defined results: null and empty texts have no spans; texts of any length are searched as a
whole; equal texts have equal spans; repeated rows count as documents of their own, but
equal windows as one; an entity that every document mentions has no information to give
away; an empty table gives an empty result; in sanitise() extra columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import fresh_name, materialize, spread_join
from .resampling import GAP

KINDS = ("email", "ip", "card", "phone", "term")
TERM = 4
WINDOW = 10
WINDOWS = 2
ALPHA = 0.8
STEM = 3
CLASS = np.uint64(0x5851F42D4C957F2D)  # sets classes of terms apart from terms
DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ADDRESS = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = np.zeros(256, bool)
LOCAL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")] = True
NOT_DIGIT = bytes(set(range(256)) - set(b"0123456789"))
LEAD = np.ones(256, np.int64)  # bytes of a character by its first one
LEAD[0xC0:0xE0], LEAD[0xE0:0xF0], LEAD[0xF0:] = 2, 3, 4


def luhn(digits: bytes) -> bool:
    d = np.frombuffer(digits, np.uint8)[::-1].astype(np.int64) - 48
    d[1::2] = d[1::2] * 2 - 9 * (d[1::2] > 4)
    return int(d.sum()) % 10 == 0


def _emails(raw: bytes) -> Iterator[tuple[int, int]]:
    done, at = 0, raw.find(b"@")
    while at >= 0:
        start = at
        while start > done and LOCAL[raw[start - 1]]:
            start -= 1
        domain = DOMAIN.match(raw, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = max(done, at)
        at = raw.find(b"@", max(at + 1, done))


def patterns(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the spans of a text in bytes, sorted; all patterns are ASCII."""
    out = [(s, 0, e) for s, e in _emails(raw)]
    for m in ADDRESS.finditer(raw):
        if all(len(x.lstrip(b"0")) <= 3 and int(x.lstrip(b"0") or b"0") <= 255 for x in m[0].split(b".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(raw):
        digits = m[0].translate(None, NOT_DIGIT)
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(raw):
        if 9 <= len(m[0].translate(None, NOT_DIGIT)) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def value(raw: bytes, kind: int, start: int, end: int) -> int:
    """The protected entity as a 64-bit hash: emails lower-cased, numbers by their digits."""
    own = raw[start:end]
    own = own.lower() if kind == 0 else own if kind == 1 else own.translate(None, NOT_DIGIT)
    return int.from_bytes(hashlib.blake2b(bytes([min(kind, 3)]) + own, digest_size=8).digest(), "big", signed=True)


def terms(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of terms and of their classes (all terms with the same first STEM characters)."""
    stop = starts.copy()
    for _ in range(STEM):
        stop = np.where(stop < ends, stop + LEAD[low[np.minimum(stop, max(0, len(low) - 1))]], stop) if len(low) else stop
    stop = np.minimum(stop, ends)
    return tc.run_hash(low, starts, ends).view(np.int64), (tc.run_hash(low, starts, stop) ^ CLASS).view(np.int64)


def _suspects(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text can hold a span at all."""
    digit = (data >= 48) & (data <= 57)
    n = np.zeros(len(data) + 1, np.int64)
    np.cumsum(digit, out=n[1:])
    mark = np.zeros(len(data) + 1, np.int64)
    hit = data == 64
    hit[:-1] |= (data[:-1] == 43) & digit[1:]
    hit[1:-1] |= digit[:-2] & (data[1:-1] == 46) & digit[2:]
    np.cumsum(hit, out=mark[1:])
    return (n[off[1:]] - n[off[:-1]] >= 12) | (mark[off[1:]] > mark[off[:-1]])


SCAN = (
    "digest binary, base array<struct<start:int,kind:int,end:int>>, entity long, at int, first boolean, evidence long, "
    "near array<struct<term:bigint,class:bigint,start:int,end:int,new:boolean,newclass:boolean>>"
)
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_NEAR = pa.list_(pa.struct([("term", pa.int64()), ("class", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("new", pa.bool_()), ("newclass", pa.bool_())]))


def mentions(raw: bytes, spans: list[tuple[int, int, int]], place: np.ndarray) -> Iterator[tuple]:
    """(entity, at, first, evidence, near) of each mention: near are the terms beside it, new where the text first shows them beside its entity."""
    data = np.frombuffer(raw, np.uint8)
    low = tc.FOLD[data]
    starts, ends, _ = tc.word_spans(low, np.array([0, len(low)]), GAP)
    covered = np.zeros(len(data) + 1, np.int64)
    for s, _, e in spans:
        covered[s] += 1
        covered[e] -= 1
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
    free = inside[ends] == inside[starts]
    starts, ends = starts[free], ends[free]
    term, group = terms(low, starts, ends)
    seen, known = set(), set()
    for s, kind, e in spans:
        entity = value(raw, kind, s, e)
        before, after = int(np.searchsorted(ends, s, "right")), int(np.searchsorted(starts, e, "left"))
        beside = [*range(max(0, before - WINDOW), before), *range(after, min(len(starts), after + WINDOW))]
        near = []
        for i in beside:
            t, c = int(term[i]), int(group[i])
            near.append((t, c, int(place[starts[i]]), int(place[ends[i]]), (entity, t) not in seen, (entity, c) not in seen))
            seen.update(((entity, t), (entity, c)))
        evidence = hashlib.blake2b(np.array([x[0] for x in near], np.int64).tobytes(), digest_size=8).digest()
        yield entity, int(place[s]), entity not in known, int.from_bytes(evidence, "big", signed=True), near
        known.add(entity)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document (doc_id, digest, base) and a row a mention (digest, entity, at, first, evidence, near); digest is null where nothing was found."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "digest", "base", "entity", "at", "first", "evidence", "near"]

    def table(ids: pa.Array, digest: list, base: list, rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[None] * len(ids)] * 5
        types = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), _NEAR]
        return pa.RecordBatch.from_arrays([ids, pa.array(digest, pa.binary()), pa.array(base, _SPAN), *(pa.array(list(c), t) for c, t in zip(columns, types))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in tc.batches_of(batch):
                digest, base, rows, owners = [None] * (hi - lo), [[] for _ in range(hi - lo)], [], []
                for i in np.flatnonzero(_suspects(data, off)):
                    own = data[off[i] : off[i + 1]]
                    raw = own.tobytes()
                    spans = patterns(raw)
                    if not spans:
                        continue
                    place = np.zeros(len(own) + 1, np.int64)
                    np.cumsum((own & 0xC0) != 0x80, out=place[1:])
                    digest[i] = hashlib.sha256(raw).digest()
                    base[i] = [(int(place[s]), k, int(place[e])) for s, k, e in spans]
                    for row in mentions(raw, spans, place):
                        rows.append(row)
                        owners.append(digest[i])
                        if len(rows) == 4096:
                            yield table(pa.nulls(len(rows), batch.column(0).type), owners, [None] * len(rows), rows)
                            rows, owners = [], []
                yield table(batch.column(0)[lo:hi], digest, base, [])
                if rows:
                    yield table(pa.nulls(len(rows), batch.column(0).type), owners, [None] * len(rows), rows)

    return slim.mapInArrow(run, f"doc_id {kind}, {SCAN}")


def frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): documents that hold each term, or a term of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in tc.batches_of(batch):
                low = tc.FOLD[data]
                starts, ends, first = tc.word_spans(low, off, GAP)
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for h in terms(low, starts, ends):
                    order = np.lexsort((owner, h))
                    a, b = h[order], owner[order]
                    fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
                    key, n = np.unique(a[fresh], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["term", "n"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def discloses(n: Column, with_c: Column, with_t: Column, both: Column, alpha: float = ALPHA) -> Column:
    """PMI of entity and term against alpha times what the entity tells."""
    known = F.log2(n / with_c)
    return (known > 0) & (F.log2(n * both / (with_c * with_t)) >= alpha * known)


def disclosing(docs: DataFrame, rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, term) of terms and classes that disclose an entity; rows: what scan() gave, written."""
    n = rows.where(F.col("entity").isNull()).count()
    found = rows.where(F.col("entity").isNotNull())
    per = found.groupBy("entity", "evidence").agg(F.sum(F.col("first").cast("long")).alias("c"))
    per = per.groupBy("entity").agg(F.sum("c").alias("n_c"), F.count(F.lit(1)).alias("windows")).where(F.col("windows") >= WINDOWS)
    # the rows of entities with enough windows; no other can disclose anything
    mention = materialize(spread_join(found.select("entity", "evidence", "near"), per.select("entity"), "entity"))
    each = F.transform("near", lambda x: F.struct(x["term"].alias("term"), x["new"].alias("new")))
    wide = F.transform("near", lambda x: F.struct(x["class"].alias("term"), x["newclass"].alias("new")))
    flat = mention.select("entity", "evidence", F.explode(F.concat(each, wide)).alias("x")).select("entity", "evidence", "x.term", F.col("x.new").cast("long").alias("new"))
    pairs = flat.groupBy("entity", "term", "evidence").agg(F.sum("new").alias("b"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("b").alias("n_ct"), F.count(F.lit(1)).alias("windows")).where(F.col("windows") >= WINDOWS).drop("windows")
    pairs = materialize(spread_join(materialize(pairs), per.select("entity", "n_c"), "entity"))
    pairs = spread_join(pairs, frequencies(docs, text_col), "term")
    return pairs.where(discloses(F.lit(float(n)), F.col("n_c"), F.col("n"), F.col("n_ct"))).select("entity", "term")


def term_spans(docs: DataFrame, rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, added: array of (start, kind, end, general)) of the texts in which terms disclose an entity."""
    pair = F.struct("entity", "term").alias("pair")
    bad = materialize(disclosing(docs, rows, text_col).select(pair, F.lit(True).alias("hit")))
    mention = rows.where(F.col("entity").isNotNull()).dropDuplicates(["digest", "at", "entity"])
    flat = mention.select("digest", "entity", F.explode("near").alias("x")).select("digest", "entity", "x.term", "x.class", "x.start", "x.end")
    hit = materialize(spread_join(materialize(flat.withColumn("pair", pair)), bad, "pair").drop("pair", "hit", "term"))
    hit = hit.withColumn("pair", F.struct("entity", F.col("class").alias("term")))
    hit = spread_join(materialize(hit), bad, "pair", "left")
    per = hit.groupBy("digest", "start", "end").agg(F.bool_and(F.col("hit").isNull()).alias("general"))
    span = F.struct("start", F.lit(TERM).alias("kind"), "end", "general")
    return per.groupBy("digest").agg(F.sort_array(F.collect_list(span)).alias("added"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) of every row: arrays of (start, kind, end), in code points, ends exclusive; kinds as in KINDS."""
    rows = materialize(scan(docs, id_col, text_col))
    own = rows.where(F.col("entity").isNull()).select("doc_id", "digest", "base")
    added = term_spans(docs, rows, text_col)
    added = added.select("digest", F.transform("added", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))).alias("added"))
    met = spread_join(own.where(F.col("digest").isNotNull()), added, "digest", "left")
    met = met.select("doc_id", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added"))).alias("spans"))
    return met.union(own.where(F.col("digest").isNull()).select("doc_id", "base", F.col("base").alias("spans")))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kind, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans) of every row."""
    found = find(docs, id_col, text_col)

    def of(kind: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    count = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of its texts replaced: [KIND] for a pattern, the beginning and * for a generalised term, * for a removed one."""
    rows = materialize(scan(docs.withColumn("doc_id", F.lit(None).cast("long")) if "doc_id" not in docs.columns else docs, "doc_id", text_col))
    per = rows.where(F.col("entity").isNull() & F.col("digest").isNotNull()).groupBy("digest").agg(F.first("base").alias("base"))
    per = per.join(term_spans(docs, rows, text_col), "digest", "left")
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit(False).alias("general")))
    per = per.select("digest", F.sort_array(F.concat(base, F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int,general:boolean>>")))).alias("spans"))
    key, spans = fresh_name("digest", docs.columns), fresh_name("spans", docs.columns)
    keyed = docs.withColumn(key, F.coalesce(F.unhex(F.sha2(text_col, 256)), F.lit(b"")))
    met = spread_join(keyed, per.withColumnsRenamed({"digest": key, "spans": spans}), key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = batch.schema.get_field_index(text_col), batch.schema.get_field_index(spans)
            texts, found = batch.column(i).to_pylist(), batch.column(j).to_pylist()
            out = [t if not s else redacted(t, s) for t, s in zip(texts, found)]
            columns = [pa.array(out, batch.schema.field(i).type) if k == i else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return met.mapInArrow(run, met.schema).select(*[f"`{c}`" for c in docs.columns])


def redacted(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in spans:
        if s["end"] <= at:
            continue
        start = max(at, s["start"])
        out.append(text[at:start])
        if s["kind"] == TERM:
            out.append(text[start : start + STEM] + "*" if s["general"] else "*")
        else:
            out.append(f"[{KINDS[s['kind']].upper()}]")
        at = s["end"]
    return "".join(out) + text[at:]
