"""WARC archives as chunked record tables.

Writing.  A payload of more than CHUNK bytes becomes several rows (record identifier,
chunk number), each a WARC/1.1 segment: the first is the response (or revisit) record
with WARC-Segment-Number 1, the others are continuation records.  Payloads are cut into
segments in one pass, between code points; a task holds one batch of rows, which Spark
bounds by bytes, and a segment beyond it.  The files are gzipped .warc text written by
Spark's own text writer, with its commit protocol, into the shared folder.  A file is
one gzip stream, not one a record, so archives are read from their start.

Equal payloads of REVISIT bytes or more (same SHA-256) have one response, the one with
the smallest page_id; the others are revisit records that refer to it and carry no
payload but keep its digest and length.  The smallest id of each digest is combined on
the map side.  What a row is then follows in three ways, so that payloads stay where
they are read as far as possible:
* the digests that hold at least one row in HOT of all rows (HOT of them at most) are
  broadcast with their smallest ids, so a payload that a third of all pages share is
  never gathered in one task;
* a row whose digest is not in a Bloom filter of the other recurring digests (at most
  2 ** FILTER_LOG bits) has no equal and is a response;
* only the rows that are left, copies but for rare accidents of the filter, meet the
  recurring digests in an equi-join, with no key above one row in HOT.

Reading.  Archives are read as a stream of lines ended by the blank lines that close
headers and records, never as whole files; records are parsed by Content-Length into
rows of the chunked record table (record_id, chunk, data).  A record of one chunk is
checked where it is parsed and its data goes no further; the chunks of segmented records
are shuffled, sorted by record and chunk, and streamed through incremental SHA-256 and
length counters that carry over from row to row and batch to batch.

Defined results: null payload counts as empty; a null page_id is written as such and
read back as null (and is smallest only if all of its group are null: then all are
responses); rows repeated in full keep their own records, and all rows that tie for the
smallest page_id of their payload are responses; payloads of any length are cut into
segments and read back whole; empty input writes an empty archive; other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch

CHUNK = 1 << 16
REVISIT = 100
HOT = 1000
FILTER_LOG = 26  # 8 MB
FILTER_BITS = 12  # bits a digest
END = "\r\n\r\n"
_DATE = "1970-01-01T00:00:00Z"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _places(digest, size: int) -> list[np.ndarray]:
    """Bits of the filter that stand for SHA-256 digests in hex: three numbers out of each."""
    words = np.frombuffer(bytes.fromhex("".join(digest)), ">u8").reshape(-1, 4)
    return [words[:, j].astype(np.uint64) % np.uint64(size) for j in range(3)]


def recurring_filter(digests: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter, as bytes, of n distinct digests; its bits are set in tasks and joined by OR."""
    size = 1 << max(10, min(FILTER_LOG, (FILTER_BITS * max(1, n) - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 64, np.uint64)
        for batch in batches:
            for at in _places(batch.column(0).to_pylist(), size):
                np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        some = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(bits[some].view(np.int64))], ["i", "w"])

    got = digests.mapInArrow(run, "i long, w long").groupBy("i").agg(F.bit_or("w").alias("w")).toArrow()  # size / 64 rows at most
    out = np.zeros(size // 64, np.int64)
    out[got["i"].to_numpy()] = got["w"].to_numpy()
    return out.view(np.uint64)


def _maybe(spark: SparkSession, bits: np.ndarray):
    shared = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def maybe(digest: pd.Series) -> pd.Series:
        words = shared.value
        ok = np.ones(len(digest), bool)
        for at in _places(digest.tolist(), 64 * len(words)):
            ok &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return pd.Series(ok)

    return maybe


def records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of every row."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)})
    counts = rows.groupBy("payload_digest").agg(F.min("page_id").alias("lead"), F.count(F.lit(1)).alias("n"), F.first("payload_bytes").alias("size"))
    first = materialize(counts.where((F.col("n") > 1) & (F.col("size") >= REVISIT)).drop("size"))  # one narrow row a recurring digest
    total = pages.count()
    hot = first.where(F.col("n") * HOT >= total).drop("n")  # HOT rows at most
    cold = first.where(F.col("n") * HOT < total).drop("n")
    typed = rows.join(F.broadcast(hot), "payload_digest", "left")
    n = cold.count()
    if n:
        maybe = _maybe(pages.sparkSession, recurring_filter(cold.select("payload_digest"), n))
        typed = typed.withColumn("maybe", F.col("lead").isNull() & maybe("payload_digest"))
        met = typed.where("maybe").drop("lead", "maybe").join(cold, "payload_digest", "left")
        typed = typed.where(~F.col("maybe")).drop("maybe").unionByName(met)
    again = F.col("lead").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("lead"))
    return typed.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("lead")).alias("refers_to"),
    )


def _cuts(raw: memoryview, chunk: int) -> list[int]:
    """Bounds of pieces of at most `chunk` bytes, none of them inside a code point; an empty payload is one piece."""
    at = [0]
    while len(raw) - at[-1] > chunk:
        stop = at[-1] + chunk
        while raw[stop] & 0xC0 == 0x80:
            stop -= 1
        at.append(stop)
    return [*at, len(raw)]


def _header(*pairs: tuple[str, object]) -> bytes:
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in pairs if v is not None), "\r\n"]).encode()


def _segment(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (uid, page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) -> segments of WARC records."""
        for batch in batches:
            out, held = [], 0
            uids, pages, urls = (batch.column(i).to_pylist() for i in range(3))
            sizes, digests, kinds, refers = (batch.column(i).to_pylist() for i in range(4, 8))
            for i, uid in enumerate(uids):
                again = kinds[i] == "revisit"
                raw = memoryview(b"" if again else batch.column(3)[i].as_buffer())
                cuts = _cuts(raw, chunk)
                count, urn = len(cuts) - 1, f"<urn:dotforge:{uid}>"
                # a url is one header line: control characters are percent-encoded
                url = urls[i] and urls[i].replace("\r", "%0D").replace("\n", "%0A")
                for nth in range(1, count + 1):
                    part = raw[cuts[nth - 1] : cuts[nth]]
                    if nth == 1:
                        head = [("WARC-Type", kinds[i]), ("WARC-Record-ID", urn), ("WARC-Date", _DATE), ("WARC-Target-URI", url), ("WARC-Profile", _REVISIT_PROFILE if again else None)]
                        head += [("WARC-Refers-To-Page", refers[i]), ("WARC-Payload-Digest", f"sha256:{digests[i]}"), ("WARC-Page-ID", pages[i]), ("WARC-Payload-Length", sizes[i])]
                    else:
                        head = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:dotforge:{uid}.{nth}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", urn)]
                    if count > 1:
                        head += [("WARC-Segment-Number", nth), ("WARC-Segment-Total-Length", sizes[i] if nth == count else None)]
                    out.append(b"".join([_header(*head, ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(part))), part]))
                    held += len(out[-1])
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["segment"])
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["segment"])

    return run


def segments(recs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(segment): the text of every WARC segment record, without the blank lines that end it."""
    uid = F.md5(F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.col("payload_digest"), F.monotonically_increasing_id()))
    payload = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("payload")).cast("binary")
    rows = recs.select(uid.alias("uid"), "page_id", "url", payload.alias("payload"), "payload_bytes", "payload_digest", "record_type", "refers_to")
    return rows.mapInArrow(_segment(chunk), "segment string")


def write(recs: DataFrame, path: str, chunk: int = CHUNK, rows_per_file: int = 2000) -> None:
    """Writes gzipped .warc text files; rows_per_file bounds a file to about rows_per_file * chunk bytes before compression."""
    segments(recs, chunk).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", rows_per_file).text(path)


_CHUNKS = "record_id string, chunk int, page_id long, record_type string, refers_to long, length long, digest string, whole boolean, data binary"


def parse(pieces: Iterator[memoryview | bytes]) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of every record of a stream of archive text, given in pieces of any size; holds one record at most."""
    held, end, head, size = bytearray(), END.encode(), None, 0
    for piece in pieces:
        held += piece
        while True:
            if head is None:
                # a block that ends in a line break leaves the last line of its file open: blank lines before a record are skipped
                del held[: len(held) - len(held.lstrip(b"\r\n"))]
                stop = held.find(end)
                if stop < 0:
                    break
                lines = held[:stop].decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no WARC record where one is due: {lines[0][:80]!r}")
                head = dict(line.split(": ", 1) for line in lines[1:])
                size = int(head["Content-Length"])
                del held[: stop + len(end)]
            if len(held) < size + len(end):
                break
            block = bytes(held[:size])
            del held[: size + len(end)]
            yield head, block
            head = None
    if head is not None or held:
        raise ValueError("the archive ends within a record")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of one or more archives, in order: each archive ends where a record ends, so no file needs to be told from the next."""
    schema = [f.split()[0] for f in _CHUNKS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    num = lambda h, k: int(h[k]) if k in h else None
    end = END.encode()
    lines = (x for batch in batches for v in batch.column(0) for x in (v.as_buffer(), end))
    rows, size = [], 0
    for h, block in parse(lines):
        origin = h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"])
        digest = h.get("WARC-Payload-Digest")
        rows.append((origin, int(h.get("WARC-Segment-Number", 1)), num(h, "WARC-Page-ID"), h["WARC-Type"], num(h, "WARC-Refers-To-Page"), num(h, "WARC-Payload-Length"), digest and digest.removeprefix("sha256:"), "WARC-Segment-Number" not in h, block))
        size += len(block)
        if size > 1 << 22 or len(rows) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema)


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of the gzipped archives under path; gzip keeps Spark from splitting a file."""
    lines = spark.read.option("lineSep", END).option("recursiveFileLookup", "true").text(path)
    return lines.select(F.col("value").cast("binary").alias("line")).mapInArrow(_parse, _CHUNKS)


def _check(record: str, kind: str, due: tuple[int, str], got: tuple[int, str]) -> None:
    """A revisit carries its payload's figures, not the payload; any other record must match its own."""
    if kind != "revisit" and got != due:
        raise ValueError(f"record {record}: payload does not match its digest")


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checks the records of one chunk and drops their data; other rows pass through."""
    for batch in batches:
        data, keep = batch.column("data"), []
        rows = zip(*(batch.column(c).to_pylist() for c in ("record_id", "record_type", "length", "digest", "whole")))
        for i, (rid, kind, length, digest, whole) in enumerate(rows):
            if whole:
                block = data[i].as_buffer()
                _check(rid, kind, (length, digest), (block.size, hashlib.sha256(block).hexdigest()))
            keep.append(None if whole else data[i].as_py())
        names = batch.schema.names
        cols = [batch.column(c) for c in names[:-1]]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(keep, pa.binary())], names)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (record, chunk): one row a record, with digest and length of all its chunks."""
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    current, state, size, head, due = None, None, 0, None, 1

    def closed():
        page, kind, refers, length, digest, whole = head
        if not whole:
            _check(current, kind, (length, digest), (size, state.hexdigest()))
        return page, kind, refers, length, digest

    for batch in batches:
        out = []
        cols = [batch.column(i).to_pylist() for i in range(8)]
        for i, (rid, nth, page, kind, refers, length, digest, whole) in enumerate(zip(*cols)):
            if rid != current:
                if current is not None:
                    out.append(closed())
                current, state, size, head, due = rid, hashlib.sha256(), 0, (page, kind, refers, length, digest, whole), 1
            if nth != due:
                raise ValueError(f"record {rid}: chunk {due} is missing")
            due += 1
            if not whole:
                block = batch.column(8)[i].as_buffer()
                state.update(block)
                size += block.size
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(closed()), kinds)], names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest of every record; digests are checked."""
    rows = chunk_table(spark, path).mapInArrow(_settle, _CHUNKS).repartition("record_id").sortWithinPartitions("record_id", "chunk")
    return rows.mapInArrow(_digest, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_id, chunk, data of every response chunk, for streaming consumers."""
    return chunk_table(spark, path).where(~F.col("record_type").isin("revisit")).select("record_id", "chunk", "page_id", "data")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives, reads them back; one row a page."""
    spark = pages.sparkSession
    path = scratch(spark)
    write(records(pages), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
