"""Mixing sources to target weights along a time-varying curriculum.

Targets.  Sources in code-point order (null last) weigh 1, 2, 3, repeating, and
share the words of all documents by weight; a source stops at three times its own
size and its excess is shared again by weight until none is above.

Takes.  A source is read in passes over its documents in a fixed pseudo-random
order (md5 of the id and the text) until its target is reached; the document at which
the target falls is cut there.  So a document's take is (full passes) * size plus what
the last, partial pass takes of it.

Curriculum.  Each source has a linear weight schedule over training time t in
[0, 1], proportional to 1 + g (2 t - 1) with g = -0.8, 0, 0.8 repeating; it
integrates to the source's target, so demand up to t is target * (g t^2 + (1 - g) t).
The word at which a take starts, earlier passes over its source included, is inverted to
its t, and t is turned into a position in words by the summed demand of all sources.
Each take has its own position; documents are range-sorted by that of their first take
(those not taken come last), and takes() lists one row a take in training order.

Scale.  A source of any size is cut into hash buckets: sums per (source, bucket)
first, running totals over those, then a running total inside each bucket, so no
task holds a source, and rows without ids are spread by their texts.  Without keep, rows
equal in id, text and source are counted first and stand as one row for up to COPIES of
them; further ones are ordered, and dealt to buckets, by the number of their COPIES too.
With keep, rows carry all their columns and equal ones share a bucket.  Sources are
numbered range by range.

Defined results: null text has size 0; a source without words has target 0; null
source is a source of its own; documents of size 0 take no words and have no position;
rows of equal id and text are separate documents whose order among themselves is
arbitrary without changing the result as a whole; texts of any length are counted as a
whole; empty input gives an empty result; extra columns pass through with keep, and an
added column takes as many leading underscores as it needs to differ from the input's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import numbered
from .common import WORD, fresh_name, materialize

CYCLE = 3
MOST = 3
TILT = (-0.8, 0.0, 0.8)
BUCKET_ROWS = 20_000
COPIES = 1000


def counted(rows: DataFrame) -> DataFrame:
    """(doc_id, source, size, ord) -> the same with n: a row for up to COPIES equal ones; the first COPIES keep their order."""
    same = rows.groupBy("doc_id", "source", "size", "ord").agg(F.count(F.lit(1)).alias("all"))
    dealt = same.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / COPIES))))
    order = F.when(F.col("nth") == 0, F.col("ord")).otherwise(F.md5(F.concat("ord", F.lit(":"), F.col("nth").cast("string"))))
    return dealt.select("doc_id", "source", "size", order.alias("ord"), F.least(F.lit(COPIES), F.col("all") - F.col("nth") * COPIES).cast("int").alias("n"))


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, size) -> (source, source_size, weight, tilt, target); one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = numbered(per, F.col("source").asc_nulls_last(), name="nth")
    per = per.select("source", "source_size", (F.col("nth") % CYCLE + 1).cast("int").alias("weight"), F.get(F.array(*map(F.lit, TILT)), (F.col("nth") % len(TILT)).cast("int")).alias("tilt"))
    per = materialize(per)
    capped = F.lit(False)
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    for _ in range(10_000):
        held, open_ = per.agg(
            F.coalesce(F.sum(F.when(capped, MOST * F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
        ).first()
        if not open_:
            break
        new = (total - held) / open_
        if new == level:
            break
        level = new
        capped = MOST * F.col("source_size") <= F.lit(level) * F.col("weight")
    return per.withColumn("target", F.least((MOST * F.col("source_size")).cast("double"), F.lit(level) * F.col("weight")))


ADDED = ("size", "source_size", "target", "taken", "position", "positions")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, position, positions, range-sorted by position; with keep, docs plus the last six.

    positions are where the takes of a document start, in words of the whole mix, one a
    pass; position is the first of them (null if nothing is taken).
    """
    names = docs.columns
    order = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    base = docs.select(
        *([F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row")] if keep else []),
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), order.alias("ord"),
    )
    slim = base.drop("row")
    slim = materialize(slim.withColumn("n", F.lit(1)) if keep else counted(slim))
    rows = slim.agg(F.sum("n")).first()[0] or 0
    digits = 0
    while rows / 16**digits > BUCKET_ROWS:
        digits += 1
    words = (F.col("size") * F.col("n")).alias("size")
    targets = source_targets(slim.select("source", words))
    bucket = F.substring("ord", 1, digits) if digits else F.lit("")
    slim = slim.withColumn("bucket", bucket)
    sums = slim.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
        .join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    )
    whole = targets.agg(F.sum(F.col("target") * F.col("tilt")), F.sum(F.col("target") * (1 - F.col("tilt")))).first()
    a, b = float(whole[0] or 0), float(whole[1] or 0)

    body = base.withColumns({"bucket": bucket, "n": F.lit(1)}) if keep else slim
    inner = Window.partitionBy("source", "bucket").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = body.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inner), F.lit(0)))
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), "left")
    if not keep:
        placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("inside", F.col("inside") + F.col("copy") * F.col("size"))
    at = F.col("ahead") + F.col("inside")
    aim = F.floor("target")
    full = F.when(F.col("source_size") > 0, F.floor(aim / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), aim - full * F.col("source_size") - at))
    taken = (full * F.col("size") + rest).cast("long")
    passes = F.when(F.col("size") > 0, full + F.when(rest > 0, 1).otherwise(0)).otherwise(0).cast("int")
    lead = 1 - F.col("tilt")

    def start(k: Column) -> Column:
        share = (k * F.col("source_size") + at) / F.col("target")
        t = 2 * share / (lead + F.sqrt(lead * lead + 4 * F.col("tilt") * share))
        return F.lit(a) * t * t + F.lit(b) * t

    out = placed.select(
        *(["row"] if keep else []), "doc_id", "size", "source_size", "target", taken.alias("taken"),
        F.when(passes > 0, F.transform(F.sequence(F.lit(0), passes - 1), start)).otherwise(F.array().cast("array<double>")).alias("positions"),
    )
    out = out.withColumn("position", F.try_element_at("positions", F.lit(1)))
    out = out.repartitionByRange(F.col("position").asc_nulls_last(), F.xxhash64("doc_id")).sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")
    if not keep:
        return out.select("doc_id", *ADDED)
    taken_names = list(names)
    added = []
    for c in ADDED:
        added.append(fresh_name(c, taken_names))
        taken_names.append(added[-1])
    return out.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(names)], *[F.col(c).alias(n) for c, n in zip(ADDED, added)])


def takes(mixed: DataFrame) -> DataFrame:
    """(doc_id, pass, words, position), one row a take in training order, of what mix() gave without keep."""
    one = mixed.select("doc_id", "size", "taken", F.posexplode("positions").alias("pass", "position"))
    words = F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))
    return one.select("doc_id", "pass", words.alias("words"), "position").orderBy("position", "doc_id", "pass")
