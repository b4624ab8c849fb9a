"""A corpus pipeline: toxic texts out, near copies out, repeated passages cut, benchmark leaks out, sources mixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dotforge.llm import decontaminate, mixing, near_dedup, substring_dedup, toxicity
from dotforge.llm.common import scratch, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the network learns from all documents' labels.

    Null and empty texts are scored as an empty window, texts of any length window by window; equal texts and repeated
    rows go or stay together; an empty table stays empty; columns of any name pass through.
    """
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that with the smallest id, among rows that tie any one.

    Null texts count as empty and are copies of each other; a null id stays only if its class has no other; texts are
    compared as a whole; an empty table stays empty; columns of any name pass through.
    """
    return near_dedup.drop_near_duplicates(docs)


def repeats_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut from all but their first document; a text that had nothing else goes.

    Null, empty and short texts stay as they are, and so do rows that are equal in id and text with respect to each
    other; n_chars follows a text that was cut; an empty table stays empty; columns of any name pass through.
    """
    out = substring_dedup.drop_repeats(docs)
    removed = substring_dedup.added_names(docs.columns)[1]
    out = out.where((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts and items match nothing; texts of any length are searched as a whole; equal texts go or stay
    together; an empty table on either side leaves docs as they are; columns of any name pass through.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, with what the mix takes of each and where its takes start.

    A document that the mix does not take stays, last, with taken 0 and no position; null texts have size 0, a null
    source is a source of its own; repeated rows are separate documents; an empty table stays empty; the added columns
    give way to columns of the same name.
    """
    return mixing.mix(docs, keep=True)


STAGES = [
    ("toxicity", toxic_out),
    ("minhash_near_dedup", near_copies_out),
    ("substring_dedup", repeats_cut),
    ("benchmark_decontamination", leaks_out),
    ("mixing", mixed),
]
ORACLE_SQL = None  # no stage before the last can be expressed in SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; each stage is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out, path = stage(spark, docs, sf_dir), f"{scratch(spark)}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
