"""One query per training-data operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, decontaminate, fingerprint, language_model, mixing, near_dedup, pii, quality, resampling, sql, substring_dedup, toxicity, url_filter, warc
from .common import table


def op1_url_filters(spark: SparkSession, d: str) -> DataFrame:
    return url_filter.judge(table(spark, d, "pages"), table(spark, d, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, d, "documents"))


def op3_lm_scoring(spark: SparkSession, d: str) -> DataFrame:
    return language_model.score(table(spark, d, "documents"))


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op5_mixing(spark: SparkSession, d: str) -> DataFrame:
    out = mixing.mix(table(spark, d, "documents"))
    last = F.try_element_at("positions", F.lit(-1))
    return out.select(
        "doc_id", "size", "source_size", "target", "taken", F.size("positions").cast("long").alias("passes"),
        F.round("position", 2).alias("position"), F.round(last, 2).alias("last_position"),
    )


def op6_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(table(spark, d, "documents"), table(spark, d, "labels"))


def op7_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = substring_dedup.drop_repeats(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("_removed").alias("removed_words"), (F.col("_removed") > 0).alias("has_repeats"))


def op8_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return fingerprint.neighbours(table(spark, d, "documents"))


def op9_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.round_trip(table(spark, d, "pages"))


def op10_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op11_centroid_clustering(spark: SparkSession, d: str) -> DataFrame:
    return clustering.cluster(table(spark, d, "embeddings"))[0]


def op12_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.report(table(spark, d, "documents"))


def op13_importance_resampling(spark: SparkSession, d: str) -> DataFrame:
    return resampling.importance(table(spark, d, "documents"), table(spark, d, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_minhash_near_dedup, op3_lm_scoring, op4_toxicity, op5_mixing,
        op6_quality, op7_substring_dedup, op8_fingerprints, op9_warc, op10_decontamination,
        op11_centroid_clustering, op12_pii, op13_importance_resampling,
    )
}
ORACLES = {
    "op1_url_filters": sql.URL_FILTER,
    "op5_mixing": sql.MIX.format(docs="documents"),
    "op9_warc": sql.WARC,
    "op11_centroid_clustering": sql.cluster(),
    "op13_importance_resampling": sql.RESAMPLE,
}
