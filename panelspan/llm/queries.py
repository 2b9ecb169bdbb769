"""The contract queries of the training-data operators: thin, whole-table, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspan.llm import chat, decontaminate, html_extract, near_dedup, piece_sampling, quality_classifier, quality_rules, toxicity, url_filter, warc
from panelspan.llm.common import remainder, table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4).drop("text_key")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode(table(spark, sf_dir, "documents"), piece_sampling.vocabulary(spark))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = remainder("doc_id", 4) == 2
    model = quality_classifier.quality_model(docs.filter(~held), labels.filter(~held), calibration=remainder("doc_id", 4) == 3)
    scored = quality_classifier.quality(docs.withColumn("held_out", held), model, ("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = remainder("doc_id", 5) == 0
    model = toxicity.toxicity_model(docs.filter(~held), labels.filter(~held))
    scored = toxicity.toxicity(docs.withColumn("held_out", held), model, ("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_html_extraction, op3_benchmark_decontamination, op4_sentencepiece, op5_chat_formatting,
        op6_quality_rules, op7_quality_classifier, op8_toxicity, op9_url_filters, op10_warc,
    )
}

ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": near_dedup.ORACLE,
    "op3_benchmark_decontamination": decontaminate.ORACLE,
    "op5_chat_formatting": chat.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op10_warc": warc.ORACLE,
}
