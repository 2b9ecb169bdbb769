"""A training corpus from raw documents: five stages, each written as a table before the next reads it.

Defined results: null and empty texts go in the first stage, by its word count; of rows
that repeat doc_id and text one stays; unlike texts under one doc_id are documents of
their own; rows without a doc_id are kept by near-dedup; without labels nothing is toxic,
without benchmark items nothing is contaminated; an empty table gives an empty table;
texts of any length pass whole; further columns stay, but for ids, n_pieces and lossless,
which the last stage replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspan.llm import decontaminate, near_dedup, piece_sampling, quality_rules, toxicity
from panelspan.llm.common import settled, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that are too common on their host."""
    return quality_rules.good_documents(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of this stage's documents and the labels doesn't find toxic."""
    return toxicity.acceptable(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_dedup.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenizing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every column but the text, with its sampled piece ids and whether they decode to it."""
    keep = tuple(c for c in docs.columns if c not in ("text", "ids", "n_pieces", "lossless"))
    return piece_sampling.encode(docs, piece_sampling.vocabulary(spark), keep=keep)


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", tokenizing_stage),
]

#: The toxicity model is learnt numerically and the segmentations are sampled; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage applied to what the one before it kept; a stage's own tables go when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(spark, f"stage-{name.replace(' ', '-')}", lambda docs=docs, stage=stage: stage(spark, docs, sf_dir))
    return docs
