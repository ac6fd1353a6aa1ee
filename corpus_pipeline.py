"""From documents to packed training sequences: five stages, each written and read again.

All stages take nulls in any column, empty and very long texts, ties, repeated rows, empty tables and
further columns of any name; what comes of each is stated with the operator that a stage names. All but
the last give the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evloom.llm import mixture
from evloom.llm.common import durable
from evloom.llm.exact_dedup import keep_distinct
from evloom.llm.jaccard_join import keep_one
from evloom.llm.packing import sequences
from evloom.llm.quality_qda import keep_good
from evloom.llm.queries import TOKENIZERS
from evloom.session import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go (quality_qda.keep_good: a score of 0.3 stays, null text is scored as empty)."""
    return keep_good(docs, table(spark, sf_dir, "labels"), cut=0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays (exact_dedup.keep_distinct: null text is empty, of repeated rows one stays)."""
    return keep_distinct(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the one with the least id stays
    (jaccard_join.keep_one: those without words are linked with nothing)."""
    return keep_one(docs, k=5, percent=80)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as there are, dealt to the sources by target weights; a row for each epoch of a
    document (mixture.mixed: null levels are a node of their own)."""
    return mixture.mixed(docs, mixture.document_levels(), weights=mixture.WEIGHTS, max_epochs=4, seed=7)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens in pieces, with their ids and source rows, each source in proportion
    throughout (packing.sequences: null text is its end id alone)."""
    return sequences(docs, f"{TOKENIZERS}/byte_bpe_50k.json", size=1024, end_id=0)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("n-gram jaccard join", jaccard_join),
    ("source mixture", source_mixture),
    ("packing", packing),
]

#: SQL can't express the classifier and the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each one's result is written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
