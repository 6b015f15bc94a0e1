"""From raw documents to token ids: five stages, each over all that the one before it kept.

Every stage but the last returns the columns of documents. ``run`` writes what a stage
returns as Parquet in the shared folder and reads it back for the next.

Nulls, empty tables and clashing columns: as the operators' docstrings say. The last
stage returns doc_id, source, text, ids (little-endian uint16 as binary) and n_ids; a
document that the mix takes twice has two rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import common, exact_dedup, mixing, ngram_join, quality, sentence_pieces


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; labels come from the labels table, held-out rows aside."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id."""
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest doc_id."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    out = sentence_pieces.encode(docs.select("doc_id", "source", "text"))
    return out.withColumn("n_ids", (F.octet_length("ids") / 2).cast("long"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: A classifier and ids of pieces aren't for SQL; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.drop(docs)  # the stage before, once the next is written
        docs = kept
    return docs
