"""A corpus pipeline of five stages over the operators of plumbline.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents, whatever their names. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import exact_dedup, mixing, ngram_join, packing, quality
from plumbline.llm.shared import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; the labels lie in sf_dir.

    A null text has importance 0; rows that repeat doc_id and text stay or go together;
    without good labels every row stays.
    """
    return quality.select(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then that with the smallest doc_id.

    Null and blank texts are one group; of repeated rows one stays.
    """
    return exact_dedup.keep_one(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares five-word shingles at a Jaccard similarity of 0.8 or more: the smallest doc_id.

    Texts without words, and rows without doc_id, are in no group and stay.
    """
    return ngram_join.keep_first(docs, size=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it.

    A null source is a source; a text without words is taken or left like any other;
    copies of repeated rows add up to what the mix takes of them.
    """
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; a null text is the end token alone."""
    return packing.digests(packing.pack(docs, *packing.public_vocabulary()))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", ngram_join_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier, shingle similarity at size and the tokenizer are beyond SQL; tests compare each stage with plain Python or SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
