"""Documents to packed training sequences: STAGES in order, each reading what the one before wrote.

Every stage but the last returns the columns it was given, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pavegraph.llm.common import read, table
from pavegraph.llm.decontam import drop_contaminated
from pavegraph.llm.exact import drop_exact_duplicates
from pavegraph.llm.minhash import drop_near_duplicates
from pavegraph.llm.packing import pack
from pavegraph.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic.

    Null and empty texts are judged by their features, all zero; rows without id and repeated rows each by their text.
    """
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for A-Z case, the document with the largest id.

    Null texts equal empty ones; a row without id loses to any with one; of repeated rows one stays.
    """
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the smallest id.

    Null and empty texts are one class; rows without id stay, and so do all rows of the id that stays.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts hold none and stay; rows without id and repeated rows are judged each by their text.
    """
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, with their places in sequences of 1024 tokens.

    A null or empty text is one piece of one token; rows without id and repeated rows are packed each for itself.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]
#: Boosted trees, verified hash joins and packing have no SQL; tests compare run() with the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
