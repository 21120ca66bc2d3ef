"""The training-corpus pipeline: quality rules, quality classifier, near-duplicates, repeated strings, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sievekit.llm import quality_classifier
from sievekit.llm.common import DOC_COLS, documents, stored, whole_characters
from sievekit.llm.minhash import near_duplicates
from sievekit.llm.packing import pack
from sievekit.llm.quality_rules import quality_rules
from sievekit.llm.queries import grades
from sievekit.llm.suffix_dedup import suffix_dedup


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie inside their language's perplexity bands."""
    return quality_rules(docs.select(*DOC_COLS), DOC_COLS).filter("kept").select(*DOC_COLS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of those still here, doesn't hold for poor."""
    blob = quality_classifier.train(docs, grades(spark, sf_dir), levels=3)
    scored = quality_classifier.quality_scores(docs, blob, DOC_COLS)
    return scored.filter(F.col("tail_probability") >= quality_classifier.LEAST_TAIL).select(*DOC_COLS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near-duplicates."""
    gone = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.select(*DOC_COLS).join(gone, "doc_id", "left_anti")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without bytes of repeated 400-byte strings; characters cut in half go too."""
    return whole_characters(suffix_dedup(docs, carry=["lang", "source"])).select(*DOC_COLS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences, with a checksum of each piece's ids."""
    got = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return got.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality rules", rules),
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeated_strings),
    ("packing", packing),
]

#: The stages can't be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to the written result of the one before."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
