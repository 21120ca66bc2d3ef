"""The registered queries of the corpus operators: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sievekit.llm import alignment, piece_transducer, quality_classifier, toxicity
from sievekit.llm.common import documents, labels
from sievekit.llm.fingerprint import fingerprints
from sievekit.llm.minhash import near_duplicates
from sievekit.llm.multi_index import nearest
from sievekit.llm.packing import pack
from sievekit.llm.periodic_runs import periodic_runs, planted, run_digests
from sievekit.llm.quality_rules import quality_rules
from sievekit.llm.sentence_dedup import sentence_dedup
from sievekit.llm.suffix_dedup import suffix_dedup
from sievekit.llm.token_counts import token_counts


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded ratings from the labels: 0 poor, 1 good but toxic, 2 good."""
    return labels(spark, sf_dir).select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and probability of at least grade 1 of every document."""
    docs = documents(spark, sf_dir)
    blob = quality_classifier.train(docs, grades(spark, sf_dir), levels=3)
    got = quality_classifier.quality_scores(docs, blob, ["doc_id"])
    return got.withColumn("kept", F.col("tail_probability") >= quality_classifier.LEAST_TAIL)


def op2_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: number and checksum of the ids, digest of the decoded text."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = documents(spark, sf_dir)
    ids = piece_transducer.encode(docs, path, ["doc_id"])
    got = piece_transducer.decode(ids, path)
    return got.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))


def op4_subsequence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the labels outside the held-out fold."""
    docs = documents(spark, sf_dir)
    return toxicity.toxicity(docs, toxicity.train(docs, labels(spark, sf_dir)))


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated runs of sentences, as counts, removed spans and a digest of what is left."""
    got = sentence_dedup(documents(spark, sf_dir))
    return got.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op6_kneser_ney_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, perplexity and verdict of every document."""
    return quality_rules(documents(spark, sf_dir), ["doc_id"])


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated 400-byte strings, as lengths and a digest of what is left."""
    got = suffix_dedup(documents(spark, sf_dir))
    return got.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op8_sos_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 4096 ids, with a checksum of each piece's ids."""
    got = pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return got.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op9_bloom_lookup_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and likenesses read from them."""
    return fingerprints(documents(spark, sf_dir))


def op10_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the least doc_id of its near-duplicates."""
    return near_duplicates(documents(spark, sf_dir))


def op11_fragment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and counts of two tokenizers over every document."""
    return alignment.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, with runs planted in every tenth: numbers, the strongest, digests."""
    return run_digests(periodic_runs(documents(spark, sf_dir), before=planted))


def op13_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found to every twentieth vector."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


QUERIES = {
    "op1_ordinal_quality": (op1_ordinal_quality, None),
    "op2_viterbi_counts": (op2_viterbi_counts, None),
    "op3_piece_transducer": (op3_piece_transducer, None),
    "op4_subsequence_toxicity": (op4_subsequence_toxicity, None),
    "op5_sentence_spans": (op5_sentence_spans, None),
    "op6_kneser_ney_rules": (op6_kneser_ney_rules, None),
    "op7_suffix_dedup": (op7_suffix_dedup, None),
    "op8_sos_packing": (op8_sos_packing, None),
    "op9_bloom_lookup_fingerprints": (op9_bloom_lookup_fingerprints, None),
    "op10_bbit_minhash": (op10_bbit_minhash, None),
    "op11_fragment_alignment": (op11_fragment_alignment, None),
    "op12_periodic_runs": (op12_periodic_runs, None),
    "op13_multi_index": (op13_multi_index, None),
}
