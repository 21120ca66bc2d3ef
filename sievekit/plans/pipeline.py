"""Whole job (rules P1-P3): documents of all sources in one DataFrame plan.

documents -> fragments -> records -> routing -> schema per source ->
summary per source.  Nothing is collected; every stage is a partitioned
transformation and the only shuffles are the per-source aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.operators.extract import extract_fragments, fragment_stats
from sievekit.operators.grouping import route
from sievekit.operators.normalize import build_records
from sievekit.operators.profile import schema_fields
from sievekit.operators.schema_tree import written


def run_pipeline(documents: DataFrame) -> DataFrame:
    """Per-source ingest summary (P2), with fragment stats merged into it."""
    fragments = written(extract_fragments(documents))  # three passes read them
    records = route(build_records(fragments))
    stats = fragment_stats(fragments, key_cols=("source_id",))
    docs = documents.groupBy("source_id").agg(F.count(F.lit(1)).alias("documents"))
    rec = records.groupBy("source_id").agg(
        F.count_if(F.col("storage") == "document").alias("document_records"),
        F.count_if(F.col("storage") == "tabular").alias("tabular_records"))
    fields = schema_fields(records, ["source_id"]).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("fields_detected"), F.avg("confidence").alias("avg_confidence"))
    out = docs.join(stats, "source_id", "left").join(rec, "source_id", "left").join(fields, "source_id", "left")
    n = F.coalesce(F.col("document_records"), F.lit(0)) + F.coalesce(F.col("tabular_records"), F.lit(0))
    status = F.when(F.coalesce(F.col("total_records"), F.lit(0)) == 0, F.lit("empty")).when(n > 0, F.lit("success")) \
        .otherwise(F.lit("noop"))
    return out.withColumn("status", status)
