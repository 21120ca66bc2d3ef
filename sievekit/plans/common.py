"""Shared plan helpers: documents -> fragments -> records, typed field access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.operators.extract import extract_fragments
from sievekit.operators.normalize import build_records


def records_of(documents: DataFrame, source_type: str | None = None) -> DataFrame:
    recs = build_records(extract_fragments(documents))
    if source_type is not None:
        recs = recs.filter(F.col("source_type") == source_type)
    return recs.withColumn("_v", F.parse_json(F.col("data")))


def path_of(name: str) -> str:
    safe = name.replace("'", "\\'")
    return f"$['{safe}']"


def fv(name: str, spark_type: str, variant: str = "_v") -> Column:
    """Typed value of a top-level field from the record's VARIANT (``_v``)."""
    return F.try_variant_get(F.col(variant), path_of(name), spark_type)


def field_type(name: str, fields: str = "fields") -> Column:
    """Logical type of a top-level field (NULL when absent)."""
    return F.element_at(F.filter(F.col(fields), lambda f: f["name"] == name), 1)["jtype"]
