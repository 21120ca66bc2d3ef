"""Flagship query: mixed-format customer documents -> records -> per-source schema fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievekit.operators.extract import extract_fragments
from sievekit.operators.normalize import build_records
from sievekit.operators.profile import schema_fields
from sievekit.sources import render


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = build_records(extract_fragments(render.mixed_customers(spark, sf_dir)))
    return schema_fields(records)
