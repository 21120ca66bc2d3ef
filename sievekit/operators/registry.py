"""The schema registry as an append-only table (S7, V1, V8): every upload appends, readers take the newest row of each schema.

Rows: schema_id, source_id, version, signature, fields array of (name, type), generated_at, and whatever a caller adds. Nothing is rewritten, so a killed
upsert leaves no half-done state and a retried one adds a row that equals the one it repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from sievekit.operators.versioning import latest_schema


def register(rows: DataFrame, path: str) -> None:
    """Rule S7: upserts schemas by schema_id."""
    rows.write.mode("append").parquet(path)


def registered(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest row of each schema_id; equal times: the greatest row. Old rows go in the tasks, before anything is moved."""
    rows = spark.read.schema(schema).parquet(path)
    rest = [c for c in rows.columns if c not in ("schema_id", "generated_at")]
    newest = rows.groupBy("schema_id").agg(F.max(F.struct("generated_at", *rest)).alias("s"))
    return newest.select("schema_id", "s.*").select(*rows.columns)


def exact_versions(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rule S7: wanted (source_id, version) with `found` and the schema's columns, null where there is none."""
    rows = registry.withColumn("found", F.lit(True))
    return wanted.join(rows, ["source_id", "version"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def latest_versions(registry: DataFrame, sources: DataFrame) -> DataFrame:
    """Rule S7: (source_id, latest_version) of each source asked for; 0 where it has no schema."""
    top = registry.groupBy("source_id").agg(F.max("version").alias("latest_version"))
    return sources.join(top, "source_id", "left").withColumn("latest_version", F.coalesce("latest_version", F.lit(0)))


def history(registry: DataFrame) -> DataFrame:
    """Rule V8: every version with its difference from the version before: added, removed, retyped (sorted; null for a source's first).

    Versions meet their predecessor in a join by source and version, so a source of many versions is spread over tasks.
    """
    before = registry.select("source_id", (F.col("version") + 1).alias("version"), F.col("fields").alias("old"))
    rows = registry.join(before, ["source_id", "version"], "left")
    names = lambda c: F.transform(c, lambda f: f["name"])
    kept = F.filter("fields", lambda f: F.array_contains(names("old"), f["name"]) & ~F.array_contains("old", f))
    return rows.select(
        *registry.columns,
        F.array_sort(F.array_except(names("fields"), names("old"))).alias("added"),
        F.array_sort(F.array_except(names("old"), names("fields"))).alias("removed"),
        F.when(F.col("old").isNotNull(), F.array_sort(names(kept))).alias("retyped"),
    )


def duplicates(uploads: DataFrame, registry: DataFrame) -> DataFrame:
    """Rule V1: uploads (source_id, signature, ...) with `duplicate`: the signature is that of the source's latest schema. No schema: no duplicate."""
    latest = latest_schema(registry).select("source_id", F.col("signature").alias("_latest"))
    same = F.coalesce(F.col("signature") == F.col("_latest"), F.lit(False))
    return uploads.join(latest, "source_id", "left").withColumn("duplicate", same).drop("_latest")
