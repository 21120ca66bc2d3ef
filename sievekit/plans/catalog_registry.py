"""Registered queries for the schema registry: history with adjacent diffs, exact versions, duplicate uploads."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.operators.profile import schema_fields
from sievekit.operators.registry import duplicates, exact_versions, history, latest_versions, register, registered
from sievekit.operators.versioning import assign_versions
from sievekit.plans.catalog_version import _VERSION_CTE
from sievekit.plans.common import records_of
from sievekit.session import shared_dir
from sievekit.sources import render


def _uploads(spark, sf):
    """Each upload with its fields and their signature, written once."""
    fields = schema_fields(records_of(render.evolving_orders(spark, sf), "json"), ["source_id", "doc_id"])
    one = fields.groupBy("source_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("name", "type"))).alias("fields"))  # one upload's
    rows = one.withColumn("signature", F.sha2(F.to_json("fields"), 256)).withColumnRenamed("doc_id", "upload_ord")
    path = shared_dir(spark)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _registry(spark, uploads, sources=None):
    """Schemas registered in two goes: all of them, then the even versions again with other numbers."""
    if sources is not None:
        uploads = uploads.filter(sources)
    v = assign_versions(uploads)
    rows = v.groupBy("source_id", "version", "schema_id").agg(
        F.first("signature").alias("signature"), F.first("fields").alias("fields"), F.count(F.lit(1)).alias("uploads"), F.min("upload_ord").alias("first_upload"))
    rows = rows.withColumn("generated_at", F.timestamp_seconds(F.lit(1_600_000_000) + F.col("version")))
    path = shared_dir(spark)
    register(rows, path)
    again = spark.read.schema(rows.schema).parquet(path).filter("version % 2 = 0")
    again = again.withColumns({"uploads": F.col("uploads") + 1000, "generated_at": F.col("generated_at") + F.expr("INTERVAL 1 DAY")})
    register(again, path)
    return registered(spark, path, rows.schema)


def registry_history(spark, sf):
    """Every version of every source with its difference from the one before, then exact and latest versions asked for."""
    registry = _registry(spark, _uploads(spark, sf))
    text = lambda c: F.array_join(c, ",")
    rows = history(registry).select(F.lit("history").alias("ask"), "source_id", F.col("version").cast("long").alias("version"), "uploads", text("added").alias("added"), text("removed").alias("removed"), text("retyped").alias("retyped"))
    sources = registry.select("source_id").distinct()
    wanted = sources.select("source_id", F.explode(F.array(F.lit(2).cast("long"), F.lit(1_000_000_000).cast("long"))).alias("version"))
    none = F.lit(None).cast("string")
    exact = exact_versions(registry.withColumn("version", F.col("version").cast("long")), wanted).select(F.lit("exact"), "source_id", "version", "uploads", none, none, none)
    asked = sources.union(spark.createDataFrame([("nobody",)], "source_id string"))
    latest = latest_versions(registry, asked).select(F.lit("latest"), "source_id", F.col("latest_version").cast("long"), F.lit(None).cast("long"), none, none, none)
    return rows.union(exact).union(latest)


REGISTRY_HISTORY_SQL = _VERSION_CTE + """,
r as (select v.source_id, version, count(*) + case when version % 2 = 0 then 1000 else 0 end as uploads, bool_or(has_rush) as has_rush
      from v join u on u.doc_id = v.doc_id group by v.source_id, version),
h as (select *, lag(has_rush) over (partition by source_id order by version) as old from r)
select 'history' as ask, source_id, cast(version as bigint) as version, uploads,
       case when old is null then null when has_rush and not old then 'rush' else '' end as added,
       case when old is null then null when old and not has_rush then 'rush' else '' end as removed,
       case when old is not null then '' end as retyped from h
union all
select 'exact', s.source_id, w.version, r.uploads, null, null, null
from (select distinct source_id from r) s cross join (values (2), (1000000000)) w(version)
left join r on r.source_id = s.source_id and r.version = w.version
union all
select 'latest', source_id, cast(max(version) as bigint), null, null, null, null from r group by source_id
union all select 'latest', 'nobody', 0, null, null, null, null
"""


def duplicate_upload(spark, sf):
    """Each source's uploads against the registry, which doesn't know the fifth priority: how many repeat the latest schema."""
    uploads = _uploads(spark, sf)
    registry = _registry(spark, uploads, ~F.col("source_id").startswith("5"))
    judged = duplicates(uploads.select("source_id", "upload_ord", "signature"), registry)
    return judged.groupBy("source_id", "duplicate").agg(F.count(F.lit(1)).alias("uploads"))


DUPLICATE_UPLOAD_SQL = _VERSION_CTE + """,
last as (select source_id, arg_max(has_rush, doc_id) as has_rush from u group by source_id)
select u.source_id, u.source_id not like '5%' and u.has_rush = last.has_rush as duplicate, count(*) as uploads
from u join last using (source_id) group by all
"""

CATALOG = {
    "registry_history": (registry_history, REGISTRY_HISTORY_SQL),
    "duplicate_upload": (duplicate_upload, DUPLICATE_UPLOAD_SQL),
}
