"""Registered queries for versioning, diffs, evolution and the schema registry (V*, S7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.operators.extract import extract_fragments
from sievekit.operators.normalize import build_records
from sievekit.operators.profile import field_signature, schema_fields
from sievekit.operators.versioning import assign_versions, evolve, latest_schema, schema_diff
from sievekit.plans.common import field_type, fv, records_of
from sievekit.sources import render


def _upload_signatures(spark, sf):
    recs = records_of(render.evolving_orders(spark, sf), "json")
    fields = schema_fields(recs, ["source_id", "doc_id"])
    sig = field_signature(fields.withColumn("type", F.concat_ws(":", "type", F.col("nullable").cast("string"))),
                          ["source_id", "doc_id"])
    return sig.withColumnRenamed("doc_id", "upload_ord")


def version_assign(spark, sf):
    v = assign_versions(_upload_signatures(spark, sf))
    return v.select(F.col("upload_ord").alias("doc_id"), "source_id", "version", "schema_id")


_VERSION_CTE = """
with u as (select o_orderkey as doc_id, o_orderpriority as source_id, year(o_orderdate) >= 1998 as has_rush from orders),
w as (select *, case when lag(has_rush) over (partition by source_id order by doc_id) is null then 0
                     when lag(has_rush) over (partition by source_id order by doc_id) <> has_rush then 1 else 0 end as chg
      from u),
v as (select doc_id, source_id,
             1 + sum(chg) over (partition by source_id order by doc_id rows between unbounded preceding and current row)
               as version
      from w)
"""

VERSION_ASSIGN_SQL = _VERSION_CTE + """
select doc_id, source_id, cast(version as bigint) as version, source_id || '_v' || cast(version as varchar) as schema_id
from v
"""


def registry_latest(spark, sf):
    v = assign_versions(_upload_signatures(spark, sf))
    registry = v.groupBy("source_id", "version", "schema_id", "signature").agg(
        F.min("upload_ord").alias("created_by_upload"), F.count(F.lit(1)).alias("uploads"))
    latest = latest_schema(registry)
    return latest.select("source_id", "version", "schema_id", "created_by_upload")


REGISTRY_LATEST_SQL = _VERSION_CTE + """
select source_id, cast(max(version) as bigint) as version,
       source_id || '_v' || cast(max(version) as varchar) as schema_id,
       arg_min(doc_id, (version = (select max(version) from v v2 where v2.source_id = v.source_id))::int * -1e18 + doc_id)
         as created_by_upload
from v group by source_id
"""


def _batch_fields(spark, sf):
    docs = render.two_batch_orders(spark, sf)
    recs = build_records(extract_fragments(docs, keep_cols=("doc_id", "source_id", "version")),
                         key_cols=("doc_id", "source_id", "version")).filter(F.col("source_type") == "json")
    return recs, schema_fields(recs, ["source_id", "version"])


def schema_diff_q(spark, sf):
    _recs, fields = _batch_fields(spark, sf)
    d = schema_diff(fields)
    return d.select("source_id", "from_version", "to_version",
                    *[F.array_join(c, ",").alias(c) for c in ("added", "removed", "changed", "type_changes")], "notes")


SCHEMA_DIFF_SQL = """
select distinct o_orderpriority as source_id, 1 as from_version, 2 as to_version, 'rush' as added,
       'old_code' as removed, 'opt,price' as changed, 'price:number:string' as type_changes,
       'Added: rush; Removed: old_code; Type changes present' as notes
from orders
"""


def evolve_add_null(spark, sf):
    recs, _fields = _batch_fields(spark, sf)
    recs = recs.withColumn("_v", F.parse_json("data"))
    flat = recs.select("doc_id", "version", fv("rush", "boolean").alias("rush"),
                       fv("old_code", "string").alias("old_code"), field_type("price").alias("price_type"))
    old = flat.filter("version = 1").drop("rush")
    new = flat.filter("version = 2").drop("old_code")
    return evolve(old, new, type_changes={"price": ("number", "string")}, type_cols={"price": "price_type"}).select(
        "doc_id", "version", "rush", "old_code", "price_legacy")


EVOLVE_ADD_NULL_SQL = """
select o_orderkey as doc_id, case when year(o_orderdate) >= 1998 then 2 else 1 end as version,
       case when year(o_orderdate) >= 1998 then true end as rush,
       case when year(o_orderdate) < 1998 then 'c' || cast(o_orderkey as varchar) end as old_code,
       case when year(o_orderdate) < 1998 then 'type-migrated from number' end as price_legacy
from orders
"""


def schema_signature_q(spark, sf):
    o = render.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    extra = (k % 2 == 1) & (F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2"))
    text = F.concat(F.lit('{"id": '), k.cast("string"), F.lit(', "status": "'), F.col("o_orderstatus"), F.lit('"'),
                    F.when(extra, F.lit(', "extra": 1')).otherwise(F.lit("")), F.lit("}"))
    docs = o.select(k.alias("doc_id"), F.col("o_orderpriority").alias("source_id"), (k % 2).alias("batch"),
                    text.alias("text"))
    recs = build_records(extract_fragments(docs, keep_cols=("doc_id", "source_id", "batch")),
                         key_cols=("doc_id", "source_id", "batch"))
    fields = schema_fields(recs, ["source_id", "batch"])
    sig = field_signature(fields.withColumn("type", F.concat_ws(":", "type", F.col("nullable").cast("string"))),
                          ["source_id", "batch"])
    a = sig.filter("batch = 0").select("source_id", F.col("signature").alias("s0"))
    b = sig.filter("batch = 1").select("source_id", F.col("signature").alias("s1"))
    return a.join(b, "source_id").select("source_id", (F.col("s0") == F.col("s1")).alias("duplicate"))


SCHEMA_SIGNATURE_SQL = """
select distinct o_orderpriority as source_id,
       not (o_orderpriority like '1%' or o_orderpriority like '2%') as duplicate
from orders
"""


CATALOG = {
    "version_assign": (version_assign, VERSION_ASSIGN_SQL),
    "registry_latest": (registry_latest, REGISTRY_LATEST_SQL),
    "schema_diff": (schema_diff_q, SCHEMA_DIFF_SQL),
    "evolve_add_null": (evolve_add_null, EVOLVE_ADD_NULL_SQL),
    "schema_signature": (schema_signature_q, SCHEMA_SIGNATURE_SQL),
}
