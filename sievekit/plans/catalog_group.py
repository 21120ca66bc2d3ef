"""Registered queries for routing, grouping, flattening and validation (G*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.operators.extract import extract_fragments
from sievekit.operators.grouping import assign_groups, flatten_struct, group_schemas, route, serialize_value, validate_records
from sievekit.operators.normalize import build_records
from sievekit.operators.profile import schema_fields
from sievekit.operators.schema_tree import written
from sievekit.sources import render


def _family_records(spark, sf):
    docs = render.two_family_customers(spark, sf)
    keys = ("doc_id", "source_id", "version")
    return build_records(extract_fragments(docs, keep_cols=keys), key_cols=keys)


def group_tables(spark, sf):
    grouped = assign_groups(written(_family_records(spark, sf)), ["source_id", "version"])
    g = group_schemas(grouped, ["source_id", "version"])
    return g.select("source_id", F.col("version").cast("int").alias("version"), "group_id", "record_count",
                    "signature", "table_name",
                    F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["type"],
                                                                               f["nullable"].cast("string"))), ",")
                    .alias("fields"))


GROUP_TABLES_SQL = """
with g as (
  select 'grp_01' as group_id, count_if(c_custkey % 2 = 0) as record_count,
         'balancenumbernamestringnationintegersegmentstring' as src,
         'balance:number:false,name:string:false,nation:integer:' ||
           case when count_if(c_custkey % 10 = 4) > 0 then 'true' else 'false' end ||
           ',segment:string:false' as fields
  from customer
  union all
  select 'grp_02', count_if(c_custkey % 2 = 1), 'minutesintegerticketintegertierstring',
         'minutes:integer:false,ticket:integer:false,tier:string:false'
  from customer
)
select 'customers' as source_id, 1 as version, group_id, record_count, sha1(src) as signature,
       'customers_v1_' || substr(sha1(src), 1, 8) as table_name, fields
from g
"""


def route_counts(spark, sf):
    recs = route(build_records(extract_fragments(render.mixed_customers(spark, sf))))
    return recs.groupBy("doc_id").agg(
        F.count_if(F.col("storage") == "document").alias("document_records"),
        F.count_if(F.col("storage") == "tabular").alias("tabular_records"),
    )


ROUTE_COUNTS_SQL = """
select c_custkey as doc_id, cast(2 as bigint) as document_records,
       cast(1 + case when c_custkey % 3 = 0 then 2 else 0 end + case when c_custkey % 5 = 0 then 1 else 0 end as bigint)
         as tabular_records
from customer
"""


def flatten_serialize(spark, sf):
    """Nested order documents flattened to columns, values serialised for a table."""
    recs = written(build_records(extract_fragments(render.nested_orders(spark, sf))).filter(F.col("source_type") == "json").select("doc_id", "fields", "data"))
    rows = recs.select("doc_id", F.explode("fields").alias("f"))
    ser = rows.select("doc_id", F.col("f.name").alias("name"), serialize_value(F.col("f.token"), F.col("f.jtype")).alias("v"))
    nested = recs.select("doc_id", F.from_json("data", "struct<order:struct<key:bigint,status:string>>").alias("d"))
    flat = flatten_struct(nested, "d")
    tags = ser.filter(F.col("name") == "tags").select("doc_id", F.col("v").alias("tags_json"))
    return flat.join(tags, "doc_id")


FLATTEN_SERIALIZE_SQL = """
select o_orderkey as doc_id, o_orderkey as order_key, o_orderstatus as order_status,
       '["p","' || o_orderpriority || '"]' as tags_json
from orders
"""


def validate_records_q(spark, sf):
    """Records of both batches checked against the schema of batch 1, and against that without one of its fields."""
    docs = render.two_batch_orders(spark, sf)
    keys = ("doc_id", "source_id", "version")
    recs = written(build_records(extract_fragments(docs, keep_cols=keys), key_cols=keys).filter(F.col("source_type") == "json"))
    v1 = schema_fields(recs.filter("version = 1"), ["source_id"])
    checked = validate_records(recs, v1, ["source_id"]).withColumn("against", F.lit("batch 1"))
    fewer = validate_records(recs, v1.filter("name <> 'old_code'"), ["source_id"]).withColumn("against", F.lit("without old_code"))
    return checked.unionByName(fewer).select(F.split("record_id", ":")[0].cast("bigint").alias("doc_id"), "against", "valid", "reason")


VALIDATE_RECORDS_SQL = """
select o_orderkey as doc_id, 'batch 1' as against, year(o_orderdate) < 1998 as valid,
       case when year(o_orderdate) >= 1998 then 'bad type for price' end as reason
from orders
union all
select o_orderkey, 'without old_code', false, case when year(o_orderdate) >= 1998 then 'bad type for price' else 'unknown field old_code' end
from orders
"""


CATALOG = {
    "group_tables": (group_tables, GROUP_TABLES_SQL),
    "route_counts": (route_counts, ROUTE_COUNTS_SQL),
    "flatten_serialize": (flatten_serialize, FLATTEN_SERIALIZE_SQL),
    "validate_records": (validate_records_q, VALIDATE_RECORDS_SQL),
}
