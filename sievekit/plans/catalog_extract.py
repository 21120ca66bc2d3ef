"""Registered queries for fragment extraction and normalisation (E*, N*, S2/S3).

Each entry: name -> (spark_fn(spark, sf_dir) -> DataFrame, oracle SQL or None).
The SQL reads the base tables only, so it checks the whole round trip.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.functions.text import clean_pages
from sievekit.operators.extract import code_blocks, extract_fragments, fragment_stats
from sievekit.plans.common import field_type, fv, records_of
from sievekit.sources import render


def kv_roundtrip(spark, sf):
    recs = records_of(render.kv_customers(spark, sf), "kv")
    return recs.select(
        F.col("doc_id"),
        fv("customer_key", "bigint").alias("customer_key"),
        fv("name", "string").alias("name"),
        fv("acct_bal", "double").alias("acct_bal"),
        fv("segment", "string").alias("segment"),
        fv("nation_key", "bigint").alias("nation_key"),
        F.size("fields").alias("n_fields"),
    )


KV_ROUNDTRIP_SQL = """
select c_custkey as doc_id, c_custkey as customer_key, c_name as name, c_acctbal as acct_bal,
       c_mktsegment as segment, cast(c_nationkey as bigint) as nation_key, 5 as n_fields
from customer
"""


def kv_blocks_count(spark, sf):
    frags = extract_fragments(render.kv_mixed_customers(spark, sf))
    return frags.groupBy("doc_id").agg(
        F.count_if(F.col("source_type") == "kv").alias("kv_blocks"),
        F.sum(F.when(F.col("source_type") == "kv", F.size("entries")).otherwise(0)).cast("bigint").alias("kv_keys"),
        F.count_if(F.col("source_type") == "json").alias("json_fragments"),
        F.max(F.when(F.col("fragment_id") == "kv_2", F.col("offset_end"))).alias("kv2_end"),
    )


KV_BLOCKS_COUNT_SQL = """
select c_custkey as doc_id, cast(3 as bigint) as kv_blocks,
       cast(case when c_custkey % 2 = 0 then 4 else 5 end as bigint) as kv_keys,
       cast(1 as bigint) as json_fragments,
       cast(length('name: ' || c_name || chr(10) || 'segment: ' || c_mktsegment || chr(10)
              || 'Some prose between blocks.' || chr(10) || 'balance: ' || cast(c_acctbal as varchar) || chr(10)
              || case when c_custkey % 2 = 0 then '' else 'nation: ' || cast(c_nationkey as varchar) || chr(10) end)
            as integer) as kv2_end
from customer
"""


def kv_duplicate_last_wins(spark, sf):
    recs = records_of(render.kv_duplicates(spark, sf), "kv")
    return recs.select(
        "doc_id",
        fv("ref", "bigint").alias("ref"),
        fv("status", "string").alias("status"),
        fv("order_ref", "double").alias("order_ref"),
        F.size("fields").alias("n_fields"),
    )


KV_DUPLICATE_LAST_WINS_SQL = """
select o_orderkey as doc_id, o_custkey as ref, o_orderstatus as status, o_totalprice as order_ref, 3 as n_fields
from orders
"""


def json_roundtrip(spark, sf):
    recs = records_of(render.json_orders(spark, sf), "json")
    return recs.select(
        "doc_id",
        fv("o_orderkey", "bigint").alias("o_orderkey"),
        fv("o_custkey", "bigint").alias("o_custkey"),
        fv("o_orderstatus", "string").alias("o_orderstatus"),
        fv("o_totalprice", "double").alias("o_totalprice"),
        fv("o_orderdate", "string").alias("o_orderdate"),
        fv("o_orderpriority", "string").alias("o_orderpriority"),
        fv("price_text", "double").alias("price_text"),
        field_type("price_text").alias("price_text_type"),
        field_type("o_orderdate").alias("o_orderdate_type"),
        "confidence",
    )


JSON_ROUNDTRIP_SQL = """
select o_orderkey as doc_id, o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority, o_totalprice as price_text,
       'number' as price_text_type, 'string' as o_orderdate_type, 1.0 as confidence
from orders
"""


def json_repair(spark, sf):
    recs = records_of(render.json_damaged_orders(spark, sf), "json")
    return recs.select(
        "doc_id",
        F.coalesce(fv("_parse_error", "boolean"), F.lit(False)).alias("parse_error"),
        fv("key", "bigint").alias("key"),
        fv("status", "string").alias("status"),
        "confidence",
    )


JSON_REPAIR_SQL = """
select o_orderkey as doc_id, (o_orderkey % 4 = 3) as parse_error,
       case when o_orderkey % 4 = 3 then null else o_orderkey end as key,
       case when o_orderkey % 4 = 3 then null else o_orderstatus end as status,
       case when o_orderkey % 4 = 3 then 0.5 else 1.0 end as confidence
from orders
"""


def events_props(spark, sf):
    ev = render.table(spark, sf, "events")
    docs = ev.select(F.col("event_id").alias("doc_id"), F.col("event_type").alias("source_id"), F.col("props").alias("text"))
    recs = records_of(docs, "json")
    k = fv("k", "bigint")
    return recs.filter(k > 50).select("doc_id", F.col("source_id").alias("event_type"), k.alias("k"),
                                      field_type("k").alias("k_type"))


EVENTS_PROPS_SQL = """
select event_id as doc_id, event_type, cast(json_extract(props, '$.k') as bigint) as k, 'integer' as k_type
from events where cast(json_extract(props, '$.k') as bigint) > 50
"""


def csv_roundtrip(spark, sf):
    recs = records_of(render.csv_customers_by_nation(spark, sf), "csv_block")
    return recs.select(
        "doc_id", "row_index",
        fv("custkey", "bigint").alias("custkey"),
        fv("name", "string").alias("name"),
        fv("segment", "string").alias("segment"),
        fv("acctbal", "double").alias("acctbal"),
    )


CSV_ROUNDTRIP_SQL = """
with c as (select *, count(*) over (partition by c_nationkey) as n,
                  row_number() over (partition by c_nationkey order by c_custkey) - 1 as rn from customer)
select cast(c_nationkey as bigint) as doc_id, cast(rn as integer) as row_index, c_custkey as custkey, c_name as name,
       c_mktsegment as segment, c_acctbal as acctbal
from c where n >= 2
"""


def csv_confidence(spark, sf):
    frags = extract_fragments(render.csv_customers_by_nation(spark, sf)).filter(F.col("source_type") == "csv_block")
    return frags.select(
        "doc_id", "fragment_id", "delimiter", "confidence",
        F.size("rows").alias("n_rows"), F.size("headers").alias("n_cols"),
    )


CSV_CONFIDENCE_SQL = """
select cast(c_nationkey as bigint) as doc_id, 'csv_block_1' as fragment_id,
       case when c_nationkey % 2 = 0 then ',' else chr(9) end as delimiter, 0.95 as confidence,
       cast(count(*) as integer) as n_rows, 4 as n_cols
from customer group by c_nationkey having count(*) >= 2
"""


def html_roundtrip(spark, sf):
    recs = records_of(render.html_nations_by_region(spark, sf), "html_table")
    return recs.select(
        "doc_id", "row_index",
        fv("nation_key", "bigint").alias("nation_key"),
        fv("nation_name", "string").alias("nation_name"),
        fv("region_key", "bigint").alias("region_key"),
        "confidence",
    )


HTML_ROUNDTRIP_SQL = """
select cast(n_regionkey as bigint) as doc_id,
       cast(row_number() over (partition by n_regionkey order by n_nationkey) - 1 as integer) as row_index,
       cast(n_nationkey as bigint) as nation_key, n_name as nation_name, cast(n_regionkey as bigint) as region_key,
       0.95 as confidence
from nation
"""


def yaml_frontmatter(spark, sf):
    recs = records_of(render.yaml_parts(spark, sf), "yaml_block")
    return recs.select(
        "doc_id",
        fv("partkey", "bigint").alias("partkey"),
        fv("brand", "string").alias("brand"),
        fv("size", "bigint").alias("size"),
        fv("retailprice", "double").alias("retailprice"),
        F.col("provenance.block_type").alias("block_type"),
        "confidence",
    )


YAML_FRONTMATTER_SQL = """
select p_partkey as doc_id, p_partkey as partkey, p_brand as brand, cast(p_size as bigint) as size,
       p_retailprice as retailprice, 'frontmatter' as block_type, 0.95 as confidence
from part
"""


def yaml_inline(spark, sf):
    recs = records_of(render.yaml_inline_parts(spark, sf), "yaml_block")
    return recs.select(
        "doc_id",
        fv("part_key", "bigint").alias("part_key"),
        fv("part_size", "bigint").alias("part_size"),
        fv("part_type", "string").alias("part_type"),
        F.col("provenance.block_type").alias("block_type"),
        "confidence",
    )


YAML_INLINE_SQL = """
select p_partkey as doc_id, p_partkey as part_key, cast(p_size as bigint) as part_size, p_type as part_type,
       'inline' as block_type, 0.85 as confidence
from part
"""


def code_blocks_q(spark, sf):
    docs = render.code_block_regions(spark, sf)
    return docs.select("doc_id", F.posexplode(code_blocks(F.col("text"))).alias("pos", "content")).select(
        "doc_id", (F.col("pos") + 1).alias("block_no"), "content")


CODE_BLOCKS_SQL = """
select cast(r_regionkey as bigint) as doc_id, 1 as block_no, 'select ' || cast(r_regionkey as varchar) || ';' as content
from region
union all
select cast(r_regionkey as bigint), 2, r_name || chr(10) || '' from region where r_regionkey % 2 = 1
"""


def page_clean(spark, sf):
    docs = render.pages_from_conversations(spark, sf)
    return docs.select("doc_id", F.explode(clean_pages(F.col("text"))).alias("p")).select(
        "doc_id", F.col("p.page_no").alias("page_no"), F.col("p.text").alias("text"))


PAGE_CLEAN_SQL = r"""
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn) as page_no,
         role || ': ' || text
         || case when turn % 2 = 0 then ' hyphen-' || chr(10) || 'ated' else '' end
         || case when turn % 3 = 0 then chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || 'soft' || chr(173) || 'hy' else '' end as raw
  from conversations
), c as (
  select conv_id, page_no,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
           replace(raw, chr(13), ''), chr(160), ' ', 'g'), '-\n([A-Za-z])', '\1', 'g'), chr(173), '', 'g'),
           '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as cleaned
  from t
)
select conv_id as doc_id, cast(page_no as integer) as page_no,
       '--- PAGE ' || cast(page_no as varchar) || ' ---' || chr(10) || chr(10) || cleaned as text
from c where cleaned <> ''
"""


def fragment_stats_q(spark, sf):
    frags = extract_fragments(render.mixed_customers(spark, sf))
    return fragment_stats(frags)


FRAGMENT_STATS_SQL = """
select c_custkey as doc_id, cast(1 as bigint) as json_fragments, cast(1 as bigint) as kv_pairs,
       cast(case when c_custkey % 5 = 0 then 1 else 0 end as bigint) as html_tables,
       cast(case when c_custkey % 3 = 0 then 1 else 0 end as bigint) as csv_blocks,
       cast(1 as bigint) as yaml_blocks,
       cast(3 + case when c_custkey % 5 = 0 then 1 else 0 end + case when c_custkey % 3 = 0 then 1 else 0 end as bigint)
         as total_records
from customer
"""


CATALOG = {
    "kv_roundtrip": (kv_roundtrip, KV_ROUNDTRIP_SQL),
    "kv_blocks_count": (kv_blocks_count, KV_BLOCKS_COUNT_SQL),
    "kv_duplicate_last_wins": (kv_duplicate_last_wins, KV_DUPLICATE_LAST_WINS_SQL),
    "json_roundtrip": (json_roundtrip, JSON_ROUNDTRIP_SQL),
    "json_repair": (json_repair, JSON_REPAIR_SQL),
    "events_props": (events_props, EVENTS_PROPS_SQL),
    "csv_roundtrip": (csv_roundtrip, CSV_ROUNDTRIP_SQL),
    "csv_confidence": (csv_confidence, CSV_CONFIDENCE_SQL),
    "html_roundtrip": (html_roundtrip, HTML_ROUNDTRIP_SQL),
    "yaml_frontmatter": (yaml_frontmatter, YAML_FRONTMATTER_SQL),
    "yaml_inline": (yaml_inline, YAML_INLINE_SQL),
    "code_blocks": (code_blocks_q, CODE_BLOCKS_SQL),
    "page_clean": (page_clean, PAGE_CLEAN_SQL),
    "fragment_stats": (fragment_stats_q, FRAGMENT_STATS_SQL),
}
