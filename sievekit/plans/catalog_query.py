"""Registered queries for the query surface (Q*), entities (R*), the whole
pipeline (P*) and a corpus-wide extraction run over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.operators.entities import DEFAULT_PATTERNS, entities, ner_labels
from sievekit.operators.extract import extract_fragments, fragment_stats
from sievekit.operators.query import execute_query
from sievekit.plans.common import fv, records_of
from sievekit.plans.pipeline import run_pipeline
from sievekit.sources import render


def _customer_docs(spark, sf):
    return records_of(render.kv_customers(spark, sf), "kv")


def _customer_table(spark, sf):
    r = _customer_docs(spark, sf)
    return r.select(fv("customer_key", "bigint").alias("customer_key"), fv("name", "string").alias("name"),
                    fv("acct_bal", "double").alias("acct_bal"), fv("segment", "string").alias("segment"),
                    fv("nation_key", "bigint").alias("nation_key"))


def q_filter_range(spark, sf):
    res = execute_query({"filter": {"acct_bal": {"$gt": 1000, "$lte": 5000}}, "limit": 0},
                        documents=_customer_docs(spark, sf))
    return res.select(fv("customer_key", "bigint").alias("customer_key"), fv("acct_bal", "double").alias("acct_bal"))


Q_FILTER_RANGE_SQL = """
select c_custkey as customer_key, c_acctbal as acct_bal from customer where c_acctbal > 1000 and c_acctbal <= 5000
"""


def q_in(spark, sf):
    res = execute_query({"filter": {"segment": {"$in": ["BUILDING", "MACHINERY"]}, "nation_key": {"$ne": 3}},
                         "limit": 0}, documents=_customer_docs(spark, sf))
    return res.select(fv("customer_key", "bigint").alias("customer_key"), fv("segment", "string").alias("segment"))


Q_IN_SQL = """
select c_custkey as customer_key, c_mktsegment as segment from customer
where c_mktsegment in ('BUILDING', 'MACHINERY') and c_nationkey <> 3
"""


def q_like(spark, sf):
    return execute_query({"engine": "sqlite", "select": ["customer_key", "name"],
                          "where": {"name": {"$like": "customer#0000001%"}}, "limit": 1000},
                         table=_customer_table(spark, sf))


Q_LIKE_SQL = """
select c_custkey as customer_key, c_name as name from customer where c_name ilike 'customer#0000001%'
"""


def q_exists_path(spark, sf):
    docs = records_of(render.json_orders(spark, sf), "json")
    res = execute_query({"filter": {"o_orderdate": {"$exists": True}},
                         "sort": [["o_orderdate", -1], ["o_orderkey", 1]], "limit": 5}, documents=docs)
    return res.select(fv("o_orderkey", "bigint").alias("o_orderkey"), fv("o_orderdate", "string").alias("o_orderdate"))


Q_EXISTS_PATH_SQL = """
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate from orders
order by o_orderdate desc, o_orderkey asc limit 5
"""


def q_project_sort_limit(spark, sf):
    return execute_query({"engine": "sqlite", "select": ["customer_key", "acct_bal"],
                          "where": {"segment": "BUILDING", "acct_bal": {"$gt": 9000}},
                          "order_by": [["acct_bal", "desc"], ["customer_key", "asc"]], "limit": 5},
                         table=_customer_table(spark, sf))


Q_PROJECT_SORT_LIMIT_SQL = """
select c_custkey as customer_key, c_acctbal as acct_bal from customer
where c_mktsegment = 'BUILDING' and c_acctbal > 9000 order by c_acctbal desc, c_custkey asc limit 5
"""


def q_topk(spark, sf):
    docs = records_of(render.json_orders(spark, sf), "json")
    res = execute_query({"filter": {"o_orderstatus": {"$ne": "F"}},
                         "sort": [{"o_totalprice": -1}, {"o_orderkey": 1}], "limit": 10}, documents=docs)
    return res.select(fv("o_orderkey", "bigint").alias("o_orderkey"), fv("o_totalprice", "double").alias("o_totalprice"))


Q_TOPK_SQL = """
select o_orderkey, o_totalprice from orders where o_orderstatus <> 'F'
order by o_totalprice desc, o_orderkey asc limit 10
"""


def _varied(spark, sf, condition):
    docs = records_of(render.varied_orders(spark, sf), "json")
    return execute_query({"filter": condition}, documents=docs).select(fv("k", "bigint").alias("k"))


def q_mixed_types(spark, sf):
    """Literals meet values of their own type only: whole numbers exactly, text and booleans apart from numbers."""
    over = _varied(spark, sf, {"v": {"$gt": 100}, "big": {"$in": [9007199254740993, 9007199254740995]}}).withColumn("ask", F.lit("number"))
    text = _varied(spark, sf, {"v": {"$gte": "c5"}}).withColumn("ask", F.lit("text"))
    return over.union(text).union(_varied(spark, sf, {"v": True}).withColumn("ask", F.lit("truth")))


Q_MIXED_TYPES_SQL = """
select o_orderkey as k, 'number' as ask from orders where o_orderkey % 5 = 0 and o_custkey > 100 and o_orderkey % 10 in (3, 5)
union all select o_orderkey, 'text' from orders where o_orderkey % 5 = 1 and 'c' || o_custkey >= 'c5'
union all select o_orderkey, 'truth' from orders where o_orderkey % 5 = 2
"""


def q_missing_field(spark, sf):
    """null matches null and missing; $exists tells them apart; $ne keeps documents without the field."""
    asks = {"null": {"v": None}, "absent": {"v": {"$exists": False}}, "unlike": {"v": {"$ne": True}}}
    parts = [_varied(spark, sf, c).groupBy().agg(F.count(F.lit(1)).alias("n")).withColumn("ask", F.lit(a)) for a, c in asks.items()]
    return parts[0].union(parts[1]).union(parts[2])


Q_MISSING_FIELD_SQL = """
select 'null' as ask, count(*) as n from orders where o_orderkey % 5 in (3, 4)
union all select 'absent', count(*) from orders where o_orderkey % 5 = 4
union all select 'unlike', count(*) from orders where o_orderkey % 5 <> 2
"""


def _nested(spark, sf, condition):
    docs = records_of(render.nested_orders(spark, sf), "json")
    return execute_query({"filter": condition}, documents=docs).select(F.try_variant_get("_v", "$.order.key", "bigint").alias("k"))


def q_array_match(spark, sf):
    return _nested(spark, sf, {"tags": "1-URGENT"})


Q_ARRAY_MATCH_SQL = "select o_orderkey as k from orders where o_orderpriority = '1-URGENT'"


def q_dotted_path(spark, sf):
    return _nested(spark, sf, {"order.status": "F", "lines.qty": {"$gt": 49}})


Q_DOTTED_PATH_SQL = """
select o_orderkey as k from orders where o_orderstatus = 'F'
and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 49)
"""


def damaged_documents(spark, sf):
    """Fragments by format and outcome over damaged documents: errors are counted, nothing stops."""
    found = extract_fragments(render.damaged_orders(spark, sf))
    why = F.when(F.col("reason") == "nested too deeply", "depth").when(F.col("reason").isNotNull(), "damaged").otherwise("sound")
    return found.groupBy("source_type", why.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


DAMAGED_DOCUMENTS_SQL = """
select * from (
  select 'json' as source_type, 'sound' as outcome, count(*) as n from orders where o_orderkey % 6 = 0 or (o_orderkey % 6 = 2 and o_orderkey % 60 <> 2)
  union all select 'yaml_block', 'damaged', count(*) from orders where o_orderkey % 6 = 1
  union all select 'kv', 'sound', count(*) from orders where o_orderkey % 6 = 1
  union all select 'json', 'depth', count(*) from orders where o_orderkey % 60 = 2
  union all select 'html_table', 'sound', count(*) from orders where o_orderkey % 6 = 4
  union all select 'json', 'damaged', count(*) from orders where o_orderkey % 6 = 5
) where n > 0
"""


def entities_q(spark, sf):
    docs = render.table(spark, sf, "documents")
    ner = docs.select("doc_id", entities("text").alias("ner"))
    return ner.select("doc_id", F.explode("ner").alias("label", "ents")).select(
        "doc_id", "label", F.array_join("ents", "|").alias("entities"), F.size("ents").alias("n"))


ENTITIES_SQL = "\nunion all\n".join(
    f"""select doc_id, '{label}' as label, array_to_string(list_sort(list_distinct(m)), '|') as entities,
       cast(len(list_distinct(m)) as integer) as n
from (select doc_id, regexp_extract_all(text, '{pat.replace(chr(92) + '"', '"')}') as m from documents)
where len(m) > 0"""
    for label, pat in DEFAULT_PATTERNS.items()
)


def ner_labels_q(spark, sf):
    docs = render.table(spark, sf, "documents")
    return docs.select("doc_id", F.array_join(ner_labels(entities("text")), ",").alias("labels")).filter("labels <> ''")


_HAS = ", ".join(f"""case when regexp_matches(text, '{pat.replace(chr(92) + '"', '"')}') then '{label}' end""" for label, pat in DEFAULT_PATTERNS.items())
NER_LABELS_SQL = f"""
select * from (
  select doc_id, array_to_string(list_sort(list_filter([{_HAS}], lambda x : x is not null)), ',') as labels from documents)
where labels <> ''
"""


def pipeline_summary(spark, sf):
    return run_pipeline(render.mixed_customers(spark, sf)).select(
        "source_id", "documents", "json_fragments", "kv_pairs", "html_tables", "csv_blocks", "yaml_blocks",
        "total_records", "document_records", "tabular_records", "fields_detected", "status")


PIPELINE_SUMMARY_SQL = """
select 'customers' as source_id, count(*) as documents, count(*) as json_fragments, count(*) as kv_pairs,
       count_if(c_custkey % 5 = 0) as html_tables, count_if(c_custkey % 3 = 0) as csv_blocks, count(*) as yaml_blocks,
       3 * count(*) + count_if(c_custkey % 5 = 0) + count_if(c_custkey % 3 = 0) as total_records,
       2 * count(*) as document_records,
       count(*) + 2 * count_if(c_custkey % 3 = 0) + count_if(c_custkey % 5 = 0) as tabular_records,
       cast(4 + case when count_if(c_custkey % 3 = 0) > 0 then 2 else 0 end
              + case when count_if(c_custkey % 5 = 0) > 0 then 1 else 0 end as bigint) as fields_detected,
       'success' as status
from customer
"""


def corpus_fragments(spark, sf):
    """Extraction over the whole real documents table (prose with commas: CSV false-positive test)."""
    docs = render.table(spark, sf, "documents").select("doc_id", F.col("source").alias("source_id"), "text")
    return fragment_stats(extract_fragments(docs), key_cols=("source_id",))


def pages_fragments(spark, sf):
    """Extraction over the raw web pages table (HTML without tables)."""
    pages = render.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.lit("pages").alias("source_id"),
                                                    F.col("html").alias("text"))
    return fragment_stats(extract_fragments(pages), key_cols=("source_id",))


CATALOG = {
    "q_filter_range": (q_filter_range, Q_FILTER_RANGE_SQL),
    "q_in": (q_in, Q_IN_SQL),
    "q_like": (q_like, Q_LIKE_SQL),
    "q_exists_path": (q_exists_path, Q_EXISTS_PATH_SQL),
    "q_project_sort_limit": (q_project_sort_limit, Q_PROJECT_SORT_LIMIT_SQL),
    "q_topk": (q_topk, Q_TOPK_SQL),
    "q_mixed_types": (q_mixed_types, Q_MIXED_TYPES_SQL),
    "q_missing_field": (q_missing_field, Q_MISSING_FIELD_SQL),
    "q_array_match": (q_array_match, Q_ARRAY_MATCH_SQL),
    "q_dotted_path": (q_dotted_path, Q_DOTTED_PATH_SQL),
    "damaged_documents": (damaged_documents, DAMAGED_DOCUMENTS_SQL),
    "entities": (entities_q, ENTITIES_SQL),
    "ner_labels": (ner_labels_q, NER_LABELS_SQL),
    "pipeline_summary": (pipeline_summary, PIPELINE_SUMMARY_SQL),
    "corpus_fragments": (corpus_fragments, None),
    "pages_fragments": (pages_fragments, None),
}
