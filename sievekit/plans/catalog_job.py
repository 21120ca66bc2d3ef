"""Registered queries for the whole job and for files as documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.plans.whole_job import run_job
from sievekit.session import shared_dir
from sievekit.sources import render
from sievekit.sources.files import file_documents


def order_uploads(spark, sf):
    """One upload an order; `rush` exists from 1998 on. One priority is no source id, every fifth file is of a wrong type, every seventh is blank.

    A taken upload holds three fragments: the JSON object, the key-value block, and the same lines as inline YAML (E16).
    """
    o = render.rows(spark, sf, "orders")
    k = F.col("o_orderkey")
    rush = F.when(F.year("o_orderdate") >= 1998, F.lit(', "rush": true')).otherwise(F.lit(""))
    text = F.concat(F.lit('{"id": '), k.cast("string"), rush, F.lit("}\n\nmail: c"), F.col("o_custkey").cast("string"), F.lit("@example.org\nstate: s_"), F.col("o_orderstatus"), F.lit("\n"))
    name = F.concat(F.lit("order_"), k.cast("string"), F.when(k % 5 == 0, ".xml").otherwise(".MD"))
    return o.select(k.alias("doc_id"), F.col("o_orderpriority").alias("source_id"), name.alias("name"), F.when(k % 7 == 0, " ").otherwise(text).alias("text"))


def pipeline_evidence(spark, sf):
    return run_job(spark, order_uploads(spark, sf), shared_dir(spark))


PIPELINE_EVIDENCE_SQL = """
with u as (select o_orderkey as k, o_orderpriority as source_id, year(o_orderdate) >= 1998 as has_rush,
                  not (o_orderpriority like '% %' or o_orderkey % 5 = 0 or o_orderkey % 7 = 0) as ok from orders),
w as (select *, coalesce(has_rush <> lag(has_rush) over (partition by source_id order by k), true) as fresh from u where ok),
s as (select distinct source_id from u),
c as (select s.source_id, (select count(*) from u where u.source_id = s.source_id and ok) as a,
             (select count(*) from u where u.source_id = s.source_id and not ok) as r,
             (select count(*) from w where w.source_id = s.source_id and fresh) as v from s),
p as (select source_id, unnest(['accepted', 'rejected', 'fragments', 'with_entities', 'records', 'versions', 'duplicates', 'invalid', 'documents', 'tables', 'table_rows', 'inserted']) as phase,
             unnest([a, r, 3 * a, 2 * a, 3 * a, v, a - v, 0, 2 * a, v, a, 3 * a]) as n from c)
select source_id, phase, cast(n as bigint) as n, case when n > 0 then 'success' else 'empty' end as status from p
"""


def file_documents_q(spark, sf):
    """Customers of each nation as a text file, as one with a broken byte, and as one of another type, read back as documents."""
    c = render.table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_name")
    rows = c.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    broken = F.expr("CAST(concat(CAST(c_name AS BINARY), X'ff') AS STRING)")
    path = shared_dir(spark)
    rows.select("c_nationkey", "c_name").write.partitionBy("c_nationkey").text(f"{path}/whole")
    rows.select("c_nationkey", broken.alias("c_name")).write.partitionBy("c_nationkey").text(f"{path}/broken")
    rows.select("c_nationkey", "c_name").write.partitionBy("c_nationkey").csv(f"{path}/other")
    got = file_documents(spark, path).filter("length(regexp_extract(name, 'c_nationkey=([0-9]+)', 1)) > 0")
    kind = F.regexp_extract("name", "/(whole|broken|other)/", 1)
    nation = F.regexp_extract("name", "c_nationkey=([0-9]+)", 1).cast("int")
    return got.select(kind.alias("kind"), nation.alias("nation"), "n_bytes", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"), "reason")


FILE_DOCUMENTS_SQL = """
with t as (select c_nationkey, string_agg(c_name || chr(10), '' order by c_custkey) as x, count(*) as n from customer group by c_nationkey)
select 'whole' as kind, cast(c_nationkey as integer) as nation, cast(strlen(x) as bigint) as n_bytes, cast(length(x) as bigint) as n_chars, md5(x) as digest, cast(null as varchar) as reason from t
union all select 'broken', cast(c_nationkey as integer), cast(strlen(x) + n as bigint), null, null, 'not UTF-8' from t
union all select 'other', cast(c_nationkey as integer), cast(strlen(x) as bigint), null, null, 'unsupported file type: .csv' from t
"""

CATALOG = {
    "pipeline_evidence": (pipeline_evidence, PIPELINE_EVIDENCE_SQL),
    "file_documents": (file_documents_q, FILE_DOCUMENTS_SQL),
}
