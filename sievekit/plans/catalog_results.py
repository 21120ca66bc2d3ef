"""Registered query for stored results (Q14): hit, first rows, wrong source, expired, dropped."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.session import shared_dir
from sievekit.sources import render
from sievekit.sources.results import STORED, drop_expired, reread_result, store_result

SCHEMA = "o_orderkey long, o_totalprice double"
NOW = 1_700_000_000


def stored_result(spark, sf):
    """Urgent orders by price, stored and read back; an expired result of all orders leaves nothing, before and after it is dropped."""
    o = render.table(spark, sf, "orders")
    path = shared_dir(spark)
    urgent = o.filter("o_orderpriority = '1-URGENT'").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice")
    store_result(o.select("o_orderkey", "o_totalprice"), path, "urgent", "orders", now=NOW - 300)  # an older result of the same query
    store_result(urgent, path, "urgent", "orders", now=NOW)
    store_result(o.select("o_orderkey", "o_totalprice"), path, "all", "orders", now=NOW - 600)

    def ask(name, query, source, limit=None):
        return reread_result(spark, path, query, source, SCHEMA, limit, now=NOW).select(F.lit(name).alias("ask"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))

    found = ask("hit", "urgent", "orders").union(ask("first", "urgent", "orders", 10)).union(ask("wrong source", "urgent", "nobody")).union(ask("expired", "all", "orders"))
    dropped = drop_expired(spark, path, now=NOW)
    kept = spark.read.schema(STORED).parquet(path).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    parts = kept.select(F.concat(F.lit("rows kept of "), "query_id"), "n", F.lit(None).cast("double"))
    return found.union(parts).union(spark.range(1).select(F.lit("dropped"), F.lit(dropped).cast("long"), F.lit(None).cast("double")))


STORED_RESULT_SQL = """
with urgent as (select o_orderkey as key, o_totalprice as price from orders where o_orderpriority = '1-URGENT')
select 'hit' as ask, key, price from urgent
union all (select 'first', key, price from urgent order by price desc, key limit 10)
union all select 'rows kept of urgent', (select count(*) from orders) + (select count(*) from urgent), null
union all select 'dropped', 1, null
"""

CATALOG = {"stored_result": (stored_result, STORED_RESULT_SQL)}
