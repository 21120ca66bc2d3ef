"""Registered queries for sinks and reads (S4-S8, G12): what is written is read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.operators.schema_tree import written
from sievekit.plans.common import records_of
from sievekit.session import shared_dir
from sievekit.sources import layout, render, tables

LINE_FIELDS = [("qty", "number", True), ("flag", "string", False)]


def table_roundtrip(spark, sf):
    """Line items into a typed table: sound rows come back typed, others are rejects with a reason."""
    records = written(records_of(render.typed_lineitems(spark, sf), "kv").select("record_id", "source_id", "fields"))
    rows, rejects = tables.aligned(records, LINE_FIELDS)
    path = shared_dir(spark)
    tables.append_rows(rows, path)
    stored = spark.read.schema(tables.struct_type([("record_id", "string", True), *LINE_FIELDS])).parquet(path).filter(tables.constraints(LINE_FIELDS))
    back = stored.agg(F.lit("stored").alias("kind"), F.count(F.lit(1)).alias("n"), F.round(F.sum("qty"), 2).alias("total"))
    # a table without the flag: the field is dropped, not the record; with the columns that every stored table has
    narrow, _ = tables.aligned(records, LINE_FIELDS[:1], keep=("record_id", "source_id"))
    narrow_path = shared_dir(spark)
    tables.append_rows(tables.with_system_columns(narrow), narrow_path)
    kept = spark.read.parquet(narrow_path).filter("_id IS NOT NULL AND _ingested_at <= current_timestamp()")
    kept = kept.groupBy("_source_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("qty"), 2).alias("total"))
    kept = kept.select(F.concat(F.lit("narrow "), F.col("_source_id")).alias("kind"), "n", "total")
    return back.union(rejects.groupBy("reason").agg(F.count(F.lit(1)), F.lit(None).cast("double"))).union(kept)


TABLE_ROUNDTRIP_SQL = """
select 'stored' as kind, count(*) as n,
       round(sum(case (l_orderkey + l_linenumber) % 5 when 0 then floor(l_quantity) when 1 then l_quantity + 0.5 end), 2) as total
from lineitem where (l_orderkey + l_linenumber) % 5 <= 2
union all
select 'bad type for qty', count(*), null from lineitem where (l_orderkey + l_linenumber) % 5 > 2
union all
select 'narrow ' || l_returnflag, count(*),
       round(sum(case (l_orderkey + l_linenumber) % 5 when 0 then floor(l_quantity) when 1 then l_quantity + 0.5 end), 2)
from lineitem where (l_orderkey + l_linenumber) % 5 <= 2 group by l_returnflag
"""


def document_roundtrip(spark, sf):
    """Orders appended as documents: counted by source, looked up by id, and the first ones read."""
    records = records_of(render.json_orders(spark, sf), "json")
    path = shared_dir(spark)
    tables.append_documents(records.filter("doc_id % 2 = 0"), path)
    tables.append_documents(records.filter("doc_id % 2 = 1"), path)
    key = F.get_json_object("data", "$.o_orderkey").cast("long")
    known = tables.read_documents(spark, path, "orders", record_ids=["1:json_1:0", "2:json_1:0", "none"])
    counted = tables.count_documents(spark, path).select(F.lit("count").alias("ask"), F.col("n").alias("value"))
    return counted.union(known.select(F.lit("lookup"), key)).union(
        tables.read_documents(spark, path, "orders", limit=3).groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("first"), "n"))


DOCUMENT_ROUNDTRIP_SQL = """
select 'count' as ask, count(*) as value from orders
union all select 'lookup', o_orderkey from orders where o_orderkey in (1, 2)
union all select 'first', least(3, count(*)) from orders
"""

HOT = ["l_shipdate", "l_partkey"]


def clustered_read(spark, sf):
    """Line items written along a space-filling curve over the hot filter columns: what a filter on both returns, and that fewer files can hold it."""
    rows = render.table(spark, sf, "lineitem").select("l_orderkey", *HOT, "l_quantity")
    part = rows.agg((F.max("l_partkey") / 4).cast("long")).first()[0]
    keep = F.col("l_shipdate").between("1995-01-01", "1995-12-31") & (F.col("l_partkey") <= part)
    path, plain = shared_dir(spark), shared_dir(spark)
    layout.write_clustered(rows, path, HOT, files=32)
    rows.repartition(32).write.parquet(plain)
    found = spark.read.parquet(path).filter(keep)
    near = lambda p: layout.files_overlapping(spark.read.parquet(p), {"l_shipdate": ("1995-01-01", "1995-12-31"), "l_partkey": (0, part)})
    touched = near(path).withColumn("of", F.lit("clustered")).union(near(plain).withColumn("of", F.lit("plain")))
    ratio = touched.groupBy().pivot("of", ["clustered", "plain"]).agg(F.first("n")).select((F.col("clustered") * 2 <= F.col("plain")).alias("fewer"))
    got = found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))
    return got.join(ratio, F.lit(True))


CLUSTERED_READ_SQL = """
select count(*) as n, cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity, true as fewer from lineitem
where year(l_shipdate) = 1995 and l_partkey <= (select cast(floor(max(l_partkey) / 4) as bigint) from lineitem)
"""

CATALOG = {
    "clustered_read": (clustered_read, CLUSTERED_READ_SQL),
    "table_roundtrip": (table_roundtrip, TABLE_ROUNDTRIP_SQL),
    "document_roundtrip": (document_roundtrip, DOCUMENT_ROUNDTRIP_SQL),
}
