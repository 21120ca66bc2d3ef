"""Registered queries for type inference and profiling (T*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.functions.typing import semantics
from sievekit.operators.normalize import long_fields
from sievekit.operators.profile import example_values, path_stats, path_suggestions, schema_fields, source_schema, type_ratio, type_summary
from sievekit.operators.schema_tree import written
from sievekit.plans.common import records_of
from sievekit.sources import render


def semantics_flags(spark, sf):
    o = render.table(spark, sf, "orders")
    form = F.col("o_orderkey") % 6
    value = (F.when(form == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
             .when(form == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
             .when(form == 2, F.concat(F.lit("-"), F.col("o_totalprice").cast("string")))
             .when(form == 3, F.when(F.col("o_orderkey") % 4 == 1, F.lit(" Yes")).otherwise(F.lit("no")))
             .when(form == 4, F.lit("2024-02-30"))
             .otherwise(F.col("o_orderpriority")))
    v = o.select(F.col("o_orderkey").alias("doc_id"), value.alias("value"))
    s = semantics(F.col("value"))
    return v.select("doc_id", "value", s["looks_like_number"].alias("looks_like_number"),
                    s["looks_like_date"].alias("looks_like_date"), s["looks_like_boolean"].alias("looks_like_boolean"))


SEMANTICS_FLAGS_SQL = r"""
with v as (
  select o_orderkey as doc_id,
    case o_orderkey % 6
      when 0 then strftime(o_orderdate, '%Y-%m-%d')
      when 1 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
      when 2 then '-' || cast(o_totalprice as varchar)
      when 3 then case when o_orderkey % 4 = 1 then ' Yes' else 'no' end
      when 4 then '2024-02-30'
      else o_orderpriority end as value
  from orders)
select doc_id, value,
  regexp_full_match(value, '[+-]?[0-9]*\.?[0-9]+') as looks_like_number,
  coalesce(regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?')
           and try_cast(value as timestamp) is not null, false) as looks_like_date,
  lower(trim(value)) in ('true', 'false', 'yes', 'no') as looks_like_boolean
from v
"""


def _typed_long(spark, sf):
    recs = records_of(render.typed_lineitems(spark, sf), "kv")
    return long_fields(recs, keep=("source_id", "record_id", "ord")).filter(F.col("name") == "qty")


def type_merge(spark, sf):
    s = type_summary(_typed_long(spark, sf), ["source_id"])
    return s.select("source_id", "name", "dominant", F.array_join("type_union", ",").alias("type_union"),
                    "occurrences", "matching", "confidence")


_TYPES_CTE = """
with t as (
  select l_returnflag as source_id,
    case (l_orderkey + l_linenumber) % 5 when 0 then 'integer' when 1 then 'number' when 2 then 'null'
      when 3 then 'string' else 'boolean' end as jtype
  from lineitem),
c as (select source_id, jtype, count(*) as cnt from t group by source_id, jtype),
f as (select source_id, bool_or(jtype = 'integer') and bool_or(jtype = 'number') as both_num,
             sum(cnt) as occurrences, max(cnt) as max_cnt from c group by source_id),
p as (select c.source_id, case when both_num and jtype = 'integer' then 'number' else jtype end as jt, sum(cnt) as cnt
      from c join f using (source_id) group by 1, 2),
d as (select source_id, jt as dominant from (
        select source_id, jt, row_number() over (partition by source_id order by cnt desc, jt) as rn from p) where rn = 1),
u as (select source_id, string_agg(jt, ',' order by jt) as type_union from p group by source_id)
"""

TYPE_MERGE_SQL = _TYPES_CTE + """
select f.source_id, 'qty' as name, d.dominant, u.type_union, f.occurrences,
       coalesce((select cnt from c where c.source_id = f.source_id and c.jtype = d.dominant), 0) as matching,
       round_even(coalesce((select cnt from c where c.source_id = f.source_id and c.jtype = d.dominant), 0)
                  / f.occurrences, 3) as confidence
from f join d using (source_id) join u using (source_id)
"""


def field_confidence(spark, sf):
    return type_ratio(_typed_long(spark, sf), ["source_id"])


FIELD_CONFIDENCE_SQL = _TYPES_CTE + """
select source_id, 'qty' as name, occurrences, round_even(max_cnt / occurrences, 3) as type_ratio from f
"""


def schema_fields_q(spark, sf):
    recs = records_of(render.optional_field_orders(spark, sf), "json")
    out = schema_fields(recs, ["source_id"])
    return out.select("source_id", "name", "type", "nullable", "example_value", "confidence", "occurrences",
                      "total_records")


SCHEMA_FIELDS_SQL = """
with o as (select * from orders),
tot as (select o_orderstatus as source_id, count(*) as n from o group by 1),
f as (
  select o_orderstatus as source_id, 'id' as name, 'integer' as type, count(*) as occ,
         cast(min(o_orderkey) as varchar) as example_value, 1.0 as confidence from o group by 1
  union all
  select o_orderstatus, 'price', 'number', count(*), cast(arg_min(o_totalprice, o_orderkey) as varchar), 1.0 from o group by 1
  union all
  select o_orderstatus, 'prio', 'string', count(*), '"' || arg_min(o_orderpriority, o_orderkey) || '"', 1.0 from o group by 1
  union all
  select o_orderstatus, 'opt', 'integer', count(*), cast(arg_min(o_custkey, o_orderkey) as varchar), 1.0
  from o where o_orderkey % 3 <> 0 group by 1
  union all
  select o_orderstatus, 'maybe',
         case when count_if(o_orderkey % 4 = 0) > count_if(o_orderkey % 4 <> 0) then 'null' else 'string' end,
         count(*), '"v' || cast(min(case when o_orderkey % 4 <> 0 then o_orderkey end) as varchar) || '"',
         round_even(greatest(count_if(o_orderkey % 4 = 0), count_if(o_orderkey % 4 <> 0)) / count(*), 3)
  from o group by 1
)
select f.source_id, name, type, occ < n as nullable, example_value, confidence, occ as occurrences, n as total_records
from f join tot using (source_id)
"""


def _nested_stats(spark, sf):
    recs = written(records_of(render.nested_orders(spark, sf), "json").select("source_id", "ord", "paths"))
    return recs, path_stats(recs, ["source_id"])


def path_stats_q(spark, sf):
    _recs, st = _nested_stats(spark, sf)
    return st.select("source_id", "path", "presence_count", "n_integer", "n_number", "n_string", "num_min", "num_max",
                     "num_count", F.array_join("examples", "|").alias("examples"))


PATH_STATS_SQL = """
with lines as (
  select l_orderkey as k, l_linenumber as ln, 'lines.n' as path, 'integer' as t, cast(l_linenumber as double) as num,
         cast(l_linenumber as varchar) as tok, 1 as seq_in from lineitem
  union all
  select l_orderkey, l_linenumber, 'lines.qty', 'number', l_quantity, cast(l_quantity as varchar), 2 from lineitem
),
v as (
  select o_orderkey as k, 0 as ln, 'order.key' as path, 'integer' as t, cast(o_orderkey as double) as num,
         cast(o_orderkey as varchar) as tok, 0 as seq_in from orders
  union all
  select o_orderkey, 0, 'order.status', 'string', null, '"' || o_orderstatus || '"', 1 from orders
  union all select * from lines where k in (select o_orderkey from orders)
  union all
  select o_orderkey, 1000000, 'tags[]', 'string', null, '"p"', 0 from orders
  union all
  select o_orderkey, 1000000, 'tags[]', 'string', null, '"' || o_orderpriority || '"', 1 from orders
),
firsts as (select path, tok, min(k * 100000000 + ln * 10 + seq_in) as p from v group by path, tok),
ex as (select path, string_agg(tok, '|' order by p) as examples from (
         select *, row_number() over (partition by path order by p) as rn from firsts) where rn <= 3 group by path)
select 'orders' as source_id, v.path, count(*) as presence_count,
       count_if(t = 'integer') as n_integer, count_if(t = 'number') as n_number, count_if(t = 'string') as n_string,
       min(num) as num_min, max(num) as num_max, count(num) as num_count, any_value(ex.examples) as examples
from v join ex using (path) group by v.path
"""


def pk_enum_coercion(spark, sf):
    recs, st = _nested_stats(spark, sf)
    totals = recs.groupBy("source_id").agg(F.count(F.lit(1)).alias("total_records"))
    sug = path_suggestions(st, totals, ["source_id"])
    return sug.select("source_id", "path", F.round("presence_ratio", 6).alias("presence_ratio"), "dominant",
                      "pk_candidate", F.array_join("enum_values", "|").alias("enum_values"), "coercion")


PK_ENUM_COERCION_SQL = """
with v as (
  select o_orderkey as k, 0 as ln, 0 as seq_in, 'order.key' as path, 'integer' as t, cast(o_orderkey as varchar) as tok,
         cast(o_orderkey as double) as num from orders
  union all select o_orderkey, 0, 1, 'order.status', 'string', '"' || o_orderstatus || '"', null from orders
  union all select l_orderkey, l_linenumber, 1, 'lines.n', 'integer', cast(l_linenumber as varchar), l_linenumber from lineitem
    where l_orderkey in (select o_orderkey from orders)
  union all select l_orderkey, l_linenumber, 2, 'lines.qty', 'number', cast(l_quantity as varchar), l_quantity from lineitem
    where l_orderkey in (select o_orderkey from orders)
  union all select o_orderkey, 1000000, 0, 'tags[]', 'string', '"p"', null from orders
  union all select o_orderkey, 1000000, 1, 'tags[]', 'string', '"' || o_orderpriority || '"', null from orders
),
s as (select path, count(distinct tok) as nd, count(*) as ns, bool_and(t in ('integer', 'number')) as all_num
      from v group by path),
ev as (select path, string_agg(tok, '|' order by case when s.all_num then num end, tok) as enum_values
       from (select distinct path, tok, num from v) d join s using (path)
       group by path),
p as (select path, count(*) as presence, mode(t) as dominant from v group by path),
tot as (select count(*) as n from orders)
select 'orders' as source_id, p.path, round(p.presence / tot.n, 6) as presence_ratio, p.dominant,
       (p.presence / tot.n >= 0.9 and s.nd / s.ns >= 0.9) as pk_candidate,
       case when p.presence / tot.n >= 0.5 and s.nd <= 10 then ev.enum_values end as enum_values,
       cast(null as varchar) as coercion
from p cross join tot join s using (path) join ev using (path)
"""


def example_values_q(spark, sf):
    """First values of four fields of each priority's orders; notes are null but for every third order, nothing has no value at all."""
    o = render.rows(spark, sf, "orders")
    k = F.col("o_orderkey").cast("string")
    note = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('"n'), k, F.lit('"'))).otherwise(F.lit("null"))
    text = F.concat(F.lit('{"id": '), k, F.lit(', "day": "'), F.col("o_orderdate").cast("date").cast("string"), F.lit('", "note": '), note, F.lit("}"))
    docs = o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("source_id"), text.alias("text"))
    return example_values(records_of(docs, "json"), ["id", "day", "note", "nothing"], ["source_id"])


EXAMPLE_VALUES_SQL = """
select o_orderpriority as source_id, 'id' as name, 'integer' as jtype, cast(min(o_orderkey) as varchar) as token, 0.0::double as boost from orders group by 1
union all select o_orderpriority, 'day', 'string', '"' || cast(cast(arg_min(o_orderdate, o_orderkey) as date) as varchar) || '"', 0.05 from orders group by 1
union all select o_orderpriority, 'note', 'string', '"n' || cast(min(o_orderkey) as varchar) || '"', 0.0 from orders where o_orderkey % 3 = 0 group by 1
union all select distinct o_orderpriority, 'nothing', null, null, 0.0::double from orders
"""


def source_schema_q(spark, sf):
    """Each priority's orders as objects, bare numbers, lists, plain texts and nulls, in one schema."""
    o = render.rows(spark, sf, "orders")
    k = F.col("o_orderkey").cast("string")
    form = F.col("o_orderkey") % 7
    value = (F.when(form < 3, F.concat(F.lit('{"id": '), k, F.when(form == 0, F.concat(F.lit(', "prio": "'), F.col("o_orderpriority"), F.lit('"'))).otherwise(F.lit("")), F.lit("}")))
             .when(form == 3, k).when(form == 4, F.concat(F.lit("["), k, F.lit("]"))).when(form == 5, F.concat(F.lit("note "), k)))
    fragments = o.select(F.col("o_orderpriority").alias("source_id"), F.col("o_orderkey").alias("ord"), value.alias("value"))
    out = source_schema(fragments, ["source_id"])
    return out.select("source_id", "name", "type", "nullable", "example_value", "confidence", "occurrences", "total_records")


SOURCE_SCHEMA_SQL = """
with o as (select o_orderpriority as source_id, o_orderkey as k, o_orderkey % 7 as form from orders),
tot as (select source_id, count(*) as n from o group by 1),
kinds as (select source_id, case form when 3 then 'integer' when 4 then 'array' when 5 then 'string' else 'null' end as t, count(*) as c
          from o where form > 2 group by all),
top as (select source_id, arg_min(t, (-c, t)) as t, max(c) as c, sum(c) as occ from kinds group by 1),
firsts as (select source_id, arg_min(case form when 3 then cast(k as varchar) when 4 then '[' || k || ']' else '"note ' || k || '"' end, k) as e
           from o where form between 3 and 5 group by 1),
f as (
  select source_id, 'id' as name, 'integer' as type, cast(min(k) as varchar) as example_value, 1.0::double as confidence, count(*) as occ from o where form < 3 group by 1
  union all select source_id, 'prio', 'string', '"' || source_id || '"', 1.0, count(*) from o where form = 0 group by 1
  union all select source_id, 'value', t, e, round_even(c / occ, 3), occ from top left join firsts using (source_id))
select source_id, name, type, occ < n as nullable, example_value, confidence, cast(occ as bigint) as occurrences, n as total_records
from f join tot using (source_id)
"""


def coercion_hints(spark, sf):
    """The share of numeric-looking strings decides; four of five codes of one customer look like numbers, one of five codes of the next."""
    o = render.rows(spark, sf, "orders")
    k = F.col("o_orderkey")
    looks = F.when(F.col("o_custkey") % 2 == 0, k % 5 != 0).otherwise(k % 5 == 0)
    code = F.concat(F.when(looks, F.lit("")).otherwise(F.lit("c")), k.cast("string"))
    text = F.concat(F.lit('---\ncode: "'), code, F.lit('"\nkey: '), k.cast("string"), F.lit("\n---\nDone.\n"))  # quoted in YAML a number stays a string
    docs = o.select(k.alias("doc_id"), F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("source_id"), text.alias("text"))
    recs = written(records_of(docs, "yaml_block").select("source_id", "ord", "paths"))
    totals = recs.groupBy("source_id").agg(F.count(F.lit(1)).alias("total_records"))
    return path_suggestions(path_stats(recs, ["source_id"]), totals, ["source_id"]).select("source_id", "path", "dominant", "coercion")


COERCION_HINTS_SQL = """
with o as (select 'c' || (o_custkey % 50) as source_id, case when o_custkey % 2 = 0 then o_orderkey % 5 <> 0 else o_orderkey % 5 = 0 end as looks from orders)
select source_id, 'code' as path, 'string' as dominant, case when count_if(looks) / count(*) >= 0.6 then 'strings_mostly_numeric' end as coercion from o group by 1
union all select distinct source_id, 'key', 'integer', null from o
"""


CATALOG = {
    "source_schema": (source_schema_q, SOURCE_SCHEMA_SQL),
    "coercion_hints": (coercion_hints, COERCION_HINTS_SQL),
    "example_values": (example_values_q, EXAMPLE_VALUES_SQL),
    "semantics_flags": (semantics_flags, SEMANTICS_FLAGS_SQL),
    "type_merge": (type_merge, TYPE_MERGE_SQL),
    "field_confidence": (field_confidence, FIELD_CONFIDENCE_SQL),
    "schema_fields": (schema_fields_q, SCHEMA_FIELDS_SQL),
    "path_stats": (path_stats_q, PATH_STATS_SQL),
    "pk_enum_coercion": (pk_enum_coercion, PK_ENUM_COERCION_SQL),
}
