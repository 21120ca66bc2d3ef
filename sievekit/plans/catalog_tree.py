"""Registered queries for nested schemas: trees, assembled JSON schemas, flat fields, diffs of versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.operators.extract import extract_fragments
from sievekit.operators.normalize import build_records
from sievekit.operators.profile import schema_signature
from sievekit.operators.schema_tree import diff_notes, json_schema, schema_tree, tree_diff, tree_fields
from sievekit.sources import render

BY = ["source_id", "version"]


def _tree(spark, sf):
    keys = ("doc_id", *BY)
    records = build_records(extract_fragments(render.tree_orders(spark, sf), keep_cols=keys), key_cols=keys)
    return schema_tree(records.filter(F.col("source_type") == "json").select(*BY, "data"), BY)


def schema_tree_q(spark, sf):
    """Every path of the nested documents with its types, how often it and its parent stand, and whether it is required."""
    return _tree(spark, sf).select(*BY, "path", F.array_join("types", "|").alias("types"), "n", "n_parent", "required")


# paths of each document shape, counted from the base tables
_TREE = """
with o as (select *, case when year(o_orderdate) >= 1998 then 2 else 1 end as version,
                  year(o_orderdate) >= 1998 and o_orderpriority not like '5%' as new from orders),
l as (select o_orderpriority as source_id, version, new, l_discount, l_tax, l_orderkey from lineitem join o on l_orderkey = o_orderkey),
nodes as (
  select o_orderpriority as source_id, version, '$' as path, 'object' as types, count(*) as n, count(*) as n_parent from o group by all
  union all select o_orderpriority, version, 'id', 'integer', count(*), count(*) from o group by all
  union all select o_orderpriority, version, 'lines', 'array', count(*), count(*) from o group by all
  union all select o_orderpriority, version, 'old', 'object', count(*), count(*) from o group by all
  union all select o_orderpriority, version, 'old.key', 'integer', count(*), count(*) from o group by all
  union all select o_orderpriority, version, 'note', 'string', count(*) filter (o_orderkey % 3 = 0), count(*) from o group by all
  union all select o_orderpriority, version, 'old.code', 'string', count(*) filter (not new), count(*) from o group by all
  union all select o_orderpriority, version, 'ship', 'object', count(*) filter (new), count(*) from o group by all
  union all select o_orderpriority, version, 'ship.mode', 'string', count(*) filter (new), count(*) filter (new) from o group by all
  union all select o_orderpriority, version, 'ship.days', 'integer', count(*) filter (new), count(*) filter (new) from o group by all
  union all select o.o_orderpriority, o.version, 'lines[]', 'object', (select count(*) from l where l.source_id = o.o_orderpriority and l.version = o.version), count(*) from o group by all
  union all select source_id, version, 'lines[].n', 'integer', count(*), count(*) from l group by all
  union all select source_id, version, 'lines[].qty', case when max(new) then 'string' else 'integer' end, count(*), count(*) from l group by all
  union all select source_id, version, 'lines[].disc', 'number', count(*) filter (l_discount > 0), count(*) from l group by all
  union all select source_id, version, 'lines[].tax',
                   case when count(*) filter (l_tax > 0) = 0 then 'null' when count(*) filter (l_tax <= 0) = 0 then 'number' else 'null|number' end, count(*), count(*) from l group by all),
tree as (select *, n >= n_parent as required from nodes where n > 0)
"""
SCHEMA_TREE_SQL = _TREE + "select * from tree"


def tree_fields_q(spark, sf):
    """The flat fields of the nested schemas."""
    return tree_fields(_tree(spark, sf), BY)


TREE_FIELDS_SQL = _TREE + """
select source_id, version, split_part(path, '.', -1) as name, path, types as type, not required as nullable
from tree where path not like '%[]%' and types <> 'object'
"""


def json_schema_q(spark, sf):
    """The assembled JSON schema of each batch, and the signature of its structure."""
    tree = _tree(spark, sf)
    sig = schema_signature(tree.select(*BY, "path", "types", "required"), BY).select(*BY, "signature")
    return json_schema(tree, BY).join(sig, BY)


JSON_SCHEMA_SQL = _TREE + """,
sig as (select source_id, version, substr(sha256(string_agg(path || '|' || replace(types, '|', ',') || '|' || required::varchar, ';'
               order by path || '|' || replace(types, '|', ',') || '|' || required::varchar)), 1, 16) as signature from tree group by all),
leaf as (select source_id, version, path, required, case types
           when 'null|number' then '{"type":["null","number"]}' when 'object' then null when 'array' then null else '{"type":"' || types || '"}' end as text,
           split_part(path, '.', -1) as name from tree where path <> '$'),
inner_ as (select source_id, version, case when path like 'lines[].%' then 'lines' else split_part(path, '.', 1) end as parent,
             '{"type":"object","properties":{' || string_agg('"' || name || '":' || text, ',' order by '"' || name || '":' || text) || '}'
             || coalesce(',"required":[' || string_agg('"' || name || '"', ',' order by name) filter (required) || ']', '') || '}' as text
           from leaf where path like '%.%' group by all),
top as (select l.source_id, l.version, l.name, l.required,
          coalesce(l.text, case when l.path = 'lines' then '{"type":"array","items":' || i.text || '}' else i.text end) as text
        from leaf l left join inner_ i on i.source_id = l.source_id and i.version = l.version and i.parent = l.path
        where l.path not like '%.%' and l.path <> 'lines[]')
select source_id, version, '{"type":"object","properties":{' || string_agg('"' || name || '":' || text, ',' order by '"' || name || '":' || text) || '},"required":['
       || string_agg('"' || name || '"', ',' order by name) filter (required) || ']}' as json_schema, any_value(signature) as signature
from top join sig using (source_id, version) group by source_id, version
"""


def nested_schema_diff(spark, sf):
    """What changed in the nested schemas from one version to the next, as paths and as notes."""
    tree = _tree(spark, sf)
    rows = tree_diff(tree).filter("change <> 'required'").select("source_id", "path", "change", "old", "new")
    notes = diff_notes(tree).select("source_id", F.lit("*").alias("path"), F.col("structural").cast("string").alias("change"), F.lit(None).cast("string").alias("old"), F.col("notes").alias("new"))
    return rows.union(notes)


NESTED_SCHEMA_DIFF_SQL = _TREE + """,
sides as (select coalesce(a.source_id, b.source_id) as source_id, coalesce(a.path, b.path) as path, a.types as old, b.types as new
         from (select * from tree where version = 1) a full join (select * from tree where version = 2) b on a.source_id = b.source_id and a.path = b.path),
diff as (select source_id, path, case when old is null then 'added' when new is null then 'removed' else 'type' end as change, old, new
         from sides where old is distinct from new
           and not (old is null and path like 'ship.%')),
notes as (select s.source_id, count(path) > 0 as structural,
            concat_ws('; ', 'Added fields: ' || string_agg(path, ', ' order by path) filter (change = 'added'),
                            'Removed fields: ' || string_agg(path, ', ' order by path) filter (change = 'removed'),
                            string_agg('Type changed for ''' || path || ''': ' || old || ' → ' || new, '; ' order by path) filter (change = 'type')) as said,
            any_value(req.n) as n_required
          from (select distinct source_id from tree) s left join diff using (source_id)
          left join (select a.source_id, count(*) as n from tree a join tree b on a.source_id = b.source_id and a.path = b.path and a.version = 1 and b.version = 2
                     where a.required <> b.required group by 1) req on req.source_id = s.source_id group by s.source_id)
select source_id, path, change, old, new from diff
union all
select source_id, '*', structural::varchar, null, case when structural then said when coalesce(n_required, 0) > 0 then 'Schema structure unchanged' else 'No changes detected' end from notes
"""

CATALOG = {
    "schema_tree": (schema_tree_q, SCHEMA_TREE_SQL),
    "tree_fields": (tree_fields_q, TREE_FIELDS_SQL),
    "json_schema": (json_schema_q, JSON_SCHEMA_SQL),
    "nested_schema_diff": (nested_schema_diff, NESTED_SCHEMA_DIFF_SQL),
}
