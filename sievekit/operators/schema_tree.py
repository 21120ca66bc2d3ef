"""Nested schemas as trees of path rows: merged types, `required` by parent object, list items, diffs.

A node is a list of steps: `.name` for a property, `[]` for the items of a list. Texts are read as VARIANT and their nodes
counted in the tasks, in one pass whatever their depth. All counts are sums of
occurrences: names are unique in an object, so a property is required where it occurs as often as its parent occurs as an object.
Trees and diffs are rows, joined and grouped like any other; nothing is collected but the depth.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from sievekit.session import shared_dir

ITEMS = "[]"
NO_CHANGE, SAME_STRUCTURE = "No changes detected", "Schema structure unchanged"


def variant_kind(v: Column) -> Column:
    """JSON type of a VARIANT value; whole numbers are integers however large."""
    t = F.schema_of_variant(v)
    return (
        F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "BOOLEAN", "boolean").when(t == "VOID", "null")
        .when((t == "BIGINT") | t.rlike(r"^DECIMAL\(\d+,0\)$"), "integer").when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number").otherwise("string")
    )


def written(df: DataFrame) -> DataFrame:
    """The rows, computed once: a table in the folder that all executors share."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Nodes that a task holds before it hands its counts on.
MOST_NODES = 100_000
_KINDS = {dict: "object", list: "array", bool: "boolean", int: "integer", float: "number", str: "string", type(None): "null"}


class _Counts:
    """How often each node of some texts stands as each kind: a tree of [counts by kind, properties, items]."""

    def __init__(self) -> None:
        self.roots: dict[tuple, list] = {}
        self.nodes = 0

    def node(self) -> list:
        self.nodes += 1
        return [{}, {}, None]

    def add(self, key: tuple, value) -> None:
        if key not in self.roots:
            self.roots[key] = self.node()
        todo = [(value, self.roots[key])]
        while todo:
            v, node = todo.pop()
            kind = _KINDS[type(v)]
            node[0][kind] = node[0].get(kind, 0) + 1
            if kind == "object":
                names = node[1]
                for name, child in v.items():
                    if name not in names:
                        names[name] = self.node()
                    todo.append((child, names[name]))
            elif kind == "array" and v:
                if node[2] is None:
                    node[2] = self.node()
                todo += [(child, node[2]) for child in v]

    def rows(self):
        todo = [(key, [], root) for key, root in self.roots.items()]
        while todo:
            key, steps, (kinds, names, items) = todo.pop()
            yield from ((key, steps, kind, n) for kind, n in kinds.items())
            todo += [(key, [*steps, f".{name}"], node) for name, node in names.items()]
            if items:
                todo.append((key, [*steps, ITEMS], items))


def node_counts(records: DataFrame, by: list[str]) -> DataFrame:
    """Counts (by, steps, kind, n) of the nodes of records (by, data), one pass over the texts; a node may have several rows, to be added up.

    Spark reads the texts as VARIANT, so what is no JSON takes no part and numbers have its forms; a task adds up its own nodes before it hands them on.
    """
    texts = records.select(*by, F.to_json(F.try_parse_json("data")).alias("data")).filter("data IS NOT NULL")

    def count(batches):
        found = _Counts()

        def table():
            rows = [*found.rows()]
            keys = [pa.array([r[0][i] for r in rows], types[i]) for i in range(len(by))]
            rest = [pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64())]
            return pa.RecordBatch.from_arrays(keys + rest, [*by, "steps", "kind", "n"])

        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            columns = [batch.column(c).to_pylist() for c in (*by, "data")]
            for *key, text in zip(*columns):
                found.add(tuple(key), json.loads(text))
                if found.nodes > MOST_NODES:
                    yield table()
                    found = _Counts()
        if found.roots:
            yield table()

    schema = StructType([*(records.schema[c] for c in by), StructField("steps", ArrayType(StringType())), StructField("kind", StringType()), StructField("n", LongType())])
    return texts.mapInArrow(count, schema)


def schema_tree(records: DataFrame, by: list[str]) -> DataFrame:
    """Rule T21 as rows of records (by, data): (by, steps, path, types, n, n_parent, required).

    types are sorted, and integer is dropped beside number. n_parent: how often the parent is an object (for items: a list). The root
    is required; items are required where every list has one or more. Texts that are no JSON take no part.
    """
    counts = written(node_counts(records, by).groupBy(*by, "steps", "kind").agg(F.sum("n").alias("n")))
    nodes = counts.groupBy(*by, "steps").agg(F.array_sort(F.collect_set("kind")).alias("types"), F.sum("n").alias("n"))  # at most 7 kinds
    merged = F.when(F.array_contains("types", "number"), F.array_remove("types", "integer")).otherwise(F.col("types"))
    parents = counts.filter(F.col("kind").isin("object", "array")).select(*by, F.col("steps").alias("parent"), (F.col("kind") == "array").alias("of_items"), F.col("n").alias("n_parent"))
    nodes = nodes.withColumns({"parent": F.expr("slice(steps, 1, greatest(0, size(steps) - 1))"), "of_items": F.coalesce(F.element_at("steps", -1) == ITEMS, F.lit(False)), "types": merged})
    root = nodes.filter("size(steps) = 0").withColumn("n_parent", F.col("n"))
    below = nodes.filter("size(steps) > 0").join(parents, [*by, "parent", "of_items"])
    every = root.unionByName(below)
    return every.select(*by, "steps", path_text(F.col("steps")).alias("path"), "types", "n", "n_parent", (F.col("n") >= F.col("n_parent")).alias("required"))


def path_text(steps: Column) -> Column:
    """`a.b[].c`, `$` for the root."""
    return F.when(F.size(steps) == 0, "$").otherwise(F.regexp_replace(F.array_join(steps, ""), r"^\.", ""))


def _quoted(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def json_schema(tree: DataFrame, by: list[str]) -> DataFrame:
    """Rule T21 assembled: (by, json_schema), JSON text of the merged schema; properties and required in order of names.

    Trees are folded from the deepest level up, a grouping a level. A node of several kinds is an anyOf of its scalars, its list and its object.
    """
    depth = tree.agg(F.max(F.size("steps"))).first()[0]
    done = None
    for d in range(depth if depth is not None else -1, -1, -1):
        here = tree.filter(F.size("steps") == d)
        if done is None:
            here = here.withColumns({c: F.lit(None).cast("string") for c in ("properties", "req", "items")})
        else:
            here = here.join(done, [*by, "steps"], "left")
        scalars = F.filter("types", lambda t: ~t.isin("object", "array"))
        one = F.when(F.size(scalars) == 1, _quoted(scalars[0])).otherwise(F.to_json(scalars))
        body = lambda *parts: F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
        forms = F.array_compact(F.array(
            F.when(F.size(scalars) > 0, body(F.concat(F.lit('"type":'), one))),
            F.when(F.array_contains("types", "array"), body(F.lit('"type":"array"'), F.concat(F.lit('"items":'), F.col("items")))),
            F.when(F.array_contains("types", "object"), body(F.lit('"type":"object"'), F.concat(F.lit('"properties":{'), F.col("properties"), F.lit("}")), F.concat(F.lit('"required":['), F.col("req"), F.lit("]")))),
        ))
        text = F.when(F.size(forms) == 1, forms[0]).otherwise(F.concat(F.lit('{"anyOf":['), F.array_join(forms, ","), F.lit("]}")))
        node = here.withColumn("text", text)
        if not d:
            return node.select(*by, F.col("text").alias("json_schema"))
        step = F.element_at("steps", -1)
        name = _quoted(F.expr("substring(element_at(steps, -1), 2)"))
        node = node.select(*by, F.expr(f"slice(steps, 1, {d - 1})").alias("parent"), (step == ITEMS).alias("item"), name.alias("name"), "text", "required")
        node = node.withColumns({"pair": F.when(~F.col("item"), F.concat("name", F.lit(":"), "text")), "must": F.when(~F.col("item") & F.col("required"), F.col("name"))})
        done = written(node.groupBy(*by, F.col("parent").alias("steps")).agg(
            F.expr("listagg(pair, ',') within group (order by pair)").alias("properties"),
            F.expr("listagg(must, ',') within group (order by must)").alias("req"),
            F.max(F.when(F.col("item"), F.col("text"))).alias("items"),
        ))
    return tree.select(*by, F.lit("").alias("json_schema"))


def tree_fields(tree: DataFrame, by: list[str]) -> DataFrame:
    """Rule T22: the flat fields of a tree, (by, name, path, type, nullable): objects give way to their properties, lists are fields.

    type: the first that isn't null by name, `unknown` for a mixture with objects or lists, `string` where only nulls stand. nullable: null stands, or
    a parent object lacks it.
    """
    names = tree.filter("size(steps) > 0 AND NOT exists(steps, s -> s = '[]')")
    # below a mixture nothing is flattened: every object on the way must be one and nothing else
    mixed = tree.filter("size(types) > 1 OR types[0] <> 'object'").select(*by, F.col("steps").alias("above"))
    ways = names.select(*by, "steps", F.explode(F.expr("transform(sequence(0, greatest(0, size(steps) - 1)), i -> slice(steps, 1, i))")).alias("above"))
    hidden = ways.join(mixed, [*by, "above"]).select(*by, "steps").distinct()
    names = names.join(hidden, [*by, "steps"], "left_anti")
    inner = tree.filter("size(steps) > 0").select(*by, F.expr("slice(steps, 1, greatest(0, size(steps) - 1))").alias("steps")).distinct().withColumn("filled", F.lit(True))
    rest = F.array_remove("types", "null")
    kind = F.when(F.size(rest) == 0, "string").when((F.size(rest) > 1) & F.arrays_overlap(rest, F.array(F.lit("object"), F.lit("array"))), "unknown").otherwise(F.get(rest, F.lit(0)))
    names = names.join(inner, [*by, "steps"], "left").filter("NOT (types = array('object') AND coalesce(filled, false))")
    nullable = F.array_contains("types", "null") | ~F.col("required")
    return names.select(*by, F.expr("substring(element_at(steps, -1), 2)").alias("name"), "path", kind.alias("type"), nullable.alias("nullable"))


def tree_diff(tree: DataFrame, source: str = "source_id") -> DataFrame:
    """Rule V5: what changed from each version of a source's tree to the next, (source, from_version, to_version, path, change, old, new).

    change: added, removed, type or required. Order doesn't matter. Only the highest node of what was added or removed is reported, and
    nothing below a node whose type change brought or took its properties or items.
    """
    new = tree.select(source, "version", "steps", "path", F.array_join("types", "|").alias("new"), F.col("required").alias("new_required"))
    old = tree.select(source, (F.col("version") + 1).alias("version"), "steps", F.col("path").alias("old_path"), F.array_join("types", "|").alias("old"), F.col("required").alias("old_required"))
    versions = tree.select(source, "version").distinct()
    pairs = versions.join(versions.select(source, (F.col("version") + 1).alias("version")), [source, "version"])
    both = old.join(new, [source, "version", "steps"], "full_outer").join(pairs, [source, "version"])
    inner = lambda c: F.coalesce(F.col(c), F.lit("")).rlike("object|array")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "type").when(F.col("old_required") != F.col("new_required"), "required")
    changed = written(both.withColumn("change", change).filter("change IS NOT NULL"))
    covers = changed.filter((F.col("change") != "required") & (F.col("change").isin("added", "removed") | (inner("old") != inner("new"))))
    covers = covers.select(source, "version", F.col("steps").alias("parent"))
    rows = changed.withColumn("parent", F.expr("slice(steps, 1, greatest(0, size(steps) - 1))"))
    inside = rows.filter("change IN ('added', 'removed') AND size(steps) > 0").join(covers, [source, "version", "parent"], "left_semi").select(source, "version", "steps")
    rows = rows.join(inside, [source, "version", "steps"], "left_anti")
    shown = lambda c: F.when(F.col("change") == "required", F.col(f"{c}_required").cast("string")).otherwise(F.col(c))
    return rows.select(source, (F.col("version") - 1).alias("from_version"), F.col("version").alias("to_version"), F.coalesce("path", "old_path").alias("path"), "change", shown("old").alias("old"), shown("new").alias("new"))


def diff_notes(tree: DataFrame, source: str = "source_id") -> DataFrame:
    """Rules V6 and V7: one row a pair of neighbouring versions, with sorted lists of paths, notes, and whether the structure changed."""
    diff = tree_diff(tree, source)
    versions = tree.select(source, "version").distinct()
    pairs = versions.join(versions.select(source, (F.col("version") + 1).alias("version")), [source, "version"]).select(source, (F.col("version") - 1).alias("from_version"), F.col("version").alias("to_version"))
    of = lambda kind, text: F.array_sort(F.collect_list(F.when(F.col("change") == kind, text)))
    each = diff.groupBy(source, "from_version", "to_version").agg(
        of("added", F.col("path")).alias("added"),
        of("removed", F.col("path")).alias("removed"),
        of("type", F.concat(F.lit("Type changed for '"), F.col("path"), F.lit("': "), F.col("old"), F.lit(" → "), F.col("new"))).alias("type_changes"),
        F.count(F.lit(1)).alias("n"),
    )
    rows = pairs.join(each, [source, "from_version", "to_version"], "left")
    listed = lambda c, head: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(c, ", ")))
    said = F.concat_ws("; ", listed("added", "Added fields: "), listed("removed", "Removed fields: "), F.when(F.size("type_changes") > 0, F.array_join("type_changes", "; ")))
    notes = F.when(F.col("n").isNull(), NO_CHANGE).when(said == "", SAME_STRUCTURE).otherwise(said)
    none = F.array().cast("array<string>")
    structural = F.coalesce(F.size("added") + F.size("removed") + F.size("type_changes") > 0, F.lit(False))
    return rows.select(source, "from_version", "to_version", *(F.coalesce(c, none).alias(c) for c in ("added", "removed", "type_changes")), notes.alias("notes"), structural.alias("structural"))
