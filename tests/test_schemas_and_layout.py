"""Nested schemas, the registry and clustered layout on small inline inputs."""

import json

from pyspark.sql import functions as F

from sievekit.operators.registry import duplicates, exact_versions, history, latest_versions, register, registered
from sievekit.operators.schema_tree import NO_CHANGE, SAME_STRUCTURE, diff_notes, json_schema, schema_tree, tree_diff, tree_fields
from sievekit.sources import layout, tables


def tree(spark, *batches):
    rows = [("s", v, t if isinstance(t, str) else json.dumps(t)) for v, texts in enumerate(batches, 1) for t in texts]
    return schema_tree(spark.createDataFrame(rows, "source_id string, version int, data string"), ["source_id", "version"])


def test_required_is_counted_by_parent(spark):
    got = tree(spark, [{"a": [{"x": 1, "y": None}, {"x": 2.5}], "o": {}}, {"a": [], "o": {"p": "t"}}, "no json", {"a": [[1]], "o": {}, "a.b": True}])
    rows = {r.path if r.steps != [".a.b"] else "dotted": (r.types, r.n, r.n_parent, r.required) for r in got.collect()}
    assert rows == {
        "$": (["object"], 3, 3, True), "a": (["array"], 3, 3, True), "o": (["object"], 3, 3, True), "dotted": (["boolean"], 1, 3, False),
        "a[]": (["array", "object"], 3, 3, True), "a[][]": (["integer"], 1, 1, True), "a[].x": (["number"], 2, 2, True),
        "a[].y": (["null"], 1, 2, False), "o.p": (["string"], 1, 3, False),
    }


def test_assembled_schema_is_json(spark):
    got = json_schema(tree(spark, [{"b": {"c": 1, "q\"": "x"}, "l": [1, "s"]}, {"b": {"c": None}, "e": []}, {"b": 3, "e": [{"k": 1}]}]), ["source_id", "version"])
    assert json.loads(got.first().json_schema) == {
        "type": "object", "required": ["b"],
        "properties": {
            "b": {"anyOf": [{"type": "integer"}, {"type": "object", "properties": {"c": {"type": ["integer", "null"]}, 'q"': {"type": "string"}}, "required": ["c"]}]},
            "l": {"type": "array", "items": {"type": ["integer", "string"]}},
            "e": {"type": "array", "items": {"type": "object", "properties": {"k": {"type": "integer"}}, "required": ["k"]}},
        },
    }


def test_flat_fields(spark):
    got = tree_fields(tree(spark, [{"a": {"b": {"c": 1}, "e": {}}, "n": None, "l": [{"z": 1}], "m": {"u": 1}}, {"a": {"b": {"c": None}, "e": {}}, "n": None, "m": 1}]), ["source_id", "version"])
    assert {(r.path, r.name, r.type, r.nullable) for r in got.collect()} == {("a.b.c", "c", "integer", True), ("a.e", "e", "object", False), ("n", "n", "string", True), ("l", "l", "array", True), ("m", "m", "unknown", False)}


def test_diff_rolls_up_to_the_highest_ancestor(spark):
    v1 = [{"k": 1, "gone": {"x": {"y": 1}}, "l": [{"t": 1}], "o": {"p": 1}}]
    v2 = [{"k": 1, "new": {"d": [{"e": 1}]}, "l": [{"t": "s"}], "o": "flat"}]
    t = tree(spark, v1, v2, v2, [{"k": 1, "l": [{"t": "s"}], "o": "flat"}, *v2])
    rows = {(r.from_version, r.path, r.change, r.old, r.new) for r in tree_diff(t).collect()}
    assert rows == {
        (1, "new", "added", None, "object"), (1, "gone", "removed", "object", None), (1, "l[].t", "type", "integer", "string"),
        (1, "o", "type", "object", "string"), (3, "new", "required", "true", "false"),
    }
    notes = {r.from_version: (r.notes, r.structural) for r in diff_notes(t).collect()}
    said = "Added fields: new; Removed fields: gone; Type changed for 'l[].t': integer → string; Type changed for 'o': object → string"
    assert notes == {1: (said, True), 2: (NO_CHANGE, False), 3: (SAME_STRUCTURE, False)}


def test_empty_tree(spark):
    t = tree(spark, ["not json"])
    assert t.collect() == [] and tree_fields(t, ["source_id", "version"]).collect() == [] and json_schema(t, ["source_id", "version"]).collect() == []
    assert diff_notes(t).collect() == []


def test_registry_reads_the_newest_row_and_history(spark, tmp_path):
    schema = "schema_id string, source_id string, version int, signature string, fields array<struct<name: string, type: string>>, generated_at int"
    one = [("a1", "a", 1, "x", [("k", "integer")], 1), ("a2", "a", 2, "y", [("k", "string"), ("n", "string")], 2), ("b1", "b", 1, "z", [], 1)]
    path = f"{tmp_path}/registry"
    register(spark.createDataFrame(one, schema), path)
    register(spark.createDataFrame([("a2", "a", 2, "w", [("k", "number"), ("m", "string")], 3)], schema), path)
    got = registered(spark, path, spark.createDataFrame([], schema).schema)
    assert got.count() == 3
    rows = {(r.source_id, r.version): (r.added, r.removed, r.retyped) for r in history(got).collect()}
    assert rows == {("a", 1): (None, None, None), ("a", 2): (["m"], [], ["k"]), ("b", 1): (None, None, None)}
    asked = spark.createDataFrame([("a", 2), ("a", 9)], "source_id string, version int")
    assert {(r.version, r.found, r.signature) for r in exact_versions(got, asked).collect()} == {(2, True, "w"), (9, False, None)}
    sources = spark.createDataFrame([("a",), ("c",)], "source_id string")
    assert {tuple(r) for r in latest_versions(got, sources).collect()} == {("a", 2), ("c", 0)}
    uploads = spark.createDataFrame([("a", "w"), ("a", "x"), ("c", "x")], "source_id string, signature string")
    assert {tuple(r) for r in duplicates(uploads, got).collect()} == {("a", "w", True), ("a", "x", False), ("c", "x", False)}


def test_clustered_files_are_skipped(spark, tmp_path):
    rows = spark.range(40_000).select(F.expr("cast(hash(id) % 1000 as int)").alias("n"), F.when(F.col("id") % 50 != 0, F.concat(F.lit("k"), F.hash("id", F.lit(1)) % 500)).alias("t"), (F.col("id") % 3 == 0).alias("b"))
    layout.write_clustered(rows, f"{tmp_path}/c", ["n", "t", "b"], files=24)
    rows.repartition(24).write.parquet(f"{tmp_path}/p")
    back = spark.read.parquet(f"{tmp_path}/c")
    assert back.exceptAll(rows).isEmpty() and back.count() == 40_000
    near = lambda p, r: layout.files_overlapping(spark.read.parquet(f"{tmp_path}/{p}"), r).first().n
    for ranges in ({"n": (100, 140)}, {"t": ("k1", "k12")}, {"n": (0, 300), "t": ("k2", "k3")}):
        assert near("c", ranges) <= 0.6 * near("p", ranges), ranges


def test_extra_fields_are_dropped_and_ddl(spark):
    records = spark.createDataFrame([("1", [("a", "integer", "1"), ("zzz", "string", '"x"')]), ("2", [("a", "string", '"x"')])], "record_id string, fields array<struct<name: string, jtype: string, token: string>>")
    fields = [("a", "integer", False)]
    rows, rejects = tables.aligned(records, fields)
    assert [tuple(r) for r in rows.collect()] == [("1", 1)] and [tuple(r) for r in rejects.collect()] == [("2", "bad type for a")]
    assert tables.ddl(fields) == "`a` bigint NOT NULL"
