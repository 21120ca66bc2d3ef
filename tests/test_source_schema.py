"""Schema of fragments of mixed kinds (T20), edge cases."""

from sievekit.operators.profile import source_schema, value_records


def test_values_of_any_kind_are_wrapped(spark):
    texts = ['{"b": 1, "a": {"x": [1, null]}}', "{}", "12", "1.5", "true", '"quoted"', "plain \"text\"", "", "null", None, "[1, {}]", "{broken"]
    rows = value_records(spark.createDataFrame(list(enumerate(texts)), "ord int, value string")).orderBy("ord").collect()
    assert [[tuple(f) for f in r.fields] for r in rows] == [
        [("a", "object", '{"x":[1,null]}'), ("b", "integer", "1")], [], [("value", "integer", "12")], [("value", "number", "1.5")],
        [("value", "boolean", "true")], [("value", "string", '"quoted"')], [("value", "string", '"plain \\"text\\""')], [("value", "string", '""')],
        [("value", "null", "null")], [("value", "null", "null")], [("value", "array", "[1,{}]")], [("value", "string", '"{broken"')],
    ]


def test_objects_count_as_records_without_the_field(spark):
    data = [("s", 0, '{"value": 3}'), ("s", 1, "4"), ("s", 2, "{}"), ("s", 2, "x"), ("t", 0, "{}")]
    got = source_schema(spark.createDataFrame(data, "source_id string, ord int, value string"), ["source_id"]).collect()
    assert [(r.source_id, r.name, r.type, r.nullable, r.example_value, r.occurrences, r.total_records) for r in got] == [("s", "value", "integer", True, "3", 3, 4)]


def test_empty_table(spark):
    assert source_schema(spark.createDataFrame([], "source_id string, ord int, value string"), ["source_id"]).count() == 0
