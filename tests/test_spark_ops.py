"""Column functions and operators on small inline inputs."""

import pytest
from pyspark.sql import functions as F

from sievekit.functions.typing import infer_csv_value, infer_html_value, infer_kv_value, standardize_kv_key, standardize_table_key
from sievekit.operators.extract import extract_fragments, kv_parse
from sievekit.operators.grouping import jaccard
from sievekit.operators.normalize import build_records
from sievekit.operators.query import QueryError, execute_query


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


def test_kv_line_rules(spark):
    assert one(spark, kv_parse, "http://x").asDict() == {"k": "http", "v": "//x"}
    assert one(spark, kv_parse, "a.b: 1") is None
    assert one(spark, kv_parse, "- item: 1") is None
    assert one(spark, kv_parse, "k" * 50 + ": v") is not None
    assert one(spark, kv_parse, "k" * 51 + ": v") is None


@pytest.mark.parametrize("raw,kv,csv,html", [
    ("1,000", ("string", '"1,000"'), ("number", "1.0"), ("number", "1000.0")),
    ("00123", ("integer", "123"), ("integer", "123"), ("integer", "123")),
    ("1e5", ("number", "100000.0"), ("string", '"1e5"'), ("number", "100000.0")),
    ("yes", ("string", '"yes"'), ("boolean", "true"), ("boolean", "true")),
    ("-", ("null", "null"), ("string", '"-"'), ("string", '"-"')),
])
def test_value_rules(spark, raw, kv, csv, html):
    for fn, want in ((infer_kv_value, kv), (infer_csv_value, csv), (infer_html_value, html)):
        got = one(spark, fn, raw)
        assert (got["jtype"], got["token"]) == want, (fn.__name__, raw)


def test_key_cleaning(spark):
    assert one(spark, standardize_kv_key, " User--Name! ") == "user_name"
    assert one(spark, standardize_table_key, "Nation-Name") == "nation_name"
    assert one(spark, standardize_kv_key, "!!") == "unknown"


def _records(spark, text):
    docs = spark.createDataFrame([(1, "s", text)], "doc_id long, source_id string, text string")
    return build_records(extract_fragments(docs))


def test_kv_block_blank_line_and_json_touch(spark):
    recs = _records(spark, 'a: 1\n\nb: 2\nc: 3\n{"x": 1}\n').filter("source_type = 'kv'").collect()
    assert len(recs) == 1
    assert [f["name"] for f in recs[0]["fields"]] == ["a", "b"]  # 'c' line ends where '{' starts


def test_duplicate_keys_last_wins(spark):
    recs = _records(spark, "x: 1\ny: 2\nx: 3\n").filter("source_type = 'kv'").collect()
    assert [(f["name"], f["token"]) for f in recs[0]["fields"]] == [("x", "3"), ("y", "2")]


def test_jaccard_edges(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r["j"] for r in df.select(jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [1.0, 0.0, 1 / 3]


def test_query_errors_and_limit_zero(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, s string")
    with pytest.raises(QueryError):
        execute_query({"engine": "sqlite", "where": {"nope": 1}}, table=t)
    with pytest.raises(QueryError):
        execute_query({"engine": "sqlite", "where": {"k": {"$regex": 1}}}, table=t)
    with pytest.raises(QueryError):
        execute_query({"engine": "sqlite", "where": {"k": {}}}, table=t)
    docs = t.select(F.parse_json(F.to_json(F.struct("k", "s"))).alias("_v"))
    assert execute_query({"filter": {}, "limit": 0}, documents=docs).count() == 2
    assert execute_query({"filter": {"k": {"$gt": 1}}}, documents=docs).count() == 1


def test_document_conditions_compare_like_with_like(spark):
    data = ['{"k":1,"a":2000}', '{"k":2,"a":"2000"}', '{"k":3,"a":true}', '{"k":4,"a":null}', '{"k":5}', '{"k":6,"a":[1,2000]}',
            '{"k":7,"a":9007199254740993}', '{"k":8,"a":2000.0}', '{"k":9,"i":[{"s":"x"},{"s":"y"}]}']
    docs = spark.createDataFrame([(d,) for d in data], "d string").selectExpr("parse_json(d) AS _v")

    def asked(condition, **more):
        rows = execute_query({"filter": condition, **more}, documents=docs).selectExpr("variant_get(_v, '$.k', 'int') AS k").collect()
        return [r.k for r in rows]

    assert sorted(asked({"a": 2000})) == [1, 6, 8] and asked({"a": "2000"}) == [2] and asked({"a": True}) == [3]
    assert sorted(asked({"a": {"$gt": 1000}})) == [1, 6, 7, 8] and asked({"a": 9007199254740992}) == []
    assert sorted(asked({"a": {"$in": [2000, "2000", "zz"]}})) == [1, 2, 6, 8]
    assert sorted(asked({"a": None})) == [4, 5, 9] and sorted(asked({"a": {"$exists": False}})) == [5, 9]
    assert asked({"i.s": "y"}) == [9] and asked({"a": {"$like": "20%"}}) == [2]
    assert 3 in asked({"a": {"$ne": 2000}}) and 6 not in asked({"a": {"$ne": 2000}})
    assert asked({"a": {"$exists": True}}, sort=[["a", 1]])[:4] == [4, 1, 8, 7]
    assert len(asked({})) == 9 and len(asked({}, limit=3)) == 3
    assert len(execute_query({"filter": {}, "limit": 5}, documents=docs, limits=(2, 3)).collect()) == 3


def test_csv_confidence_by_width_and_delimiter(spark):
    texts = ["a,b\n1,2\n3,4\n", "a,b\n1,2\n3,4,5\n", "a;b,c\n1;2;3\n3;4;5\n"]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source_id string, text string")
    got = {r.doc_id: (r.delimiter, r.confidence) for r in extract_fragments(docs).filter("source_type = 'csv_block'").collect()}
    assert got[0] == (",", 0.95) and got[1] == (",", 0.7 + 0.1)
    assert all(c in (0.7, 0.7 + 0.1, 0.7 + 0.15, 0.95) for _, c in got.values())
