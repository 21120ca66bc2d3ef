"""What makes extraction cheaper gives the same values, and queries that read records more than once scan their texts once."""

from __future__ import annotations

import json
import random

import pytest
import yaml
from pyspark.sql import functions as F

from sievekit.functions import scanners
from sievekit.functions.typing import infer_kv_value, py_strip, standardize_kv_key
from sievekit.operators.extract import extract_fragments
from sievekit.operators.normalize import build_records
from sievekit.plans import catalog_profile, pipeline
from sievekit.plans.registry import all_entries
from sievekit.sources import render


def _spans_by_character(text: str) -> list[tuple[int, int]]:
    """Rule E1/E5 as it is written: one character after the other."""
    spans, start = [], text.find("{")
    while start != -1:
        depth, in_string, at = 1, False, start + 1
        while depth and at < len(text):
            ch = text[at]
            if ch == "\\":
                at += 1
            elif ch == '"':
                in_string = not in_string
            elif not in_string and ch in "{}":
                depth += 1 if ch == "{" else -1
            at += 1
        if depth:
            return spans
        spans.append((start, at))
        start = text.find("{", at)
    return spans


def test_braces_as_by_character():
    rnd = random.Random(1)
    for i in range(20_000):
        text = "".join(rnd.choices('{}"\\ a\n' if i % 2 else '{}"\\', k=rnd.randint(0, 14)))
        assert scanners.brace_spans(text) == _spans_by_character(text), text


def test_entries_of_lines_with_other_ends():
    rnd = random.Random(2)
    parts = ["a: 1", "b:2", "a:", "x", "\n", "\r\n", "\r", "\x0b", "\x85", " ", " ", "\n\n", "k-1: v"]
    for _ in range(20_000):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 10)))
        for block in scanners.kv_blocks(text, []):
            pairs = dict(filter(None, map(scanners.kv_line, block["raw"].split("\n"))))
            assert block["entries"] == [{"k": k, "v": v} for k, v in pairs.items()], repr(text)


def test_record_content_of_nested_and_odd_names():
    found = scanners.json_fragments('{"a": {"b": [1, {"c": NaN}]}, "": "1e5", "n": Infinity, "t": true}')[0]
    assert json.loads(found["data"]) == {"a": {"b": [1, {"c": "NaN"}]}, "": 100000.0, "n": "Infinity", "t": True}
    assert [p[0] for p in found["paths"]] == ["a.b[]", "a.b.c", "value", "n", "t"]
    assert [f[0] for f in found["fields"]] == ["a", "", "n", "t"]
    front = scanners.yaml_blocks("---\n1: a\n'1': b\n---\n")[0]
    assert (front["data"], [f[0] for f in front["fields"]]) == ('{"1":"b"}', ["1", "1"])


def test_quoted_and_hyphenated_yaml_without_the_loader(monkeypatch):
    rnd = random.Random(3)
    words = ["yes", "1", "007", "12.5", "5-LOW", "C#0", '"x y"', '"1"', '""', '" a: b "', '"#"', "x:", "#c"]
    texts = ["".join(f"{rnd.choice(['a', 'yes', 'Acct-Bal', 'n-', 'x--y'])}: {' '.join(rnd.choices(words, k=rnd.choice([1, 1, 2])))}{rnd.choice(['', chr(10)])}\n"
                     for _ in range(rnd.randint(1, 3))) for _ in range(2000)]
    for text in texts:
        got = []
        for load in (scanners._yaml_load, yaml.safe_load):
            try:
                got.append(repr(load(text)))
            except yaml.YAMLError as e:
                got.append(type(e).__name__)
        assert got[0] == got[1], text
    monkeypatch.setattr(scanners.yaml, "load", lambda *a, **k: pytest.fail("the loader was asked"))
    assert scanners._yaml_load('Acct-Bal: 1.5\n\ncode: "12"\n') == {"Acct-Bal": 1.5, "code": "12"}


def test_tags_in_a_run_as_one_by_one(monkeypatch):
    rnd = random.Random(4)
    tags = ["<table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "<div>", "</div>", "<br>", "<tD>", "<td class=x>", "<script>", "</script>", "<title>", "</title>",
            "x", " ", "&amp;", "<!-- c -->", "<tbody>", "</tbody>", "<thead>", "</thead>", "<", "<a-b>"]
    texts = ["<table>" + "".join(rnd.choices(tags, k=rnd.randint(0, 14))) + "</table>" for _ in range(5000)]
    runs = [scanners.html_tables(t) for t in texts]
    monkeypatch.delattr(scanners._TableEvents, "parse_starttag")
    assert runs == [scanners.html_tables(t) for t in texts]


def test_typing_of_stripped_texts_and_clean_keys(spark):
    keys = ["Acct-Bal", "a b", "_a", "a__b", "A", "", "é", "-", "a1_b2", "ß x", "a\n", None]
    want = ["acct_bal", "a_b", "a", "a_b", "a", "unknown", "unknown", "unknown", "a1_b2", "x", "a", None]
    got = spark.createDataFrame(list(enumerate(keys)), "i int, k string").orderBy("i").select(standardize_kv_key("k").alias("k")).collect()
    assert [r.k for r in got] == want
    texts = ["a", " a", "a ", " a", "a ", "é", " é ", "", " ", "a\nb", "a\n", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(py_strip("t").alias("t")).collect()
    assert [r.t for r in got] == [t if t is None else t.strip() for t in texts]
    values = ["inf", "NaN", "Infinity", "TRUE", "n/a", "None", "e5", "x1", "İnf", "-inf", "1e5", "2024-01-01"]
    got = spark.createDataFrame(list(enumerate(values)), "i int, t string").orderBy("i").select(infer_kv_value("t").alias("v")).collect()
    assert [(r.v.jtype, r.v.token) for r in got] == [
        ("number", '"Infinity"'), ("number", '"NaN"'), ("number", '"Infinity"'), ("boolean", "true"), ("null", "null"), ("null", "null"), ("string", '"e5"'),
        ("string", '"x1"'), ("string", '"İnf"'), ("number", '"-Infinity"'), ("number", "100000.0"), ("string", '"2024-01-01"')]


def test_values_are_typed_once_in_the_plan(spark):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("s").alias("source_id"), F.concat(F.lit("a: "), "id").alias("text"))
    plan = build_records(extract_fragments(docs)).select("fields")._jdf.queryExecution().optimizedPlan().toString()
    assert "size(CASE" not in plan


@pytest.mark.parametrize("name", ["flatten_serialize", "group_tables", "duplicate_upload", "validate_records", "coercion_hints"])
def test_what_the_result_reads_is_written(spark, tmp_path, name):
    """The plan of the result scans no text: the records were written in one scan."""
    rows = [(k, k + 7, "FO"[k % 2], 10.0 * k, "1-URGENT") for k in range(1, 31)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    orders.withColumn("o_orderdate", F.expr("make_date(1996 + int(o_orderkey % 4), 1, 1)")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, 1, 5.0) for k in range(1, 31)], "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"C#{k}", "S", 1.5 * k, k % 3) for k in range(1, 31)], "c_custkey long, c_name string, c_mktsegment string, c_acctbal double, c_nationkey int").write.parquet(
        f"{tmp_path}/customer.parquet")
    result = all_entries()[name][0](spark, str(tmp_path))
    assert "ArrowEvalPython" not in result._jdf.queryExecution().optimizedPlan().toString()
    assert result.count() > 0


def test_pipeline_scans_once(spark):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("s").alias("source_id"), F.concat(F.lit("a: "), "id").alias("text"))
    result = pipeline.run_pipeline(docs)
    assert "ArrowEvalPython" not in result._jdf.queryExecution().optimizedPlan().toString()
    assert result.first().total_records == 10


def test_coercion_hints_deal_their_rows(monkeypatch, spark):
    asked = []
    monkeypatch.setattr(render, "rows", lambda spark, sf, name: asked.append(name) or (_ for _ in ()).throw(StopAsyncIteration))
    with pytest.raises(StopAsyncIteration):
        catalog_profile.coercion_hints(spark, "none")
    assert asked == ["orders"]
