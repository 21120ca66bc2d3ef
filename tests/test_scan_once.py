"""Texts are scanned once, in many tasks; what shortens the scan gives the same values."""

from __future__ import annotations

import json
import random

import yaml
from pyspark.sql import functions as F

from sievekit.functions import scanners
from sievekit.functions.typing import json_string_token
from sievekit.operators.extract import extract_fragments
from sievekit.operators.schema_tree import schema_tree
from sievekit.sources import render


def test_one_scan_in_the_plan(spark):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("s").alias("source_id"), F.concat(F.lit("a: "), "id").alias("text"))
    plan = extract_fragments(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_rows_are_dealt_to_many_tasks(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    dealt = render.rows(spark, str(tmp_path), "t")
    assert dealt.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in dealt.collect()) == list(range(100))


def test_plain_yaml_as_the_loader(spark):
    rnd = random.Random(3)
    words = ["yes", "No", "null", "~", "1", "007", "12.5", "1e5", "12.", "1_000", "0x1F", "1:30", "2024-01-01", "5-LOW", "x#y", "#c", "a,b", "-", "+1", "n/a", "TRUE", "c5@e.org", "08"]
    for _ in range(2000):
        text = "".join(f"{rnd.choice(['a', 'b_1', 'yes', 'null', 'k'])}: {' '.join(rnd.choices(words, k=rnd.randint(1, 3)))}\n" for _ in range(rnd.randint(1, 3)))
        got = []
        for load in (scanners._yaml_load, yaml.safe_load):
            try:
                got.append(repr(load(text)))
            except (ValueError, yaml.YAMLError) as e:
                got.append(type(e).__name__)
        assert got[0] == got[1], text


def test_string_tokens_as_to_json(spark):
    texts = [chr(c) for c in [*range(0x20A0), 0x1F600]] + ["", 'a"b', "a\\b", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_string_token("t").alias("token"), F.to_json(F.array("t")).alias("whole"))
    assert all(f"[{r.token}]" == r.whole for r in rows.collect())


def test_tree_of_any_depth_in_one_pass(spark):
    deep = '{"a":' * 300 + "1" + "}" * 300
    rows = [("s", deep), ("s", '{"a": 1.5, "l": [1, 2.5, [], {}, null], "e": ""}'), ("s", "no json"), ("s", '{"a": 123456789012345678901}'), ("s", None)]
    got = {r.path: (r.types, r.n, r.n_parent) for r in schema_tree(spark.createDataFrame(rows, "s string, data string"), ["s"]).collect()}
    assert got["$"] == (["object"], 3, 3)
    assert got["a"] == (["number", "object"], 3, 3)
    assert got["l[]"] == (["array", "null", "number", "object"], 5, 1)
    assert got["e"] == (["string"], 1, 3)
    assert got[".".join("a" * 300)] == (["integer"], 1, 1)
    assert json.loads(deep)
