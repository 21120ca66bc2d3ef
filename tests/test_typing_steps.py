"""Cheaper steps of the typing give what the rules say, and are taken."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.functions.typing import infer_csv_value, infer_kv_value
from sievekit.operators.normalize import dedupe_last


def test_entries_are_typed_once(spark):
    """The folded array is read several times, what makes it is not."""
    rows = spark.range(4).select(dedupe_last(F.transform(F.sequence(F.lit(0), F.col("id")), lambda i: F.struct(F.element_at(F.array(*map(F.lit, "aba")), i.cast("int") % 3 + 1).alias("name"), i.alias("v")))).alias("x"))
    assert [[tuple(e) for e in r.x] for r in rows.collect()] == [[("a", 0)], [("a", 0), ("b", 1)], [("a", 2), ("b", 1)], [("a", 3), ("b", 1)]]
    entries = spark.createDataFrame([([("a", 1)],)], "e array<struct<name:string,v:int>>")
    plan = entries.select(dedupe_last(F.reverse("e")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(") == 1


def test_tokens_of_numbers_and_words(spark):
    values = ["0", "-0", "+5", "007", "1_0", "12", "-12", "1e400", "-1e400", "1_0.5", ".5", "5.", "-inf", "nan", "-", "NULL", "N.A.", "tRUE", "FALSE", "truest", "nonesuches", "İnfinity", "123456789012345678901234567890", "0_0"]
    want = [("integer", "0"), ("integer", "0"), ("integer", "5"), ("integer", "7"), ("integer", "10"), ("integer", "12"), ("integer", "-12"), ("number", '"Infinity"'), ("number", '"-Infinity"'),
            ("number", "10.5"), ("number", "0.5"), ("number", "5.0"), ("number", '"-Infinity"'), ("number", '"NaN"'), ("null", "null"), ("null", "null"), ("null", "null"), ("boolean", "true"),
            ("boolean", "false"), ("string", '"truest"'), ("string", '"nonesuches"'), ("string", '"İnfinity"'), ("integer", "123456789012345678901234567890"), ("integer", "0")]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").orderBy("i")
    assert [(r.v.jtype, r.v.token) for r in rows.select(infer_kv_value("t").alias("v")).collect()] == want
    got = [r.v.token for r in spark.createDataFrame([("1,5",), ("0012",), ("1_2",)], "t string").select(infer_csv_value("t").alias("v")).collect()]
    assert got == ["1.5", "12", "12"]
