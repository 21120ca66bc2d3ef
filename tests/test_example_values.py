"""What a string's look adds to a confidence."""

from pyspark.sql import functions as F

from sievekit.operators.profile import semantic_boost


def test_the_first_look_decides_and_only_strings_count(spark):
    given = [("string", "2024-01-31", 0.05), ("string", "12.5", 0.02), ("string", "yes", 0.02), ("string", "plain", 0.0), ("string", "", 0.0), ("string", "2024-13-31", 0.0), ("integer", "12", 0.0), ("null", None, 0.0)]
    got = spark.createDataFrame(given, "jtype string, text string, want double").select(semantic_boost(F.col("jtype"), F.col("text")).alias("got"), "want")
    assert [r["got"] for r in got.collect()] == [w for _, _, w in given]
