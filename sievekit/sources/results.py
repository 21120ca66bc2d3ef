"""Stored query results with an expiry (Q14): rows as JSON text below query_id=.../expires=..., in the result's own order.

Readers prune to one query's folders that haven't expired, so other results cost nothing. Storing again adds a newer result, and readers take the one that
expires last; at equal expiry the later one adds its rows, so callers store a query once a second at most. Expired folders go without reading a row.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's rules (stated together).
# ---------------------------------------------------------------------------
TTL_SECONDS = 600

STORED = "source_id string, position long, row string, query_id string, expires long"


def store_result(result: DataFrame, path: str, query_id: str, source_id: str, ttl_seconds: int = TTL_SECONDS, now: float | None = None) -> None:
    """Stores all rows of a result, whose order is kept by numbers that rise from partition to partition."""
    expires = int(time.time() if now is None else now) + ttl_seconds
    rows = result.select(F.lit(source_id).alias("source_id"), F.monotonically_increasing_id().alias("position"), F.to_json(F.struct(*result.columns)).alias("row"),
                         F.lit(query_id).alias("query_id"), F.lit(expires).cast("long").alias("expires"))
    rows.write.mode("append").partitionBy("query_id", "expires").parquet(path)


def reread_result(spark: SparkSession, path: str, query_id: str, source_id: str, schema: str, limit: int | None = None, now: float | None = None) -> DataFrame:
    """The newest unexpired result of a query with the schema's columns, in its order; its first rows if there is a limit. Another source's result has no rows."""
    rows = spark.read.schema(STORED).parquet(path).filter((F.col("query_id") == query_id) & (F.col("expires") > int(time.time() if now is None else now)))
    newest = rows.agg(F.max("expires")).first()[0]
    rows = rows.filter((F.col("expires") == newest) & (F.col("source_id") == source_id)).orderBy("position")
    return (rows if limit is None else rows.limit(limit)).select(F.from_json("row", schema).alias("r")).select("r.*")


def drop_expired(spark: SparkSession, path: str, now: float | None = None) -> int:
    """Deletes the folders of expired results and returns their number. The listing holds one entry a stored result."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/query_id=*/expires=*"))
    gone = [s.getPath() for s in found if int(s.getPath().getName().split("=")[1]) <= int(time.time() if now is None else now)]
    for folder in gone:
        fs.delete(folder, True)
    return len(gone)
