"""Where records go and come back from: typed tables with rejects, documents by source.

A schema is a list of (name, logical type, nullable). Writes append Parquet, so a failed task's retry
doesn't duplicate rows; reads push filters and columns down to the files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's rules (stated together): column types of logical types.
# ---------------------------------------------------------------------------
COLUMN_TYPES = {"integer": "bigint", "number": "double", "boolean": "boolean", "string": "string", "object": "string",
                "array": "string", "null": "string"}

Field = tuple[str, str, bool]


def struct_type(fields: list[Field]) -> T.StructType:
    """Rule G12: the table's StructType."""
    return T.StructType([T.StructField(n, T._parse_datatype_string(COLUMN_TYPES[t]), nullable) for n, t, nullable in fields])


def ddl(fields: list[Field]) -> str:
    """Rule G12: the same as DDL."""
    return ", ".join(f"`{n}` {COLUMN_TYPES[t]}{'' if nullable else ' NOT NULL'}" for n, t, nullable in fields)


def _token(name: str) -> Column:
    found = F.filter("fields", lambda f: f["name"] == name)
    return F.get(F.transform(found, lambda f: F.when(f["jtype"] != "null", f)), F.lit(0))


def _fits(field: Column, kind: str) -> Column:
    """Whether a value's logical type can stand in a column: the same, an integer for a number, anything as text."""
    return field["jtype"].isin({"number": ["number", "integer"], "string": list(COLUMN_TYPES), "object": ["object", "array"]}.get(kind, [kind]))


def _text(field: Column) -> Column:
    token = field["token"]
    return F.when(field["jtype"] == "string", F.get_json_object(F.concat(F.lit("["), token, F.lit("]")), "$[0]")).otherwise(token)


def aligned(records: DataFrame, fields: list[Field], keep: tuple[str, ...] = ("record_id",)) -> tuple[DataFrame, DataFrame]:
    """Rule S5: (rows with the table's columns, rejects with the first reason).

    A record is rejected for a value of another type or a missing value where none may miss. Fields that the table
    doesn't have are dropped, the record stays.
    """
    reasons = [F.lit(None).cast("string")]
    for name, kind, nullable in fields:
        value = _token(name)
        reasons.append(F.when(value.isNotNull() & ~_fits(value, kind), F.lit(f"bad type for {name}")))
        if not nullable:
            reasons.append(F.when(value.isNull(), F.lit(f"no value for {name}")))
    judged = records.withColumn("reason", F.coalesce(*reasons))
    columns = [_text(_token(n)).try_cast(COLUMN_TYPES[t]).alias(n) for n, t, _ in fields]
    return judged.filter("reason IS NULL").select(*keep, *columns), judged.filter("reason IS NOT NULL").select(*keep, "reason")


def with_system_columns(rows: DataFrame) -> DataFrame:
    """Rule S4: rows (record_id, source_id, ...) with the columns that every stored table has: _id, _source_id and _ingested_at."""
    return rows.withColumnsRenamed({"record_id": "_id", "source_id": "_source_id"}).withColumn("_ingested_at", F.current_timestamp())


def append_rows(rows: DataFrame, path: str) -> None:
    """Rule S4/S5: appends to a typed table."""
    rows.write.mode("append").parquet(path)


def append_documents(records: DataFrame, path: str) -> None:
    """Rule S6: appends records as JSON text, one folder a source."""
    records.select("source_id", "record_id", "source_type", "data").write.mode("append").partitionBy("source_id").parquet(path)


def read_documents(spark: SparkSession, path: str, source_id: str, record_ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rule S8: a source's documents, some of them by id, or the first few by id."""
    found = spark.read.parquet(path).filter(F.col("source_id") == source_id)
    if record_ids is not None:
        found = found.filter(F.col("record_id").isin(record_ids))
    return found if limit is None else found.orderBy("record_id").limit(limit)


def count_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rule S8: documents of each source."""
    return spark.read.parquet(path).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def constraints(fields: list[Field]) -> Column:
    """Rule G12: the predicate that the table's NOT NULL columns stand for."""
    return all_of([F.col(n).isNotNull() for n, _, nullable in fields if not nullable])
