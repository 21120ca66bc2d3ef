"""Clustered layout for hot filter fields (S9): tables written along a space-filling curve, so that filters skip files and row groups.

Each column's values are cut into 2^BITS ranges of about equal numbers of rows; a row's range numbers, their bits interleaved, are its place on the
Z-curve. Rows are range-partitioned by that place and sorted by it in each file. A file then holds a small box of all hot columns, which Parquet's
least and greatest values tell a reader: a filter on any of them, or several, leaves most files and row groups unread. Null stands in the first
range. The cuts are a few numbers a column, found in one pass.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

BITS = 8


def as_number(rows: DataFrame, name: str) -> Column:
    """A number with the order of a column's values; of text, of its first seven bytes."""
    kind, c = rows.schema[name].dataType, F.col(name)
    if isinstance(kind, NumericType):
        return c.cast("double")
    if isinstance(kind, BooleanType):
        return c.cast("int").cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return c.cast("timestamp").cast("double")
    if isinstance(kind, StringType):
        first = F.rpad(F.substring(F.hex(F.encode(c, "utf-8")), 1, 14), 14, "0")
        return F.conv(first, 16, 10).cast("double")
    raise ValueError(f"can't cluster by {name}: {kind.simpleString()} has no order here")


def place(rows: DataFrame, columns: list[str]) -> Column:
    """A row's place on the curve."""
    if not 0 < len(columns) <= 63 // BITS:
        raise ValueError(f"between 1 and {63 // BITS} columns")
    shares = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    cuts = rows.agg(*(F.percentile_approx(as_number(rows, c), shares, 10_000).alias(c) for c in columns)).first()
    bits = []
    for j, c in enumerate(columns):
        edges = sorted(set(cuts[c] or []))
        edges = F.array(*map(F.lit, edges)) if edges else F.array().cast("array<double>")
        value = as_number(rows, c)
        rank = F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(F.filter(edges, lambda e: e <= value))).cast("long")  # noqa: B023
        bits += [F.shiftleft(F.shiftright(rank, i).bitwiseAND(F.lit(1)).cast("long"), i * len(columns) + j) for i in range(BITS)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def write_clustered(rows: DataFrame, path: str, columns: list[str], files: int) -> None:
    """Writes rows to about `files` files, each a small box of the columns."""
    placed = rows.withColumn("_place", place(rows, columns))
    placed.repartitionByRange(files, "_place").sortWithinPartitions("_place").drop("_place").write.parquet(path)


def files_overlapping(rows: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """(n): in how many files of a table rows can lie, by least and greatest values, that are in all of the ranges."""
    edges = [f(c).alias(f"{name}_{c}") for c in ranges for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(*edges)
    return boxes.filter(all_of((F.col(f"hi_{c}") >= F.lit(lo)) & (F.col(f"lo_{c}") <= F.lit(hi)) for c, (lo, hi) in ranges.items())).agg(F.count(F.lit(1)).alias("n"))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
