"""Schema versions, registry, diffs and evolution (rules V1-V10, S7).

Version assignment is a running count of signature changes along the upload
order of each source.  It is computed as a distributed prefix scan so that
one source holding a third of all uploads is still spread over many tasks:
range-partition by (source, order), scan each partition locally, then fix
partition boundaries with a tiny per-(partition, source) summary.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values that must equal the reference's rules.
SCHEMA_ID_TEMPLATE = "{source_id}_v{version}"
CONFIDENCE_CHANGE_MIN = 0.1
LEGACY_NOTE = "type-migrated from "


def ordered_change_count(df: DataFrame, part: str, order: str, value: str, partitions: int | None = None) -> DataFrame:
    """Add ``changes``: how many times ``value`` differed from the previous row
    (by ``order``) within ``part``, up to and including this row.

    No window over ``part``: rows are range-partitioned on (part, order) and
    scanned per partition with ``mapInPandas`` (streaming, O(1) state); the
    partition-boundary corrections come from a summary with one row per
    (partition, part), which is all that is windowed.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = df.select(F.col(part).alias("_p"), F.col(order).alias("_o"), F.col(value).alias("_v"))
    ranged = slim.repartitionByRange(n, "_p", "_o").sortWithinPartitions("_p", "_o")
    schema = "_pid int, _p string, _o long, _v string, _local long, _first boolean"

    def scan(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last_p, last_v, count = None, None, 0
        for pdf in batches:
            local, first = [], []
            for p, v in zip(pdf["_p"], pdf["_v"]):
                if p != last_p:
                    last_p, last_v, count = p, v, 0
                    first.append(True)
                else:
                    if v != last_v:
                        count += 1
                    last_v = v
                    first.append(False)
                local.append(count)
            yield pd.DataFrame({"_pid": pid, "_p": pdf["_p"], "_o": pdf["_o"], "_v": pdf["_v"],
                                "_local": local, "_first": first})

    scanned = ranged.mapInPandas(scan, schema)
    summary = scanned.groupBy("_pid", "_p").agg(
        F.min_by("_v", "_o").alias("first_v"), F.max_by("_v", "_o").alias("last_v"), F.max("_local").alias("n"))
    w = Window.partitionBy("_p").orderBy("_pid")
    prev_last = F.lag("last_v").over(w)
    boundary = F.when(prev_last.isNotNull() & (prev_last != F.col("first_v")), 1).otherwise(0)
    summary = summary.withColumn("_bc", boundary)
    summary = summary.withColumn(
        "_offset",
        F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        + F.sum("_bc").over(w.rowsBetween(Window.unboundedPreceding, 0)),
    ).select("_pid", "_p", "_offset")
    out = scanned.join(summary, ["_pid", "_p"]).select(
        F.col("_p").alias(part), F.col("_o").alias(order), (F.col("_local") + F.col("_offset")).alias("changes"))
    return df.join(out, [part, order])


def assign_versions(uploads: DataFrame, source: str = "source_id", order: str = "upload_ord",
                    signature: str = "signature") -> DataFrame:
    """Rule V2: version = 1 + signature changes so far; duplicate = same signature as the latest."""
    counted = ordered_change_count(uploads, source, order, signature)
    return counted.select(
        "*",
        (F.col("changes") + 1).alias("version"),
        F.concat(F.col(source), F.lit("_v"), (F.col("changes") + 1).cast("string")).alias("schema_id"),
    ).drop("changes")


# --- registry (S7, V9) -------------------------------------------------------


def latest_schema(registry: DataFrame, source: str = "source_id") -> DataFrame:
    """Rules S7/V9: the highest version per source (algebraic ``max_by``, no sort)."""
    cols = [c for c in registry.columns if c != source]
    latest = registry.groupBy(source).agg(F.max_by(F.struct(*cols), "version").alias("s"))
    return latest.select(source, "s.*")


# --- diffs (V3-V8) -----------------------------------------------------------


def schema_diff(fields: DataFrame, source: str = "source_id") -> DataFrame:
    """Rules V3/V4/V8: diff of each version against the previous one of its source.

    ``fields``: (source, version, name, type, nullable, confidence).  Full outer
    join of version v-1 and v on field name; one row per (source, v).
    """
    old = fields.select(source, (F.col("version") + 1).alias("version"), "name",
                        F.col("type").alias("old_type"), F.col("nullable").alias("old_nullable"),
                        F.col("confidence").alias("old_conf"))
    new = fields.select(source, "version", "name", F.col("type").alias("new_type"),
                        F.col("nullable").alias("new_nullable"), F.col("confidence").alias("new_conf"))
    versions = fields.select(source, "version").distinct()
    pairs = versions.join(versions.select(source, (F.col("version") + 1).alias("version")).withColumn("_has_prev", F.lit(True)),
                          [source, "version"])
    j = old.join(new, [source, "version", "name"], "full_outer").join(pairs.drop("_has_prev"), [source, "version"])
    added = F.when(F.col("old_type").isNull(), F.col("name"))
    removed = F.when(F.col("new_type").isNull(), F.col("name"))
    both = F.col("old_type").isNotNull() & F.col("new_type").isNotNull()
    type_changed = both & (F.col("old_type") != F.col("new_type"))
    changed = both & (type_changed | (F.col("old_nullable") != F.col("new_nullable"))
                      | (F.abs(F.col("old_conf") - F.col("new_conf")) > CONFIDENCE_CHANGE_MIN))
    agg = j.groupBy(source, "version").agg(
        F.array_sort(F.collect_list(added)).alias("added"),
        F.array_sort(F.collect_list(removed)).alias("removed"),
        F.array_sort(F.collect_list(F.when(changed, F.col("name")))).alias("changed"),
        F.array_sort(F.collect_list(F.when(type_changed, F.concat_ws(":", "name", "old_type", "new_type"))))
        .alias("type_changes"),
    )
    notes = F.concat_ws(
        "; ",
        F.when(F.size("added") > 0, F.concat(F.lit("Added: "), F.array_join("added", ", "))),
        F.when(F.size("removed") > 0, F.concat(F.lit("Removed: "), F.array_join("removed", ", "))),
        F.when(F.size("type_changes") > 0, F.lit("Type changes present")),
    )
    return agg.select(source, (F.col("version") - 1).alias("from_version"), F.col("version").alias("to_version"),
                      "added", "removed", "changed", "type_changes",
                      F.when(notes == "", F.lit("No changes")).otherwise(notes).alias("notes"))


# --- evolution (V10) ---------------------------------------------------------


def evolve(old_docs: DataFrame, new_docs: DataFrame, type_changes: dict[str, tuple[str, str]] | None = None,
           type_cols: dict[str, str] | None = None) -> DataFrame:
    """Rule V10: old documents gain the added fields as NULL; a field whose
    type changed gets ``<field>_legacy = 'type-migrated from <old>'`` on the
    old documents holding the old type.  Removed fields stay untouched."""
    out = old_docs
    for name, (old_t, _new_t) in (type_changes or {}).items():
        tcol = (type_cols or {}).get(name)
        cond = F.col(tcol) == old_t if tcol else F.col(name).isNotNull()
        out = out.withColumn(f"{name}_legacy", F.when(cond, F.lit(LEGACY_NOTE + old_t)))
    return out.unionByName(new_docs, allowMissingColumns=True)
