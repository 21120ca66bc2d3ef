"""The whole job over written phases (rules P1, P2): uploads -> fragments -> records -> versions -> valid rows -> documents, tables and evidence.

Every phase is a Parquet folder below the job's folder and counts as done once Spark has committed it (its success marker). A rerun after a lost
driver skips what is done and overwrites what was half written, so it gives the rows of an undisturbed run. Texts are scanned once, in `fragments`;
everything later reads what that phase wrote. Uploads that can't be taken are rows with a reason, never an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.functions.text import extension_problem, source_id_problem
from sievekit.operators.entities import enrich, ner_labels
from sievekit.operators.extract import extract_fragments
from sievekit.operators.grouping import assign_groups, group_schemas, route, validate_records
from sievekit.operators.normalize import build_records
from sievekit.operators.profile import field_signature, schema_fields
from sievekit.operators.versioning import assign_versions

Read = Callable[[str], DataFrame]
VERSION = ["source_id", "version"]


def judged(uploads: DataFrame) -> DataFrame:
    """Rule S11: uploads (doc_id, source_id, name, text) with the first reason why one can't be taken, or null. A `reason` that is there already comes first."""
    known = F.col("reason") if "reason" in uploads.columns else F.lit(None).cast("string")
    empty = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", F.lit("empty document"))
    nameless = F.when(F.col("name").isNull(), F.lit("unsupported file type: "))
    reason = F.coalesce(known, source_id_problem("source_id"), nameless, extension_problem("name"), empty)
    return uploads.select("doc_id", "source_id", "name", "text", reason.alias("reason"))


def _fragments(read: Read) -> DataFrame:
    return enrich(extract_fragments(read("uploads").filter("reason IS NULL")))


def _records(read: Read) -> DataFrame:
    return route(build_records(read("fragments")))


def _fields(read: Read) -> DataFrame:
    return schema_fields(read("records"), ["source_id", "doc_id"])


def _versions(read: Read) -> DataFrame:
    typed = read("fields").withColumn("type", F.concat_ws(":", "type", F.col("nullable").cast("string")))
    return assign_versions(field_signature(typed, ["source_id", "doc_id"]).withColumnRenamed("doc_id", "upload_ord"))


def _registry(read: Read) -> DataFrame:
    """One row a version: its first upload, whose fields are the version's, and how many uploads have it; all but the first are duplicates (V1)."""
    return read("versions").groupBy(*VERSION, "schema_id", "signature").agg(F.min("upload_ord").alias("first_upload"), F.count(F.lit(1)).alias("uploads"))


def _rows(read: Read) -> DataFrame:
    """Records with their version and the reason why one doesn't fit the version's schema, or null."""
    of = read("versions").select("source_id", F.col("upload_ord").alias("doc_id"), "version")
    records = read("records").join(of, ["source_id", "doc_id"])
    first = read("registry").select(*VERSION, F.col("first_upload").alias("doc_id"))
    schema = read("fields").join(first, ["source_id", "doc_id"]).select(*VERSION, "name", "type")
    return records.join(validate_records(records, schema, VERSION).select("record_id", "reason"), "record_id", "left")


def _documents(read: Read) -> DataFrame:
    return read("rows").filter("reason IS NULL AND storage = 'document'").select(*VERSION, "doc_id", "record_id", "source_type", "data")


def _grouped(read: Read) -> DataFrame:
    return assign_groups(read("rows").filter("reason IS NULL AND storage = 'tabular'"), VERSION)


def _groups(read: Read) -> DataFrame:
    return group_schemas(read("grouped"), VERSION)


def _tables(read: Read) -> DataFrame:
    """Rows of all tables in one folder, by table name."""
    names = read("groups").select(*VERSION, "group_id", "table_name")
    return read("grouped").join(names, [*VERSION, "group_id"]).select(*VERSION, "table_name", "doc_id", "record_id", "data")


def _evidence(read: Read) -> DataFrame:
    """Rule P2: (source_id, phase, n, status) of every phase and source, then a source's last word: success, noop or empty."""

    def count(phase: str, rows: DataFrame, n: Column = F.count(F.lit(1))) -> DataFrame:  # noqa: B008
        return rows.groupBy("source_id").agg(n.cast("long").alias("n")).select("source_id", F.lit(phase).alias("phase"), "n")

    fragments, registry, rows = read("fragments"), read("registry"), read("rows")
    counts = [
        count("accepted", read("uploads").filter("reason IS NULL")),
        count("rejected", read("uploads").filter("reason IS NOT NULL")),
        count("fragments", fragments),
        count("with_entities", fragments.filter(F.size(ner_labels(F.col("ner"))) > 0)),
        count("records", read("records")),
        count("versions", registry),
        count("duplicates", registry, F.sum(F.col("uploads") - 1)),
        count("invalid", rows.filter("reason IS NOT NULL")),
        count("documents", read("documents")),
        count("tables", read("groups")),
        count("table_rows", read("tables")),
    ]
    found = counts[0]
    for c in counts[1:]:
        found = found.unionByName(c)
    names = F.array(*[F.lit(p) for p in ("accepted", "rejected", "fragments", "with_entities", "records", "versions", "duplicates", "invalid", "documents", "tables", "table_rows", "inserted")])
    by = found.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("phase", "n"))).alias("m"))  # at most one entry a phase
    n = lambda p: F.coalesce(F.col("m")[p], F.lit(0).cast("long"))
    last = F.when(n("documents") + n("table_rows") > 0, "success").when(n("fragments") > 0, "noop").otherwise("empty")
    long = by.select("source_id", "m", last.alias("last"), F.explode(names).alias("phase"))
    value = F.when(F.col("phase") == "inserted", n("documents") + n("table_rows")).otherwise(n(F.col("phase")))
    return long.select("source_id", "phase", value.alias("n"), F.when(F.col("phase") == "inserted", F.col("last")).when(value > 0, "success").otherwise("empty").alias("status"))


#: The phases after `uploads`, in order.
PHASES: dict[str, Callable[[Read], DataFrame]] = {
    "fragments": _fragments, "records": _records, "fields": _fields, "versions": _versions, "registry": _registry, "rows": _rows,
    "documents": _documents, "grouped": _grouped, "groups": _groups, "tables": _tables, "evidence": _evidence,
}


def committed(spark: SparkSession, path: str) -> bool:
    """Whether Spark has committed a write to this folder."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(marker)


def run_job(spark: SparkSession, uploads: DataFrame, folder: str, phases: dict[str, Callable[[Read], DataFrame]] = PHASES) -> DataFrame:
    """Runs what isn't done yet below the folder, which all executors share, and returns the evidence. A folder belongs to one set of uploads."""
    def read(phase: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{phase}")

    for name, phase in {"uploads": lambda _: judged(uploads), **phases}.items():
        if not committed(spark, f"{folder}/{name}"):
            phase(read).write.mode("overwrite").parquet(f"{folder}/{name}")
    return read("evidence")
