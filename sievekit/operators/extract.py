"""Fragment extraction: ``documents`` -> ``fragments`` (rules E1-E19).

One pass over the documents table.  Fenced code blocks are cut out natively.
Key-value, JSON, CSV, HTML-table and YAML scanning are sequential and linear in
the text; they share one Arrow UDF, which receives the text only
when a cheap native test says it can hold a fragment (otherwise NULL crosses to
Python).  What can't be read becomes a fragment with ``parse_error`` and a ``reason``.

The scanners' fragments have one struct shape and are exploded once, so the
documents are scanned a single time.
"""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from sievekit.functions import scanners
from sievekit.functions.typing import py_strip

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's rules (stated together).
# ---------------------------------------------------------------------------
SOURCE_TYPES = ["json", "kv", "html_table", "csv_block", "yaml_block"]  # concatenation order
KV_KEY_PATTERN = r"(?U)^[a-zA-Z_][a-zA-Z0-9_\s\-]*$"
KV_KEY_MAX_LEN = 50
JSON_CONFIDENCE, JSON_ERROR_CONFIDENCE, KV_CONFIDENCE, HTML_CONFIDENCE = 1.0, 0.5, 1.0, 0.95
CSV_BASE, CSV_EVEN, CSV_DELIMITER, CSV_MOST, CSV_USUAL = 0.7, 0.15, 0.1, 0.95, [",", "\t"]
CODE_FENCE = "```"

FIELD_T = "array<struct<name:string,jtype:string,token:string>>"
PATH_T = "array<struct<path:string,jtype:string,token:string>>"
ENTRY_T = "array<struct<k:string,v:string>>"

_FRAGMENT_T = (
    "struct<type_rank:int,type_first:int,ordinal:int,start:int,end:int,raw:string,ok:boolean,confidence:double,headers:array<string>,"
    f"delimiter:string,block_type:string,entries:{ENTRY_T},rows:array<array<string>>,data:string,fields:{FIELD_T},paths:{PATH_T},reason:string>"
)


#: Texts whose fragments become Arrow rows at a time.
SCAN_CHUNK = 64
_UDF_CACHE: dict = {}


# --- one key-value line as a Column expression (E4) --------------------------


def kv_parse(line) -> Column:
    """Rule E4 on one line: struct<k, v> or NULL when the line is not ``key: value``."""
    s = py_strip(line)
    key = py_strip(F.substring_index(s, ":", 1))
    value = py_strip(F.regexp_extract(s, r"(?s)^[^:]*:(.*)$", 1))
    ok = (F.instr(s, ":") > 0) & (key != "") & (F.length(key) <= KV_KEY_MAX_LEN) & key.rlike(KV_KEY_PATTERN)
    return F.when(ok, F.struct(key.alias("k"), value.alias("v")))


# --- fenced code blocks (E17), native ---------------------------------------


def code_blocks(text) -> Column:
    """Contents between fence lines; an unclosed last block is kept when it has a line.

    Fence lines cut the text; every second piece lies inside. A closed piece has a line end on both sides, an open one in front.
    """
    pieces = F.split(text, rf"(?Umd)^[^\S\n]*{CODE_FENCE}.*$", -1)
    last = F.size(pieces) - 1
    inside = F.filter(
        F.transform(pieces, lambda p, i: F.when((i % 2 == 1) & ((i < last) | (p != "")),
                                                F.substring(p, F.lit(2), F.greatest(F.length(p) - F.when(i < last, 2).otherwise(1), F.lit(0))))),
        lambda p: p.isNotNull())
    return F.coalesce(inside, F.array().cast("array<string>"))


# --- scanning ------------------------------------------------------------------


def _scan_all(text: str) -> list[dict]:
    """The fragments of one text, type by type; each scanner skips texts that cannot hold its fragments."""
    found = scanners.json_fragments(text) if "{" in text else []
    kinds = [
        found,
        scanners.kv_blocks(text, [(j["start"], j["end"]) for j in found]) if ":" in text else [],
        scanners.html_tables(text),
        scanners.csv_blocks(text),
        scanners.yaml_blocks(text),
    ]
    out = []
    for rank, fragments in enumerate(kinds):
        if fragments:
            first = min(f["start"] for f in fragments)
            for ordinal, f in enumerate(fragments, 1):
                f["type_rank"], f["type_first"], f["ordinal"] = rank, first, ordinal
                if "raw" not in f:
                    f["raw"] = text[f["start"]:f["end"]]
            out += fragments
    return out


def _scan_udf():
    spark_type = DataType.fromDDL(f"array<{_FRAGMENT_T}>")
    arrow_type = to_arrow_type(spark_type)

    def scan(texts: pa.Array) -> pa.Array:
        # fragments live until they are Arrow rows: looking for garbage among them again and again would find none
        running = gc.isenabled()
        gc.disable()
        try:
            chunks = [texts[i : i + SCAN_CHUNK].to_pylist() for i in range(0, len(texts), SCAN_CHUNK)] or [[]]
            return pa.concat_arrays([pa.array([_scan_all(t) if t is not None else [] for t in chunk], arrow_type) for chunk in chunks])
        finally:
            if running:
                gc.enable()

    return F.arrow_udf(scan, spark_type)


def scan_columns(text: Column) -> list[Column]:
    """The Python scanners in one Arrow round trip (the text crosses once).

    Only texts that can hold some fragment (a '{', ',', TAB, '<table' or ':')
    are sent; the others cross as NULL.
    """
    if "all" not in _UDF_CACHE:
        _UDF_CACHE["all"] = _scan_udf()
    can_hold = (F.instr(text, "{") > 0) | (F.instr(text, ",") > 0) | (F.instr(text, "\t") > 0) | (F.instr(text, ":") > 0)
    can_hold = can_hold | (F.instr(text, "<table") > 0)
    return [_UDF_CACHE["all"](F.when(can_hold, text)).alias("_scan")]


def csv_confidence(headers: Column, rows: Column, delimiter: Column) -> Column:
    """Rule E14 of a block of a heading and two rows or more."""
    even = F.forall(rows, lambda r: F.size(r) == F.size(headers))
    parts = F.lit(CSV_BASE) + F.when(even, CSV_EVEN).otherwise(0.0) + F.when(delimiter.isin(CSV_USUAL), CSV_DELIMITER).otherwise(0.0)
    return F.least(parts, F.lit(CSV_MOST))


_ID_PREFIX = {"json": "json_", "kv": "kv_", "html_table": "html_table_", "csv_block": "csv_block_", "yaml_block": "yaml_"}


def extract_fragments(documents: DataFrame, text_col: str = "text", keep_cols=("doc_id", "source_id")) -> DataFrame:
    """``documents`` -> one row per fragment (rule E18 order columns included).

    Output columns: keep_cols, source_type, type_rank, type_first, ordinal,
    fragment_id, offset_start, offset_end, raw, confidence, parse_error,
    headers, delimiter, block_type, entries, rows, data, fields.  ``type_first``
    is the offset of the first fragment of that type in the document: records
    are grouped by type in first-seen order (rule N1).

    The scanners hand over all fragments of a text in one shape, so one explode makes the rows and
    what depends on the type is a plain expression on each row.
    """
    keep = list(keep_cols)
    scanned = documents.select(*keep, *scan_columns(F.col(text_col)))
    # an outer explode: for a plain one the optimizer infers a filter on the array's size and scans every text once more, below the deal
    x = scanned.select(*keep, F.explode_outer("_scan").alias("x")).filter("x IS NOT NULL").select(*keep, "x.*")
    st = F.get(F.array(*map(F.lit, SOURCE_TYPES)), F.col("type_rank"))
    prefix = F.get(F.array(*[F.lit(_ID_PREFIX[t]) for t in SOURCE_TYPES]), F.col("type_rank"))
    is_ = lambda t: F.col("type_rank") == SOURCE_TYPES.index(t)
    confidence = (
        F.when(is_("json"), F.when(F.col("ok"), JSON_CONFIDENCE).otherwise(JSON_ERROR_CONFIDENCE)).when(is_("kv"), KV_CONFIDENCE).when(is_("html_table"), HTML_CONFIDENCE)
        .when(is_("csv_block"), csv_confidence(F.col("headers"), F.col("rows"), F.col("delimiter"))).otherwise(F.col("confidence"))
    )
    parse_error = F.when(is_("json"), ~F.col("ok")).when(is_("html_table") | is_("yaml_block"), F.when(F.col("reason").isNotNull(), True))
    return x.select(
        *keep, st.alias("source_type"), "type_rank", "type_first", "ordinal",
        F.concat(prefix, F.col("ordinal").cast("string")).alias("fragment_id"),
        F.col("start").alias("offset_start"), F.col("end").alias("offset_end"), "raw", confidence.alias("confidence"), parse_error.alias("parse_error"),
        "headers", "delimiter", "block_type", "entries", "rows", "data", "fields", "paths", "reason",
    )


def fragment_stats(fragments: DataFrame, key_cols=("doc_id",)) -> DataFrame:
    """Rule E19: per-document fragment counts (explicit pivot values, one pass)."""
    names = {"json": "json_fragments", "kv": "kv_pairs", "html_table": "html_tables",
             "csv_block": "csv_blocks", "yaml_block": "yaml_blocks"}
    aggs = [F.count_if(F.col("source_type") == t).cast("long").alias(n) for t, n in names.items()]
    return fragments.groupBy(*key_cols).agg(*aggs, F.count(F.lit(1)).alias("total_records"))
