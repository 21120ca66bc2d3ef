"""Normalisation: ``fragments`` -> ``records`` -> ``record_fields`` (rules N1-N12).

Every record carries ``fields``: an ordered array of ``struct<name, jtype,
token>`` (top-level field, logical type, JSON token of the value).  Keys are
cleaned and values typed with built-in expressions; duplicate keys keep the
last value at the place of their first occurrence, as a Python dict does.
``data`` is the record as JSON text; ``parse_json(data)`` gives a VARIANT for
path queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.functions.typing import (
    infer_csv_value,
    infer_html_value,
    infer_kv_value,
    json_string_token,
    py_strip,
    standardize_kv_key,
    standardize_table_key,
)

FIELD_T = "array<struct<name:string,jtype:string,token:string>>"


def dedupe_last(arr: Column, key: str = "name") -> Column:
    """Keep one entry per ``key``: the last value, at the first position (a Python dict).

    The input stands in a lambda's variable, so it is evaluated once; entries are folded only where a key occurs twice.
    """
    def once(entries: Column) -> Column:
        names = F.transform(entries, lambda e: e[key])
        folded = F.aggregate(
            entries,
            F.slice(entries, 1, 0),
            lambda acc, e: F.when(
                F.exists(acc, lambda a: a[key] == e[key]),
                F.transform(acc, lambda a: F.when(a[key] == e[key], e).otherwise(a)),
            ).otherwise(F.array_append(acc, e)),
        )
        return F.when(F.size(F.array_distinct(names)) == F.size(entries), entries).otherwise(folded)

    return F.get(F.transform(F.array(arr), once), F.lit(0))


def _field(name: Column, typed_value: Column) -> Column:
    return F.struct(name.alias("name"), typed_value["jtype"].alias("jtype"), typed_value["token"].alias("token"))


def fields_to_json(fields) -> Column:
    """Assemble ``{"name":token,...}`` from a fields array."""
    f = F.col(fields) if isinstance(fields, str) else fields
    body = F.array_join(F.transform(f, lambda e: F.concat(json_string_token(e["name"]), F.lit(":"), e["token"])), ",")
    return F.concat(F.lit("{"), body, F.lit("}"))


def typed_fields(pairs: Column, key_fn, infer_fn, key: str = "k") -> Column:
    """Clean keys and type values of ``array<struct<k, v>>``.

    Three transforms so every per-element expression is evaluated once
    (lambda bodies get no common-subexpression elimination).
    """
    stripped = F.transform(pairs, lambda p: F.struct(key_fn(p[key]).alias("name"), py_strip(p["v"]).alias("v")))
    inferred = F.transform(stripped, lambda p: F.struct(p["name"].alias("name"), infer_fn(p["v"], stripped=True).alias("t")))
    return F.transform(inferred, lambda p: F.struct(
        p["name"].alias("name"), p["t"]["jtype"].alias("jtype"), p["t"]["token"].alias("token")))


def kv_fields(entries: Column) -> Column:
    """Rule N3 + N5 on the entries of one key-value block."""
    return dedupe_last(typed_fields(entries, standardize_kv_key, infer_kv_value))


def _row_pairs(headers: Column, row: Column, strict_width: bool) -> Column:
    """Header/cell pairs of one table row (rule E13 for CSV, E8 for HTML)."""
    n_h, n_r = F.size(headers), F.size(row)
    idx = F.sequence(F.lit(0), n_r - 1)
    by_header = F.transform(idx, lambda i: F.struct(
        F.coalesce(F.get(headers, i), F.concat(F.lit("col_"), i.cast("string"))).alias("name"), F.get(row, i).alias("v")))
    by_index = F.transform(idx, lambda i: F.struct(F.concat(F.lit("col_"), i.cast("string")).alias("name"),
                                                   F.get(row, i).alias("v")))
    if strict_width:  # HTML: header names only when the widths agree
        pairs = F.when((n_h > 0) & (n_h == n_r), by_header).otherwise(by_index)
    else:  # CSV: header names where present, col_i beyond them
        pairs = by_header
    return F.when(n_r > 0, pairs).otherwise(F.array().cast("array<struct<name:string,v:string>>"))


def table_row_fields(headers: Column, row: Column, kind: str) -> Column:
    """Rule N4 + N7/N8 on one CSV or HTML row."""
    infer = infer_csv_value if kind == "csv_block" else infer_html_value
    pairs = dedupe_last(_row_pairs(headers, row, strict_width=(kind == "html_table")))
    return dedupe_last(typed_fields(pairs, standardize_table_key, infer, key="name"))


def json_error_fields(f: Column = None) -> Column:
    """Rule E3 failure record: the raw text is kept as data."""
    def fld(name, jtype, token):
        return F.struct(F.lit(name).alias("name"), F.lit(jtype).alias("jtype"), token.alias("token"))

    return F.array(
        fld("_raw", "string", json_string_token(F.col("raw"))),
        fld("_parse_error", "boolean", F.lit("true")),
        fld("chunk_id", "string", json_string_token(F.col("fragment_id"))),
        fld("start", "integer", F.col("offset_start").cast("string")),
        fld("end", "integer", F.col("offset_end").cast("string")),
    )


def build_records(fragments: DataFrame, key_cols=("doc_id", "source_id")) -> DataFrame:
    """One row per normalised record (rules N1, N9, N10, N11).

    JSON and YAML fragments give one record each, key-value blocks one, CSV
    and HTML tables one per row.  ``ord`` orders records like the reference:
    by document, then by source type in first-seen order, then by place.
    """
    st = F.col("source_type")
    single_fields = (
        F.when(st == "kv", kv_fields(F.col("entries")))
        .when((st == "json") & F.col("parse_error"), json_error_fields())
        .otherwise(F.col("fields")).cast(FIELD_T)
    )
    per_row = F.when(st == "csv_block", F.transform("rows", lambda r: table_row_fields(F.col("headers"), r, "csv_block"))) \
        .when(st == "html_table", F.transform("rows", lambda r: table_row_fields(F.col("headers"), r, "html_table"))) \
        .otherwise(F.array(single_fields))
    tabular = st.isin("csv_block", "html_table")
    exploded = fragments.select(
        *key_cols, "source_type", "type_rank", "type_first", "ordinal", "fragment_id", "offset_start",
        "offset_end", "confidence", "headers", "delimiter", "block_type", "paths",
        # an outer explode: for a plain one the optimizer infers a filter that types every value once more
        F.posexplode_outer(per_row).alias("_i", "fields"),
    ).withColumn("row_index", F.when(tabular, F.col("_i")).cast("int")).drop("_i")
    records = exploded.filter(F.size("fields") > 0)
    return records.select(
        *key_cols,
        F.concat_ws(":", F.col(key_cols[0]).cast("string"), "fragment_id",
                    F.coalesce(F.col("row_index").cast("string"), F.lit("0"))).alias("record_id"),
        "source_type", "fragment_id", "row_index", "confidence",
        F.struct(F.col(key_cols[0]).alias("doc"), "type_first", "type_rank", "offset_start", "ordinal",
                 F.coalesce("row_index", F.lit(-1)).alias("row")).alias("ord"),
        F.struct("offset_start", "offset_end", "headers", "delimiter", "block_type").alias("provenance"),
        "fields",
        fields_to_json(F.col("fields")).alias("data"),
        # nested scalar paths: from the scanner for JSON/YAML, the flat fields otherwise
        F.when(F.col("source_type").isin("json", "yaml_block") & F.col("paths").isNotNull(), F.col("paths"))
        .otherwise(F.transform("fields", lambda f: F.struct(f["name"].alias("path"), f["jtype"].alias("jtype"),
                                                             f["token"].alias("token")))).alias("paths"),
    )


def long_fields(records: DataFrame, keep=("source_id", "record_id", "ord", "source_type")) -> DataFrame:
    """Long form ``record_fields``: one row per (record, top-level field)."""
    return records.select(*keep, F.posexplode("fields").alias("pos", "f")).select(
        *keep, "pos", F.col("f.name").alias("name"), F.col("f.jtype").alias("jtype"), F.col("f.token").alias("token"))


def normalize_fragment(fragments: DataFrame, key_cols=("doc_id", "source_id")) -> DataFrame:
    """Rule N2 (one-fragment form): each fragment with ``content``, its normalised records in order, or its
    original text when nothing came out."""
    rows = build_records(fragments, key_cols).groupBy(*key_cols, "fragment_id").agg(
        F.array_sort(F.collect_list(F.struct("row_index", "data"))).alias("_rows"))  # a fragment's own rows
    return fragments.join(rows, [*key_cols, "fragment_id"], "left").withColumn(
        "content", F.coalesce(F.transform("_rows", lambda r: r["data"]), F.array("raw"))).drop("_rows")
