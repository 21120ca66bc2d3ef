"""Type inference and field profiling over records (rules T1-T23).

Everything is a ``groupBy`` over the long form ``record_fields`` (one row per
record and top-level field) or over walked paths.  All aggregates are
algebraic (partial aggregation before the shuffle), so a hot source or a
field present in every record does not gather its rows in one task.  The
only order-dependent pieces (example and enum values) use minima or a top-k
that is cut in each task first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievekit.functions.typing import json_string_token, semantics
from sievekit.operators.normalize import long_fields
from sievekit.operators.schema_tree import variant_kind, written

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's rules (stated together).
# ---------------------------------------------------------------------------
PK_PRESENCE_MIN = 0.9
PK_UNIQUE_MIN = 0.9
ENUM_PRESENCE_MIN = 0.5
ENUM_MAX_VALUES = 10
COERCION_NUMERIC_MIN = 0.6
BOOSTS = {"date": 0.05, "number": 0.02, "boolean": 0.02}  # the first that fits
EXAMPLES_PER_PATH = 3
SCALAR_TYPES = ["null", "boolean", "integer", "number", "string"]


def type_summary(fields_long: DataFrame, by: list[str]) -> DataFrame:
    """Rules T6/T7/T13/T15/T16 per (by, field name).

    Columns: by..., name, dominant, type_union (sorted), occurrences (records
    holding the field, explicit nulls included), matching (occurrences whose
    own type equals the dominant one), confidence = bround(matching /
    occurrences, 3).  integer+number fold into number for the vote only.
    """
    counts = fields_long.groupBy(*by, "name", "jtype").agg(F.count(F.lit(1)).alias("cnt"))
    per_field = counts.groupBy(*by, "name").agg(
        F.collect_list(F.struct("jtype", "cnt")).alias("tc"),  # at most 8 logical types per field
        F.sum("cnt").alias("occurrences"),
    )
    return _voted(per_field, by)


def type_ratio(fields_long: DataFrame, by: list[str]) -> DataFrame:
    """Rule T13 per (by, field name): occurrences and the share of the most frequent type, 3 digits; integer and number aren't folded."""
    counts = fields_long.groupBy(*by, "name", "jtype").agg(F.count(F.lit(1)).alias("cnt"))
    per_field = counts.groupBy(*by, "name").agg(F.sum("cnt").alias("occurrences"), F.max("cnt").alias("_most"))
    return per_field.select(*by, "name", "occurrences", F.bround(F.col("_most") / F.col("occurrences"), 3).alias("type_ratio"))


def _voted(per_field: DataFrame, by: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """The vote over the type counts ``tc`` of each field; carried columns pass through."""
    both = F.exists("tc", lambda x: x.jtype == "integer") & F.exists("tc", lambda x: x.jtype == "number")
    int_cnt = F.aggregate("tc", F.lit(0).cast("long"), lambda a, x: a + F.when(x.jtype == "integer", x.cnt).otherwise(0))
    voted = F.when(
        both,
        F.transform(F.filter("tc", lambda x: x.jtype != "integer"),
                    lambda x: F.struct(x.jtype.alias("jtype"),
                                       F.when(x.jtype == "number", x.cnt + int_cnt).otherwise(x.cnt).alias("cnt"))),
    ).otherwise(F.col("tc"))
    staged = per_field.select(*by, "name", "tc", "occurrences", *carry, voted.alias("voted"))
    dominant = F.array_min(F.transform("voted", lambda x: F.struct((-x.cnt).alias("neg"), x.jtype.alias("jtype"))))["jtype"]
    out = staged.select(*by, "name", "tc", "occurrences", *carry, dominant.alias("dominant"),
                        F.array_sort(F.transform("voted", lambda x: x.jtype)).alias("type_union"))
    matching = F.aggregate("tc", F.lit(0).cast("long"),
                           lambda a, x: a + F.when(x.jtype == F.col("dominant"), x.cnt).otherwise(0))
    return out.select(
        *by, "name", "dominant", "type_union", "occurrences", matching.alias("matching"),
        F.bround(matching / F.col("occurrences"), 3).alias("confidence"), *carry,
    )


def schema_fields(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rules T17/T19: one row per field of each batch's inferred schema.

    nullable = the field is absent from at least one record of the batch;
    example = first non-null value token in record order (``ord``).
    """
    by = by or ["source_id"]
    # a field without name stands for the record itself: its count is the batch's, from the same pass
    itself = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("jtype"), F.lit(None).cast("string").alias("token"))
    fields = F.concat(F.array(itself), F.coalesce("fields", F.array().cast("array<struct<name:string,jtype:string,token:string>>")))
    long = records.select(*by, "ord", F.posexplode(fields).alias("pos", "f")).select(*by, "ord", "pos", "f.*")
    seen = F.when(F.col("jtype") != "null", F.struct("ord", "token"))
    kinds = long.groupBy(*by, "name", "jtype").agg(
        F.count(F.lit(1)).alias("cnt"), F.min(seen).alias("example"), F.min(F.struct("ord", "pos")).alias("first_seen"))
    per_field = kinds.groupBy(*by, "name").agg(
        F.collect_list(F.struct("jtype", "cnt")).alias("tc"), F.sum("cnt").alias("occurrences"),
        F.min("example").alias("example"), F.min("first_seen").alias("first_seen"))
    totals = per_field.filter("name IS NULL").select(*[F.col(c).alias(f"_t_{c}") for c in by], F.col("occurrences").alias("total_records"))
    summary = _voted(per_field.filter("name IS NOT NULL"), by, ("example", "first_seen"))
    same = [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in by]
    return summary.join(totals, same).select(
        *by, "name", F.col("dominant").alias("type"),
        (F.col("occurrences") < F.col("total_records")).alias("nullable"),
        F.col("example.token").alias("example_value"), "confidence", "occurrences", "total_records", "first_seen",
    )


def value_records(values: DataFrame, value: str = "value") -> DataFrame:
    """Rule T20: fragments of any kind as records with ``fields``: an object gives its own fields, any other value the one field ``value``.

    ``value`` is a text column. JSON text stands for what it holds, any other text (the empty one too) for a string, and null for null. Names are
    unique in an object, so they are listed by name; the other columns are carried.
    """
    v = F.try_parse_json(F.col(value))
    parsed = values.withColumn("_v", v)
    token = F.when(F.col("_v").isNotNull(), F.to_json("_v")).when(F.col(value).isNull(), "null").otherwise(json_string_token(F.col(value)))
    kind = F.when(F.col("_v").isNotNull(), variant_kind(F.col("_v"))).when(F.col(value).isNull(), "null").otherwise("string")
    own = F.transform(F.map_entries(F.expr("try_cast(_v AS map<string, variant>)")), lambda e: F.struct(
        e["key"].alias("name"), F.coalesce(variant_kind(e["value"]), F.lit("null")).alias("jtype"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("token")))
    one = F.array(F.struct(F.lit("value").alias("name"), kind.alias("jtype"), token.alias("token")))
    return parsed.withColumn("fields", F.when(kind == "object", own).otherwise(one)).drop("_v")


def source_schema(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Rule T20: the schema (see ``schema_fields``) of each source's fragments (by..., ord, value) of mixed kinds."""
    return schema_fields(value_records(values, value), by)


def schema_stats(fields: DataFrame, by: list[str]) -> DataFrame:
    """Rule T19 stats per batch: fields_detected, avg_confidence, total_records."""
    return fields.groupBy(*by).agg(
        F.count(F.lit(1)).alias("fields_detected"),
        F.avg("confidence").alias("avg_confidence"),
        F.max("total_records").alias("total_records"),
    )


# --- nested paths (T8/T9) ----------------------------------------------------


def walked_paths(records: DataFrame, keep: list[str]) -> DataFrame:
    """Rule T8 as rows: one row per scalar (path, type, token) of each record.

    ``records.paths`` already holds the walk (the JSON/YAML scanners walk the
    parsed object they hold; flat records are their own fields), so this is
    a single explode with the position inside the record kept as ``seq``.
    """
    return records.select(*keep, F.posexplode("paths").alias("seq", "p")).select(
        *keep, "seq", F.col("p.path").alias("path"), F.col("p.jtype").alias("vtype"), F.col("p.token").alias("token"))


def _token_text(token: Column) -> Column:
    """String value of a JSON string token (NULL for other tokens)."""
    return F.when(token.startswith('"'), F.get_json_object(F.concat(F.lit("["), token, F.lit("]")), "$[0]"))


def _python_str(vtype: Column, token: Column) -> Column:
    """``str(value)`` of a scalar, used where Python sorts mixed values by text."""
    return (F.when(vtype == "string", _token_text(token)).when(token == "true", F.lit("True"))
            .when(token == "false", F.lit("False")).when(vtype == "null", F.lit("None")).otherwise(token))


def path_stats(records: DataFrame, by: list[str]) -> DataFrame:
    """Rule T9 per (by, path): presence, type counts, numeric min/max/count,
    semantic counts of strings, number of distinct values, and the first distinct values.

    All values count.  They are first summed by (path, token) with partial
    aggregation and written; everything else is read from that one table.  The first
    distinct values, by record order (``ord``) and position inside the record, are
    a top-k that Spark cuts in each task before the shuffle; k is one
    more than an enum may hold.
    """
    keep = list(dict.fromkeys([*by, "ord"]))
    num = F.when(F.col("vtype").isin("integer", "number"), F.col("token").try_cast("double"))
    tokens = walked_paths(records, keep).groupBy(*by, "path", "vtype", "token").agg(
        F.count(F.lit(1)).alias("cnt"), F.min(F.struct("ord", "seq")).alias("_o"))
    tokens = written(tokens).withColumns({"text": _token_text(F.col("token")), "num": num})
    sem = semantics(F.col("text"))
    is_num = F.col("vtype").isin("integer", "number")
    is_str = F.col("vtype") == "string"
    total = lambda cond: F.sum(F.when(cond, F.col("cnt")).otherwise(0))
    base = tokens.groupBy(*by, "path").agg(
        F.sum("cnt").alias("presence_count"),
        *[total(F.col("vtype") == t).alias(f"n_{t}") for t in SCALAR_TYPES],
        F.min("num").alias("num_min"),
        F.max("num").alias("num_max"),
        total(is_num).alias("num_count"),
        *[total(is_str & sem[f"looks_like_{t}"]).alias(f"like_{t}") for t in ("number", "date", "boolean")],
        F.count(F.lit(1)).alias("n_distinct"),
    )
    first = tokens.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "path").orderBy("_o", "token"))).filter(F.col("_r") <= ENUM_MAX_VALUES + 1)
    first = first.groupBy(*by, "path").agg(F.array_sort(F.collect_list(F.struct("_r", "token", "vtype", "num"))).alias("_distinct"))
    examples = F.slice(F.transform("_distinct", lambda x: x["token"]), 1, EXAMPLES_PER_PATH)
    return base.join(first, [*by, "path"]).withColumn("examples", examples)


def semantic_boost(jtype: Column, text: Column) -> Column:
    """Rule T14: what a string's look adds to a confidence; the first look that fits decides, other types add nothing."""
    looks = semantics(text)
    boost = F.lit(0.0)
    for look in reversed(BOOSTS):
        boost = F.when(looks[f"looks_like_{look}"], F.lit(BOOSTS[look])).otherwise(boost)
    return F.when(jtype == "string", boost).otherwise(F.lit(0.0))


def example_values(records: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """Rule T18: (by, name, jtype, token, boost) of the first value that isn't null, by record order, of each field asked for; null where there is none.

    The least of each field is taken in the tasks, so a hot source moves one row a task and field.
    """
    first = F.min(F.when(F.col("jtype") != "null", F.struct("ord", "pos", "jtype", "token")))
    found = long_fields(records, keep=(*by, "ord")).filter(F.col("name").isin(names)).groupBy(*by, "name").agg(first.alias("first"))
    asked = records.groupBy(*by).agg(F.array(*[F.lit(n) for n in dict.fromkeys(names)]).alias("names")).select(*by, F.explode("names").alias("name"))
    rows = asked.join(found, [*by, "name"], "left").select(*by, "name", "first.jtype", "first.token")
    return rows.withColumn("boost", F.coalesce(semantic_boost(F.col("jtype"), _token_text(F.col("token"))), F.lit(0.0)))


def path_suggestions(stats: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Rules T10-T12: primary-key candidate, enum suggestion, coercion hint per path.

    presence ratio = presence_count / records in the batch.  The dominant
    type is the most frequent one (ties: first in the fixed type order).
    """
    j = stats.join(totals, by)
    ratio = F.col("presence_count") / F.col("total_records")
    counts = F.array(*[F.struct(F.col(f"n_{t}").alias("c"), F.lit(-i).alias("o"), F.lit(t).alias("t"))
                       for i, t in enumerate(SCALAR_TYPES)])
    dominant = F.array_max(counts)["t"]
    uniq = F.col("n_distinct") / F.col("presence_count")
    pk = (ratio >= PK_PRESENCE_MIN) & (uniq >= PK_UNIQUE_MIN)
    all_num = F.forall("_distinct", lambda x: x["vtype"].isin("integer", "number"))
    by_num = F.transform(F.array_sort(F.transform("_distinct", lambda x: F.struct(x["num"].alias("k"), x["token"].alias("t")))),
                         lambda x: x["t"])
    by_text = F.transform(
        F.array_sort(F.transform("_distinct", lambda x: F.struct(_python_str(x["vtype"], x["token"]).alias("k"),
                                                                 x["token"].alias("t")))),
        lambda x: x["t"])
    enum = F.when((ratio >= ENUM_PRESENCE_MIN) & (F.col("n_distinct") <= ENUM_MAX_VALUES),
                  F.when(all_num, by_num).otherwise(by_text))
    coercion = F.when((F.col("n_string") > 0) & (F.col("like_number") / F.col("n_string") >= COERCION_NUMERIC_MIN),
                      F.lit("strings_mostly_numeric"))
    return j.select(*by, "path", ratio.alias("presence_ratio"), dominant.alias("dominant"),
                    F.coalesce(pk, F.lit(False)).alias("pk_candidate"), enum.alias("enum_values"),
                    coercion.alias("coercion"))


# --- JSON-schema-like summary and signature (T21-T23) --------------------------


def schema_signature(paths: DataFrame, by: list[str]) -> DataFrame:
    """Rule T23: first 16 hex of sha256 over the canonical (sorted) path list."""
    entry = F.concat_ws("|", F.col("path"), F.array_join("types", ","), F.col("required").cast("string"))
    canon = F.expr("listagg(_e, ';') within group (order by _e)")
    return paths.withColumn("_e", entry).groupBy(*by).agg(canon.alias("canonical")).select(
        *by, F.substring(F.sha2(F.col("canonical"), 256), 1, 16).alias("signature"), "canonical")


def field_signature(fields: DataFrame, by: list[str]) -> DataFrame:
    """Signature of a flat schema: sha256 over sorted ``name:type`` (top-level fields)."""
    entry = F.concat_ws(":", F.col("name"), F.col("type"))
    canon = F.expr("listagg(_e, ',') within group (order by _e)")
    return fields.withColumn("_e", entry).groupBy(*by).agg(canon.alias("canonical")).select(
        *by, F.substring(F.sha2(F.col("canonical"), 256), 1, 16).alias("signature"))
