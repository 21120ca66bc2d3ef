"""Column functions for key cleaning, value typing and semantic flags.

All of these are built-in Spark expressions (JVM side, codegen friendly); no
Python runs per row.  A typed value is carried as ``struct<jtype, token>``:
``jtype`` is the logical type name and ``token`` the value rendered as a JSON
token (``null``, ``true``, ``12``, ``1.5``, ``"text"``), so records of any
shape can be assembled into JSON text and VARIANT later.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's rules (stated together).
# ---------------------------------------------------------------------------
# Null-like words for key-value and JSON string values.
KV_NULL_WORDS = ["null", "none", "nil", "-", "n/a", "na", "n.a.", "n.a"]
# Null-like words for CSV cells.
CSV_NULL_WORDS = ["null", "none", "n/a", "na"]
# Characters of the longest word that isn't text ("infinity").
_LONGEST_WORD = 8
# Boolean words for CSV and HTML cells.
TABLE_TRUE_WORDS = ["true", "yes", "y", "1"]
TABLE_FALSE_WORDS = ["false", "no", "n", "0"]
# Boolean words for the semantic flag.
SEMANTIC_BOOL_WORDS = ["true", "false", "yes", "no"]
# Logical type vocabulary.
LOGICAL_TYPES = ["null", "boolean", "integer", "number", "string", "object", "array", "unknown"]
# Date shapes kept as text by the key-value/JSON rules.
ISO_DATE_ONLY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
ISO_DATETIME_PREFIX = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
# Date prefixes recognised by the CSV rule.
CSV_DATE_PREFIXES = [r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}", r"^[0-9]{2}-[0-9]{2}-[0-9]{4}"]
# Semantic patterns.
NUMERIC_STRING = r"^[+-]?[0-9]*\.?[0-9]+$"
ISO_DATE_STRING = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?$"

# Python-style whitespace (str.strip / str.isspace) in Java regex terms.
_WS = r"[\s\x1c-\x1f]"
# Texts that begin and end with a visible ASCII character, and keys that need no cleaning once they are in lower case.
_STRIPPED = r"(?s)^[!-~](?:.*[!-~])?\z"
_CLEAN_KEY = r"^[a-z0-9]+(?:_[a-z0-9]+)*\z"
# Integer literal as accepted by Python int(): sign, digits, single underscores.
_INT_LITERAL = r"^[+-]?[0-9]+(?:_[0-9]+)*$"
# Integer literal that is its own JSON token.
_PLAIN_INT = r"^[1-9][0-9]*\z"
# Float literal as accepted by Python float().
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_FLOAT_LITERAL = (
    rf"^[+-]?(?:(?:(?:{_DIGITS})?\.{_DIGITS}|{_DIGITS}\.?)(?:[eE][+-]?{_DIGITS})?"
    r"|(?i:inf|infinity|nan))$"
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """Python ``str.strip()`` (Unicode whitespace at both ends)."""
    v = _c(x)
    # most texts have a visible ASCII character at both ends
    return F.when(v.rlike(_STRIPPED), v).otherwise(F.regexp_replace(v, rf"(?U)^{_WS}+|{_WS}+$", ""))


def json_string_token(x) -> Column:
    """A string rendered as a quoted, escaped JSON string token."""
    v = _c(x)
    arr = F.to_json(F.array(v))
    # most texts hold nothing to escape
    return F.when(v.isNotNull() & ~v.rlike(r'["\\\x00-\x1f]'), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(F.substring(arr, F.lit(2), F.length(arr) - 2))


def typed(jtype: str | Column, token: Column) -> Column:
    jt = F.lit(jtype) if isinstance(jtype, str) else jtype
    return F.struct(jt.alias("jtype"), token.alias("token"))


def _int_token(v: Column) -> Column:
    digits = F.translate(v, "_", "")
    stripped = F.regexp_replace(digits, r"^(-?)\+?0*(?=[0-9])", "$1")
    # most whole numbers stand in their plain form
    return F.when(v.rlike(_PLAIN_INT), v).when(stripped == "-0", F.lit("0")).otherwise(stripped)


def _float_token(v: Column) -> Column:
    number = F.translate(v, "_", "").try_cast("double").cast("string")
    return F.regexp_replace(number, r"^(NaN|-?Infinity)$", '"$1"')


def _contains_any(v: Column, chars: str) -> Column:
    cond = F.lit(False)
    for ch in chars:
        cond = cond | (F.instr(v, ch) > 0)
    return cond


def infer_kv_value(raw, stripped: bool = False) -> Column:
    """Typed value of a key-value (or JSON string) value (rule N5/N6).

    trim; '' stays ''; null words -> null; true/false -> boolean; ISO dates stay
    text; integer when there is no '.', 'e', 'E'; then float; else text.
    """
    v = _c(raw) if stripped else py_strip(raw)
    lv = F.lower(v)
    return (
        F.when(_c(raw).isNull(), typed("null", F.lit("null")))
        .when(v == "", typed("string", F.lit('""')))
        # a text that begins with a letter is no date and no number but these; all words but '-' begin with one
        .when(F.ascii(v).between(97, 122) | F.ascii(v).between(65, 90), F.when(
            F.length(v) > _LONGEST_WORD, typed("string", json_string_token(v)))
            .when(lv.isin(KV_NULL_WORDS), typed("null", F.lit("null")))
            .when(lv.isin("true", "false"), typed("boolean", lv))
            .when(lv.isin("inf", "infinity", "nan"), typed("number", _float_token(v))).otherwise(typed("string", json_string_token(v))))
        .when(v.isin(KV_NULL_WORDS), typed("null", F.lit("null")))
        .when(v.rlike(ISO_DATE_ONLY) | v.rlike(ISO_DATETIME_PREFIX), typed("string", json_string_token(v)))
        .when(~_contains_any(v, ".eE") & v.rlike(_INT_LITERAL), typed("integer", _int_token(v)))
        .when(v.rlike(_FLOAT_LITERAL), typed("number", _float_token(v)))
        .otherwise(typed("string", json_string_token(v)))
    )


def infer_csv_value(raw, stripped: bool = False) -> Column:
    """Typed value of a CSV cell (rule N7): ``1,000`` becomes 1.0, yes/no are booleans."""
    v = _c(raw) if stripped else py_strip(raw)
    lv = F.lower(v)
    comma_as_dot = F.regexp_replace(v, ",", ".")
    one_dot = (F.length(comma_as_dot) - F.length(F.regexp_replace(comma_as_dot, r"\.", ""))) == 1
    return (
        F.when(_c(raw).isNull() | (v == "") | lv.isin(CSV_NULL_WORDS), typed("null", F.lit("null")))
        .when(~_contains_any(v, ".,") & v.rlike(_INT_LITERAL), typed("integer", _int_token(v)))
        .when(one_dot & comma_as_dot.rlike(_FLOAT_LITERAL), typed("number", _float_token(comma_as_dot)))
        .when(lv.isin(TABLE_TRUE_WORDS), typed("boolean", F.lit("true")))
        .when(lv.isin(TABLE_FALSE_WORDS), typed("boolean", F.lit("false")))
        .otherwise(typed("string", json_string_token(v)))
    )


def infer_html_value(raw, stripped: bool = False) -> Column:
    """Typed value of an HTML cell (rule N8): commas dropped before the float test."""
    v = _c(raw) if stripped else py_strip(raw)
    lv = F.lower(v)
    no_commas = F.regexp_replace(v, ",", "")
    return (
        F.when(_c(raw).isNull() | (v == ""), typed("null", F.lit("null")))
        .when(~_contains_any(v, ".,") & v.rlike(_INT_LITERAL), typed("integer", _int_token(v)))
        .when(no_commas.rlike(_FLOAT_LITERAL), typed("number", _float_token(no_commas)))
        .when(lv.isin(TABLE_TRUE_WORDS), typed("boolean", F.lit("true")))
        .when(lv.isin(TABLE_FALSE_WORDS), typed("boolean", F.lit("false")))
        .otherwise(typed("string", json_string_token(v)))
    )


def looks_like_date_prefix(x) -> Column:
    """Rule N12: one of three date prefixes (value unchanged)."""
    v = _c(x)
    cond = F.lit(False)
    for p in CSV_DATE_PREFIXES:
        cond = cond | v.rlike(p)
    return cond


def standardize_kv_key(x) -> Column:
    """Rule N3: lower, space/hyphen -> '_', drop other chars, collapse '_', strip '_'."""
    k = F.lower(_c(x))
    plain = F.translate(k, " -", "__")
    k = F.regexp_replace(plain, r"[^a-z0-9_]", "")
    k = F.regexp_replace(k, r"_+", "_")
    k = F.regexp_replace(k, r"^_+|_+$", "")
    return F.when(plain.rlike(_CLEAN_KEY), plain).when(k == "", F.lit("unknown")).otherwise(k)


def standardize_table_key(x) -> Column:
    """Rule N4 (CSV/HTML headers): lower, runs of non-word chars -> '_', strip '_'."""
    k = F.lower(_c(x))
    k = F.regexp_replace(k, r"(?U)[^\w]+", "_")
    k = F.regexp_replace(k, r"^_+|_+$", "")
    return F.when(k == "", F.lit("unknown")).otherwise(k)


# --- semantic flags (T2-T5) -------------------------------------------------


def is_numeric_string(x) -> Column:
    v = _c(x)
    return F.coalesce(v.rlike(NUMERIC_STRING), F.lit(False))


def is_boolean_string(x) -> Column:
    v = _c(x)
    return F.coalesce((v != "") & F.lower(py_strip(v)).isin(SEMANTIC_BOOL_WORDS), F.lit(False))


def is_iso_date_string(x) -> Column:
    v = _c(x)
    valid = F.when(F.length(v) == 10, v.try_cast("date").isNotNull()).otherwise(
        v.try_cast("timestamp").isNotNull()
    )
    return F.coalesce(v.rlike(ISO_DATE_STRING) & valid, F.lit(False))


def semantics(x) -> Column:
    """Rule T5: the three semantic flags of a string."""
    return F.struct(
        is_numeric_string(x).alias("looks_like_number"),
        is_iso_date_string(x).alias("looks_like_date"),
        is_boolean_string(x).alias("looks_like_boolean"),
    )
