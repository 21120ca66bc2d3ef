"""Dict-shaped queries -> Catalyst plans (rules Q1-Q14).

A payload is read once into a ``Request``; conditions come from one table of
operators and become Column expressions, never SQL text, so on typed tables
Parquet pushdown and pruning apply.  On documents a condition holds for the
values that its dotted path reaches in the record's VARIANT, through objects
and lists; values are compared only with literals of their own type.

Nothing is cut unless the payload has a limit or the caller passes ``limits``.
"""

from __future__ import annotations

import json
import operator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's rules (stated together).
# ---------------------------------------------------------------------------
REFERENCE_LIMITS = (100, 1000)  # default and largest limit, for callers that want them
ENGINES = ("mongodb", "sqlite")  # document store, tabular store
FORBIDDEN_WORDS = ("select", "find", "show")
ASC_WORDS = (1, "asc", "ASC", "ascending")
DESC_WORDS = (-1, "desc", "DESC", "descending")
TABULAR_DESC_WORDS = ("desc", "-1", "descending")

#: Operators that compare one value with one literal; $in, $like and $exists are built on them below.
COMPARISONS = {"$eq": operator.eq, "$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}
LITERAL_CHECKS = {
    "$in": (lambda v: isinstance(v, (list, tuple)) and len(v) > 0, "a list with at least one value"),
    "$like": (lambda v: isinstance(v, str), "a pattern string"),
}
TABULAR_OPERATORS = (*COMPARISONS, "$ne", "$in", "$like")
DOCUMENT_OPERATORS = (*TABULAR_OPERATORS, "$exists")
#: Order of unlike values in a document sort.
TYPE_ORDER = ("VOID", "NUMBER", "STRING", "OBJECT", "ARRAY", "BOOLEAN")


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Request:
    engine: str
    conditions: tuple[tuple[str, str, object], ...]
    order: tuple[tuple[str, bool], ...]  # (name, descending)
    select: tuple[str, ...] | None
    limit: int | None

    @property
    def document(self) -> bool:
        return self.engine == "mongodb"


def read_payload(payload, limits: tuple[int, int] | None = None) -> Request:
    """Rules Q1-Q12 for the payload's shape; ``limits`` = (default, most) where the caller wants them."""
    if not isinstance(payload, dict) or not payload:
        raise QueryError("a query is a dictionary that isn't empty")
    engine = str(payload.get("engine", ENGINES[0])).lower()
    if engine not in ENGINES:
        raise QueryError(f"engine is one of {', '.join(ENGINES)}")
    if any(isinstance(v, str) and v.strip().split(" ")[0].lower() in FORBIDDEN_WORDS for v in payload.values()):
        raise QueryError("query text isn't accepted, only its parts")
    document = engine == "mongodb"
    where = payload.get("filter" if document else "where") or {}
    if not isinstance(where, dict):
        raise QueryError("conditions are a dictionary of names")
    select = payload.get("select")
    if select is not None and not (isinstance(select, (list, tuple)) and select):
        raise QueryError("select names at least one column")
    return Request(
        engine,
        tuple(c for name, spec in where.items() for c in _conditions(name, spec, DOCUMENT_OPERATORS if document else TABULAR_OPERATORS)),
        tuple(_direction(entry, document) for entry in _listed(payload.get("sort" if document else "order_by"))),
        None if select is None or document else tuple(select),
        _limit(payload, limits, 0 if document else 1),
    )


def _conditions(name: str, spec, allowed):
    """(name, operator, literal) of one name; a bare literal stands for equality."""
    pairs = spec.items() if isinstance(spec, dict) else [("$eq", spec)]
    if not pairs:
        raise QueryError(f"no operator is given for {name!r}")
    for op, value in pairs:
        if op not in allowed:
            raise QueryError(f"{op!r} is no operator here; there are {', '.join(allowed)}")
        fits, wanted = LITERAL_CHECKS.get(op, (lambda v: True, ""))
        if not fits(value):
            raise QueryError(f"{op} for {name!r} takes {wanted}")
        yield name, op, value


def _listed(spec) -> list:
    if spec is None:
        return []
    if not isinstance(spec, (list, tuple)):
        raise QueryError("an order is a list of names with directions")
    return list(spec)


def _direction(entry, document: bool) -> tuple[str, bool]:
    pair = list(entry.items())[0] if isinstance(entry, dict) and len(entry) == 1 else entry
    if not (isinstance(pair, (list, tuple)) and len(pair) == 2 and str(pair[0])):
        raise QueryError("an order entry is a name with its direction")
    name, word = pair
    if not document:
        return str(name), word is not None and str(word).lower() in TABULAR_DESC_WORDS
    if word not in ASC_WORDS + DESC_WORDS:
        raise QueryError(f"a direction is one of {ASC_WORDS + DESC_WORDS}")
    return str(name), word in DESC_WORDS


def _limit(payload: dict, limits, least: int) -> int | None:
    """Rule Q10: a given limit is kept, unless the caller's is lower; 0 in a document query means none."""
    default, most = limits or (None, None)
    try:
        n = int(payload["limit"]) if "limit" in payload else default
    except (TypeError, ValueError):
        raise QueryError("a limit is a whole number") from None
    if n is None:
        return None
    n = max(least, n if most is None else min(n, most))
    return n or None


# --- documents ----------------------------------------------------------------


def _kind(value: Column) -> Column:
    """Type class of a VARIANT value."""
    name = F.substring_index(F.substring_index(F.schema_of_variant(value), "(", 1), "<", 1)
    return F.when(name.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.lit("NUMBER")).otherwise(name)


def _elements(value: Column) -> Column:
    return F.when(_kind(value) == "ARRAY", F.try_variant_get(value, "$", "array<variant>"))


def reached(variant: Column, path: str) -> Column:
    """array<variant> of the values that a dotted path reaches; a list on the way gives its elements' values (rule Q7).

    The record itself is an object, so its members are read without looking at its whole shape.
    """
    first, *rest = path.split(".")
    values = F.filter(F.array(F.try_variant_get(variant, _key(first), "variant")), lambda v: v.isNotNull())
    for name in rest:
        objects = F.flatten(F.transform(values, lambda v: F.coalesce(_elements(v), F.array(v))))
        values = F.filter(F.transform(objects, _member(name)), lambda v: v.isNotNull())
    return values


def _key(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _member(name: str):
    return lambda v: F.when(_kind(v) == "OBJECT", F.try_variant_get(v, _key(name), "variant"))


def _exact_integer(value: Column) -> Column:
    """The value as DECIMAL(38, 0) where it is stored as a whole number."""
    return F.when(F.schema_of_variant(value).rlike(r"^BIGINT$|^DECIMAL\(\d+,0\)$"), F.try_variant_get(value, "$", "decimal(38,0)"))


def _holds(value: Column, op: str, literal) -> Column:
    """Whether one value compares so with a literal of its own type."""
    compare = COMPARISONS[op]
    kind = _kind(value)
    if literal is None:
        return (kind == "VOID") & F.lit(op in ("$eq", "$gte", "$lte"))
    if isinstance(literal, bool):
        return (kind == "BOOLEAN") & compare(F.try_variant_get(value, "$", "boolean"), F.lit(literal))
    if isinstance(literal, int):
        exact = _exact_integer(value)
        return (kind == "NUMBER") & F.when(exact.isNotNull(), compare(exact, F.lit(Decimal(literal)).cast("decimal(38,0)"))).otherwise(compare(F.try_variant_get(value, "$", "double"), F.lit(float(literal))))
    if isinstance(literal, float):
        return (kind == "NUMBER") & compare(F.try_variant_get(value, "$", "double"), F.lit(literal))
    if isinstance(literal, str):
        return (kind == "STRING") & compare(F.try_variant_get(value, "$", "string"), F.lit(literal))
    return F.lit(op == "$eq") & (F.to_json(value) == json.dumps(literal, separators=(",", ":"), ensure_ascii=False))


def document_condition(variant: Column, path: str, op: str, literal) -> Column:
    """Rules Q2-Q5 on the values of a path: a list matches by itself or by an element."""
    if op == "$ne":
        return ~document_condition(variant, path, "$eq", literal)
    if op == "$in":
        return reduce(operator.or_, (document_condition(variant, path, "$eq", v) for v in literal))
    values = reached(variant, path)
    if op == "$exists":
        return (F.size(values) > 0) == F.lit(bool(literal))
    every = F.concat(values, F.flatten(F.transform(values, lambda v: F.coalesce(_elements(v), F.array().cast("array<variant>")))))
    if op == "$like":
        return F.exists(every, lambda v: (_kind(v) == "STRING") & F.try_variant_get(v, "$", "string").ilike(literal))
    found = F.exists(every, lambda v: F.coalesce(_holds(v, op, literal), F.lit(False)))
    return found | (F.size(values) == 0) if literal is None and op == "$eq" else found


def document_order(variant: Column, path: str, descending: bool) -> list[Column]:
    """Rule Q9: by type class, then by the typed value; a missing value counts as null."""
    value = F.get(reached(variant, path), F.lit(0))
    kind = F.coalesce(_kind(value), F.lit("VOID"))
    rank = F.array_position(F.array(*map(F.lit, TYPE_ORDER)), kind)
    number = F.when(kind == "NUMBER", F.try_variant_get(value, "$", "double"))
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    truth = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in (rank, number, _exact_integer(value), text, truth)]


# --- tables ---------------------------------------------------------------------


def table_condition(column: Column, op: str, literal) -> Column:
    """Rules Q2-Q6 on a typed column, with SQL's nulls; LIKE ignores the case of ASCII letters."""
    if op == "$ne":
        return column != literal
    if op == "$in":
        return column.isin(list(literal))
    return column.ilike(literal) if op == "$like" else COMPARISONS[op](column, literal)


def execute_query(payload: dict, documents: DataFrame | None = None, table: DataFrame | None = None, variant: str = "_v",
                  limits: tuple[int, int] | None = None) -> DataFrame:
    """Rule Q1: a document query over records with a VARIANT column, or a tabular one over typed columns."""
    ask = read_payload(payload, limits)
    source = documents if ask.document else table
    if source is None:
        raise QueryError(f"the source has no {'documents' if ask.document else 'tables'}")
    if ask.document:
        v = F.col(variant)
        conditions = [document_condition(v, *c) for c in ask.conditions]
        order = [k for name, down in ask.order for k in document_order(v, name, down)]
    else:
        named = {n for n, *_ in (*ask.conditions, *ask.order)} | set(ask.select or ())
        if missing := sorted(named - set(source.columns)):
            raise QueryError(f"no column {', '.join(map(repr, missing))} in the table")
        conditions = [table_condition(F.col(n), op, x) for n, op, x in ask.conditions]
        order = [F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_first() for n, down in ask.order]
    out = source.filter(reduce(operator.and_, conditions)) if conditions else source
    out = out.orderBy(*order) if order else out
    out = out.select(*ask.select) if ask.select else out
    return out if ask.limit is None else out.limit(ask.limit)


def answer(result: DataFrame, payload: dict, source_id: str, id_col: str | None = None) -> DataFrame:
    """Rule Q13: one row that says what was asked, how many rows came, and a digest of their ids."""
    ids = F.bit_xor(F.xxhash64(F.col(id_col))) if id_col else F.lit(None).cast("long")
    return result.agg(F.count(F.lit(1)).alias("result_count"), ids.alias("ids_digest")).select(
        F.lit(source_id).alias("source_id"), F.lit(read_payload(payload).engine).alias("engine"),
        F.lit(json.dumps(payload, sort_keys=True, default=str)).alias("query"), "result_count", "ids_digest")
