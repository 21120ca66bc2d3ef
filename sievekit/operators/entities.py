"""Entity enrichment (rules R1-R3).

The entity *finder* is a column plug-in; the default finds e-mail
addresses, URLs and ISO dates with built-in regular expressions (no model).
The collection rules are the reference's: per text, label -> sorted
distinct entity texts, labels with an empty list dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default finder patterns (label -> Java regex).
DEFAULT_PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "URL": r"https?://[^\s<>\"]+",
    "DATE": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
}


def entities(text, patterns: dict[str, str] | None = None) -> Column:
    """Rule R1: map<label, array<string>> of sorted distinct matches; empty/NULL text -> {}."""
    pats = patterns or DEFAULT_PATTERNS
    t = F.col(text) if isinstance(text, str) else text
    entries = [F.struct(F.lit(label).alias("k"),
                        F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(p), 0)))
                        .alias("v"))
               for label, p in pats.items()]
    kept = F.filter(F.array(*entries), lambda e: F.size(e["v"]) > 0)
    return F.map_from_entries(kept)


def ner_labels(ner: Column) -> Column:
    """Rule R3: sorted labels whose entity list is non-empty."""
    return F.array_sort(F.map_keys(F.map_filter(ner, lambda k, v: F.size(v) > 0)))


def enrich(fragments: DataFrame, text_col: str = "raw") -> DataFrame:
    """Rule R2: add ``ner`` computed from the fragment's own text (D3: the raw fragment text)."""
    return fragments.withColumn("ner", entities(text_col))
