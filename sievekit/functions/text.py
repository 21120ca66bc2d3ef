"""Text columns: page cleaning, names and input rules.

All built-in expressions; pages are cleaned in-row with array functions, so
no shuffle is needed to split and re-join a document.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievekit.functions.typing import py_strip

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's rules (stated together).
# ---------------------------------------------------------------------------
PAGE_HEADER = "--- PAGE {n} ---"
PAGE_MARKER = "--- PAGE "
ALLOWED_EXTENSIONS = [".txt", ".md", ".pdf"]
SOURCE_ID_PATTERN = r"^[A-Za-z0-9_.-]+$"
SOURCE_ID_MAX_LEN = 60


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_page(page) -> Column:
    """One page: NBSP -> space, join hyphenated line breaks, drop soft hyphens, collapse blank runs, strip."""
    p = F.regexp_replace(_c(page), "\u00a0", " ")
    p = F.regexp_replace(p, r"-\n(?=[A-Za-z])", "")
    p = F.regexp_replace(p, "\u00ad", "")

    p = F.regexp_replace(p, r"\n{3,}", "\n\n")
    return py_strip(p)


def clean_pages(text) -> Column:
    """array<struct<page_no, text>> of the non-empty cleaned pages, each with its header.

    Page numbers are the original form-feed positions (1-based), so an empty
    page leaves a gap, as in the reference.
    """
    normalized = F.regexp_replace(F.regexp_replace(_c(text), "\r\n", "\n"), "\r", "\n")
    pages = F.transform(
        F.split(normalized, "\f", -1),
        lambda p, i: F.struct((i + 1).alias("page_no"), clean_page(p).alias("body")),
    )
    kept = F.filter(pages, lambda p: p["body"] != "")
    return F.transform(kept, lambda p: F.struct(
        p["page_no"].alias("page_no"),
        F.concat(F.lit(PAGE_MARKER), p["page_no"].cast("string"), F.lit(" ---\n\n"), p["body"]).alias("text"),
    ))


def normalize_pdf_text(text) -> Column:
    """Rule S2: cleaned pages joined by a blank line ('' for empty input)."""
    return F.coalesce(F.array_join(F.transform(clean_pages(text), lambda p: p["text"]), "\n\n"), F.lit(""))


def count_page_markers(text) -> Column:
    """Rule S3 (orchestrator form): number of page markers, 0 when none."""
    t = _c(text)
    return F.size(F.split(t, PAGE_MARKER, -1)) - 1


def count_pages(text) -> Column:
    """Rule S3 (parser form): page markers, at least 1 for non-empty text, 0 for empty."""
    t = _c(text)
    return F.when(t.isNull() | (t == ""), F.lit(0)).otherwise(F.greatest(count_page_markers(t), F.lit(1)))


def slugify(x) -> Column:
    """Rule S10: lower-case, runs of non [a-z0-9] -> '_', strip '_', fallback 'default'."""
    s = F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9]+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.when(s == "", F.lit("default")).otherwise(s)


def sanitize_identifier(x) -> Column:
    """Rule S10 (table names): non-alphanumeric -> '_', strip '_', fallback 'source'."""
    s = F.regexp_replace(_c(x), r"(?U)[^\p{Alnum}]", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.when(s == "", F.lit("source")).otherwise(s)


def file_extension(path) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"(\.[^./\\]+)$", 1))


def source_id_problem(source_id) -> Column:
    """Rule S11: NULL when the source id is acceptable, else the reason."""
    s = _c(source_id)
    return (
        F.when(s.isNull() | (F.length(s) == 0), F.lit("source_id is required"))
        .when(F.length(s) > SOURCE_ID_MAX_LEN, F.lit("source_id is too long"))
        .when(~s.rlike(SOURCE_ID_PATTERN), F.lit("source_id has invalid characters"))
    )


def extension_problem(path) -> Column:
    ext = file_extension(path)
    return F.when(~ext.isin(ALLOWED_EXTENSIONS), F.concat(F.lit("unsupported file type: "), ext))


def generated_source_id(path) -> Column:
    """Rule S12: file stem kept to [A-Za-z0-9_-], lower-cased, '-' trimmed, plus 8 hex.

    The suffix is the first 8 hex of sha256(path), so reruns give the same id.
    """
    stem = F.regexp_extract(_c(path), r"([^/\\]*?)(\.[^./\\]*)?$", 1)
    kept = F.lower(F.regexp_replace(stem, r"[^A-Za-z0-9_-]", ""))
    kept = F.regexp_replace(kept, r"^-+|-+$", "")
    base = F.when(kept == "", F.lit("source")).otherwise(kept)
    return F.concat(base, F.lit("_"), F.substring(F.sha2(_c(path), 256), 1, 8))
