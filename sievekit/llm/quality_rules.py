"""Quality rules and a perplexity filter (operator 6).

Base rules count words, symbols, repeated lines and repeated three-word windows. The model is a modified Kneser-Ney model of ORDER characters over all
texts, by language (see char_model.py): Spark counts it, sorted hash arrays hold it, and it grows with the corpus. A text is scored without its own counts
and those of its exact copies. A language's bands lie around the median log perplexity (nats a character) of the texts that pass the base rules, from exact
ranks of values rounded to UNIT; texts outside are rejected. All sums are of whole numbers or run in one order, so a verdict depends on the table alone, not on
how its rows are dealt to tasks.

Null text has no words and fails the base rules (n_words < 50); its perplexity is null. Null lang is a language of its own, the same as an empty one. Repeated rows
are judged alike. Texts of any length are worked on whole, one at a time. The columns to carry through are named by the caller (names of the result's own
columns are refused); others of the table are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sievekit.llm.char_model import MOST_ROWS, Table, asked_for, hashed, model, with_table
from sievekit.llm.common import IS_SPACE, small_batches, stored, word_hashes

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
MOST_SMALL = 2 << 20  # rows of copies, or of bands, that are broadcast at most: a few numbers each
UNIT = 1e-4  # of log perplexity, for ranks

#: Widths of the bands in log perplexity below and above the median: so many times the distance to the outer decile on that side, which counts as
#: LEAST_SHARE of the distance between the deciles at least. Chosen by labelled and damaged documents of sf0.1; README has the rates.
WIDTHS = (2.5, 5.0)
LEAST_SHARE = 0.1


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "replace")
    w = word_hashes(raw)
    data = np.frombuffer(raw, np.uint8)
    chars = int(len(data) - np.count_nonzero(IS_SPACE[data]) - np.count_nonzero((data & 0xC0) == 0x80))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    repeat = 0
    if len(w) > 3:
        tri = w[:-2] * np.uint64(0x9FB21C651E98DF25) + w[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:]
        in_order = np.sort(tri)
        twice = in_order[1:][in_order[1:] == in_order[:-1]]
        if len(twice):
            at = np.isin(tri, twice)
            mark = np.zeros(len(w), bool)
            for j in range(3):
                mark[j : len(w) - 2 + j] |= at
            repeat = int(mark.sum())
    return len(w), chars, np.count_nonzero(IS_SYMBOL[data]), dup, repeat


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
OWN = [*COUNTS, "base_failed", "perplexity", "low_perplexity", "high_perplexity", "kept"]


def with_copies(docs: DataFrame) -> DataFrame:
    """docs (..., _text, _lang) with the number of rows that have the same text and language."""
    docs = docs.withColumn("_h", F.xxhash64("_text", "_lang"))
    several = stored(docs.groupBy("_h").agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1"))
    if several.count() <= MOST_SMALL:  # then the texts needn't be moved
        several = F.broadcast(several)
    return docs.join(several, "_h", "left").withColumn("_copies", F.coalesce("_copies", F.lit(1))).drop("_h")


def scored(docs: DataFrame, carry: list[str], most_rows: int = MOST_ROWS) -> DataFrame:
    """The carried columns of docs (..., text, lang) with _lang, the base counts, base_failed and the mean log perplexity in units of UNIT."""
    small_batches(docs.sparkSession)
    if clash := {c.lower() for c in carry} & {*OWN, "_lang", "_text", "_copies", "_h"}:
        raise ValueError(f"columns {sorted(clash)} are the result's own")
    docs = docs.select(*carry, F.coalesce("text", F.lit("")).alias("_text"), F.coalesce("lang", F.lit("")).alias("_lang"))
    rows = hashed(asked_for(model(docs.select(F.col("_lang").alias("lang"), F.col("_text").alias("text")))))

    def score(table: Table, b: pa.RecordBatch) -> pa.RecordBatch:
        text, lang, copies = (b.column(b.num_columns - j).to_pylist() for j in (3, 2, 1))
        base = np.array([base_counts(t) for t in text], np.int64).reshape(-1, 5)
        failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
        x = [None if v is None else round(v / UNIT) for v in table.log_perplexities(text, lang, copies)]
        return pa.record_batch([*b.columns[:-3], b.column(b.num_columns - 2), *(pa.array(c) for c in base.T), pa.array(failed), pa.array(x, pa.int64())], names=[*carry, "_lang", *COUNTS, "base_failed", "_x"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    schema = f"{schema}, _lang string, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, _x long"
    return with_table(with_copies(docs), rows, score, schema, most_rows)


def bands(passed: DataFrame, widths: tuple[float, float]) -> DataFrame:
    """(_lang, low, high) from passed (_lang, _x): exact ranks, over one row a language and distinct value."""
    n = passed.groupBy("_lang", "_x").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("_lang")
    n = n.withColumns({"upto": F.sum("n").over(by.orderBy("_x")), "all": F.sum("n").over(by)})
    at = lambda tenths: F.min(F.when(10 * F.col("upto") >= tenths * F.col("all"), F.col("_x")))
    q = n.groupBy("_lang").agg(at(1).alias("d1"), at(5).alias("d5"), at(9).alias("d9"))
    half = lambda width, a, b: F.lit(width) * F.greatest(F.col(a) - F.col(b), F.lit(LEAST_SHARE) * (F.col("d9") - F.col("d1")))
    return q.select(F.col("_lang").alias("_l"), (F.col("d5") - half(widths[0], "d5", "d1")).alias("low"), (F.col("d5") + half(widths[1], "d9", "d5")).alias("high"))


def quality_rules(docs: DataFrame, carry: list[str], widths: tuple[float, float] = WIDTHS, most_rows: int = MOST_ROWS) -> DataFrame:
    """The carried columns of docs with base counts, base_failed, perplexity, its language's bands and the verdict `kept`."""
    got = scored(docs, carry, most_rows)
    edges = stored(bands(got.filter("not base_failed").select("_lang", "_x"), widths))  # a row a language
    both = got.join(F.broadcast(edges) if edges.count() <= MOST_SMALL else edges, F.col("_lang") == F.col("_l"), "left")
    inside = F.coalesce(F.col("_x").between(F.col("low"), F.col("high")), F.lit(False))
    shown = lambda c, name: F.exp(F.col(c) * F.lit(UNIT)).alias(name)
    return both.select(*carry, *COUNTS, "base_failed", shown("_x", "perplexity"), shown("low", "low_perplexity"), shown("high", "high_perplexity"), (~F.col("base_failed") & inside).alias("kept"))
