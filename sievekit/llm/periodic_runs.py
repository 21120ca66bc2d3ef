"""Periodic runs of words (operator 12): stretches in which words repeat with a period, and texts with the repeats taken out.

Words are `[^\\x20\\x09-\\x0D]+`. A run is a stretch of words with smallest period q, of max(LEAST_WORDS, REPEATS * q) words or more, that no
neighbouring word extends. Every word of a run occurs REPEATS times in it, so a word that occurs more rarely in the segment at hand can't lie in
one: such words split the segment, which makes other words rare in the parts, until no segment has a rare word. Texts without runs mostly end here.

A surviving segment is scanned by lags, in scales: for lags of (m/2, m] a run matches itself over m words or more, and as m is less than twice the
lag, the nearest next occurrence of its windows of m words is exactly one period ahead (a nearer one would make the period smaller, by
the theorem of Fine and Wilf). So neighbouring windows with the same distance to their next occurrence are a run; every one found is compared word
by word. A scale sorts the windows' hashes, there are log(n) scales: n log^2 n for a text of n words, whatever repeats in it. The splitting is linear
a round; rounds are few in texts, though one made for it can split off a word a round.

Null and empty texts have no words and no runs. Rows that share an id are judged one by one. Only doc_id, text and the carried columns are read. A text
is worked on whole in one task: memory is in proportion to the longest text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sievekit.llm.common import POWERS, mixed, small_batches

LEAST_WORDS = 24
REPEATS = 3


def segments(ids: np.ndarray, least: int, repeats: int) -> list[tuple[int, int]]:
    """Stretches of `least` words or more in which every word occurs `repeats` times or more."""
    done, open_ = [], [(0, len(ids))] if len(ids) >= least else []
    while open_:
        at = np.concatenate([np.arange(lo, hi) for lo, hi in open_])
        of = np.repeat(np.arange(len(open_)), [hi - lo for lo, hi in open_])
        if len(open_) == 1:
            n = np.bincount(ids[at])[ids[at]]
        else:
            _, inv, count = np.unique(of * (int(ids[at].max()) + 1) + ids[at], return_inverse=True, return_counts=True)
            n = count[inv]
        rare = n < repeats
        cuts = np.split(at[rare], np.searchsorted(of[rare], np.arange(1, len(open_))))
        parts = []
        for (lo, hi), cut in zip(open_, cuts):
            if not len(cut):
                done.append((lo, hi))
                continue
            start = np.concatenate(([lo], cut + 1))
            end = np.concatenate((cut, [hi]))
            long = end - start >= least
            parts += zip(start[long].tolist(), end[long].tolist())
        open_ = parts
    return sorted(done)


def scanned(s: np.ndarray, least: int, repeats: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment."""
    n = len(s)
    m = least - least // repeats  # a run of any period matches itself, one period on, over so many words
    POWERS.to(n + 1)
    p = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(s.astype(np.uint64) + np.uint64(1)) * POWERS.up[:n], out=p[1:])
    low = 0
    while max(least, repeats * (low + 1)) <= n:
        k = n - m + 1
        h = (p[m:] - p[:k]) * POWERS.down[:k]
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        lag = np.zeros(k, np.int64)
        lag[order[:-1][same]] = (order[1:] - order[:-1])[same]
        lag[(lag <= low) | (lag > m)] = 0
        edge = np.flatnonzero(np.diff(lag, prepend=0, append=0))
        for i, j in zip(edge[:-1], edge[1:]):
            q = int(lag[i])
            if q:
                # words i .. j + m - 1 equal those q on, by their hashes; now by the words
                bad = np.flatnonzero(s[i : j + m - 1] != s[i + q : j + m - 1 + q]) + i
                for a, b in zip([i, *(bad + 1)], [*bad, j + m - 1]):
                    if b - a + q >= max(least, repeats * q):
                        yield int(a), int(b - a + q), q
        low, m = m, 2 * m


def runs_of(ids: np.ndarray, least: int = LEAST_WORDS, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period; repeats must be 3 or more."""
    found = [(lo + a, n, q) for lo, hi in segments(ids, least, repeats) for a, n, q in scanned(ids[lo:hi], least, repeats)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds behind its first period, joined by blanks."""
    if not runs:
        return b" ".join(words).decode()
    gone = np.zeros(len(words) + 1, np.int64)
    for a, n, q in runs:
        gone[a + q] += 1
        gone[a + n] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)).decode()


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, repeats: int = REPEATS, before: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs array of (start, length, period), collapsed text) of docs (doc_id, text); before: a change of a document's words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, found, left = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = (text or "").encode().split()  # at the six blanks of the word rule
                words = before(i, words) if before else words
                got = runs_of(numbered(words), least, repeats)
                sizes.append(len(words))
                found.append([{"start": a, "length": n, "period": q} for a, n, q in got])
                left.append(collapsed(words, got))
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(found, RUNS), pa.array(left, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words with a planted run in every tenth document by crc32 of its decimal id (none without an id)."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return (words[:a] + unit * -(-(n - a) // p))[:n]


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period; the first of several, null without runs."""
    better = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, lambda best, x: F.when(better(best, x), x).otherwise(best))


def run_digests(found: DataFrame) -> DataFrame:
    """Numbers and digests of what periodic_runs returns."""
    line = lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))
    rows = found.withColumn("best", strongest(F.col("runs")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
