"""Repeated runs of sentences (operator 5).

Sentences end at a stop, exclamation or question mark before white space, and at line ends. Every run of `run` consecutive sentences of a
text is hashed (128 bits over the sentences' words, so that blanks don't matter). Runs of equal hash are the same span; its first
occurrence, by doc_id and place, stays, and sentences that any other occurrence covers go. Counts and first places are
taken in each task before hashes are moved, and only runs that do occur twice come back to their documents.

So that passages shorter than `run` sentences are found too, a sentence of at least LONG words counts as a run of its own, and so do
two that have LONG words together. Null text has no sentences. Rows that share a doc_id are told apart by their text; equal rows are the same
document and repeat nothing but themselves. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from sievekit.llm.common import packed_texts, small_batches, stored, text_hash

RUN = 3
LONG = 40
SENTENCE = re.compile(r"[^\n]*?(?:[.!?]+(?=\s)|\n|$)\s*", re.S)


def sentences(text: str) -> list[str]:
    """Pieces of the text, each a sentence with the white space after it; together they are the text."""
    return [s for s in SENTENCE.findall(text) if s]


def runs(parts: list[str], run: int = RUN, long: int = LONG) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, hash) of the runs that are compared."""
    words = [" ".join(p.split()) for p in parts]
    size = [w.count(" ") + 1 if w else 0 for w in words]
    for i in range(len(parts)):
        for n in range(1, run + 1):
            if i + n <= len(parts) and (n == run or sum(size[i : i + n]) >= long):
                yield i, n, xxhash.xxh3_128_digest("\n".join(words[i : i + n]).encode())


def sentence_dedup(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """(doc_id, n_sentences, n_removed, kept string, spans array of [first, last] removed sentences) for every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text in zip(*(c.to_pylist() for c in b.columns)):
                th = text_hash((text or "").encode())
                for first, n, d in runs(sentences(text or ""), run, long):
                    out.append((i, th, first, n, *np.frombuffer(d, np.int64).tolist()))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], names=["doc_id", "th", "at", "n", "h", "g"])

    found = stored(docs.select("doc_id", "text").mapInArrow(hashed, "doc_id long, th long, at int, n int, h long, g long"))
    place = F.struct(F.col("doc_id"), F.col("th"), F.col("at"))
    twice = found.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").drop("last")
    again = found.join(twice, ["h", "g"]).filter(~F.struct("doc_id", "th", "at").eqNullSafe(F.col("first")))
    gone = again.groupBy("doc_id", "th").agg(F.collect_set(F.struct("at", "n")).alias("runs")).withColumnsRenamed({"doc_id": "gid", "th": "gth"})
    texts = packed_texts(docs)
    both = texts.join(gone, texts.doc_id.eqNullSafe(gone.gid) & (texts.th == gone.gth), "left").select("doc_id", "z", "runs")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for i, zt, found in zip(*(c.to_pylist() for c in b.columns)):
                parts = sentences(z.decompress(zt).decode())
                drop = np.zeros(len(parts) + 2, np.int8)
                for r in found or ():
                    drop[r["at"] + 1 : r["at"] + r["n"] + 1] = 1
                edge = np.flatnonzero(np.diff(drop))
                spans = [[int(a), int(c) - 1] for a, c in zip(edge[::2], edge[1::2])]
                kept = "".join(p for p, d in zip(parts, drop[1:]) if not d)
                out.append((i, len(parts), int(drop.sum()), kept, spans))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), CLEAN)], schema=CLEAN)

    return both.mapInArrow(clean, "doc_id long, n_sentences long, n_removed long, kept string, spans array<array<int>>")


TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
CLEAN = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))])
