"""Packing token sequences by the sum-of-squares rule (operator 8).

Each input partition packs its own documents, online and without a shuffle. Whole windows of a long document are
sequences of their own. What is left of a document goes to the fill level that makes the sum of squared counts of
partially filled windows least (a new window counts as level 0, ties go to the fullest); the counts stand in an array
by level. Full windows leave memory at once. At the partition's end the emptiest windows are cut up to fill the
gaps of the fullest exactly, and the single window that may remain is cut into powers of two, so that nothing is padded.

Null text is empty and packs its end-of-document id alone. Repeated rows are packed once each. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sievekit.llm.common import small_batches

WINDOW = 4096
END_ID = 2

#: Fixed values of the tokenizer's pattern, for texts of ASCII and Latin-1 letters and signs alone.
SAFE = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff]*")
LETTERS = "a-zß-öø-ÿ"
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")
MEMO = 400_000


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for letters from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of whole texts, as bytes of little-endian uint16, with the ids of recent words at hand.

    White space and the pattern's bounds part words for good, so a word's ids don't depend on its neighbours. Texts
    outside SAFE, and those that may hold a special token, are cut at blanks only and go through the whole tokenizer.
    """

    def __init__(self, path: str, memo: int = MEMO) -> None:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        if whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        model, table = whole.model, byte_letters()

        class Memo(dict):
            def __init__(self, encode: Callable[[str], list[int]]) -> None:
                self.encode = encode

            def __missing__(self, word: str) -> bytes:
                if len(self) >= memo:
                    self.clear()
                got = np.array(self.encode(word), "<u2").tobytes()
                if len(word) < 64:
                    self[word] = got
                return got

        self.words = Memo(lambda w: [t.id for t in model.tokenize(w.encode().decode("latin-1").translate(table))])
        self.chunks = Memo(lambda c: whole.encode(c, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        if SAFE.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.words.__getitem__, PIECES.findall(text.lower())))
        return b"".join(self(c) if SAFE.fullmatch(c) and "<|" not in c else self.chunks[c] for c in text.replace("\n", " ").split(" ") if c)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker: later tasks find its words known."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class SumOfSquares:
    """Windows open at each level; piece = (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int) -> None:
        self.size, self.count = size, np.zeros(size + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(size + 1)]

    def level_for(self, n: int) -> int:
        """The level whose choice makes the sum of squares least, 0 for a new window."""
        size, count = self.size, self.count
        levels = np.flatnonzero(count[: size - n + 1])
        if not len(levels):
            return 0
        grown = 2 * count[levels + n] + 1
        grown[levels + n == size] = 0
        change = grown - 2 * count[levels] + 1
        best = len(levels) - 1 - int(np.argmin(change[::-1]))
        return int(levels[best]) if change[best] <= 2 * count[n] + 1 else 0

    def place(self, piece: tuple) -> list[tuple] | None:
        """Puts a piece of less than a window away; returns the window if that fills it."""
        n = len(piece[2])
        level = self.level_for(n)
        window = self.open[level].pop() if level else []
        self.count[level] -= level > 0
        window.append(piece)
        if level + n == self.size:
            return window
        self.open[level + n].append(window)
        self.count[level + n] += 1
        return None

    def rest(self) -> Iterator[list[tuple]]:
        """The emptiest windows' pieces fill the fullest windows; what remains is cut at powers of two."""
        windows = [w for level in self.open for w in level]  # by level, emptiest first
        spare: list[tuple] = []
        lo, hi = 0, len(windows)
        while lo < hi:
            hi -= 1
            window = windows[hi]
            gap = self.size - sum(len(p[2]) for p in window)
            while gap and (spare or lo < hi):
                if not spare:
                    spare = windows[lo]
                    lo += 1
                doc, start, ids, total = spare.pop()
                window.append((doc, start, ids[:gap], total))
                if len(ids) > gap:
                    spare.append((doc, start + gap, ids[gap:], total))
                gap -= len(window[-1][2])
            if gap:
                spare = window
            else:
                yield window
        left = sum(len(p[2]) for p in spare)
        while left:
            gap = part = 1 << (left.bit_length() - 1)
            window = []
            while gap:
                doc, start, ids, total = spare.pop()
                window.append((doc, start, ids[:gap], total))
                if len(ids) > gap:
                    spare.append((doc, start + gap, ids[gap:], total))
                gap -= len(window[-1][2])
            yield window
            left -= part


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of docs (doc_id, text).

    ids are little-endian unsigned 32-bit. sequence_id is the partition's number times 2^32 plus its own count.
    """

    small_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, state = encoder(tokenizer_path), SumOfSquares(window)
        last = np.array([end_id], "<u2").tobytes()
        number = TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        size = 0

        def add(pieces: list[tuple]) -> None:
            nonlocal number, size
            at = 0
            for doc, start, ids, total in pieces:
                out.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, number, at))
                at += len(ids)
            size += at
            number += 1

        def flush() -> pa.RecordBatch:
            nonlocal size
            got = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(PIECE), PIECE)], schema=PIECE)
            out.clear()
            size = 0
            return got

        for b in batches:
            for doc, text in zip(*(c.to_pylist() for c in b.columns)):
                ids = np.frombuffer(encode(text or "") + last, "<u2")
                n, whole = len(ids), len(ids) // window * window
                for start in range(0, whole, window):
                    add([(doc, start, ids[start : start + window], n)])
                if whole < n and (full := state.place((doc, whole, ids[whole:], n))):
                    add(full)
                if size > 1_000_000:
                    yield flush()
        for full in state.rest():
            add(full)
            if size > 1_000_000:
                yield flush()
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
