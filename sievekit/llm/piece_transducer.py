"""SentencePiece encoding and decoding by a weighted transducer (operator 3).

Compiled once from a model file: a normaliser (blanks to a mark, a mark before the text), the pieces as a trie with failure arcs, byte arcs for
characters that are no piece (one unknown id for a run of them in a model without byte pieces), and an acceptor of neighbouring pieces. Arc weights are tropical: minus the score for a unigram model. In
a BPE model merges decide, not sums: a sequence of pieces is what merging yields exactly if each two neighbours, merged on
their own, stay as they are; so pieces weigh nothing and a pair of neighbours weighs nothing or infinity. The input is composed with all
of these and its shortest path is the encoding. A piece never holds a blank behind another character, so composition is done word by
word, and the encodings of recent words are kept at hand.

Decoding runs the pieces the other way: byte pieces give their bytes, marks give blanks, and the first mark goes. Null and empty texts have no
ids. A mark in the input is taken for a blank, as the model does. Rows that share a doc_id are encoded one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievekit.llm.common import small_batches
from sievekit.llm.token_counts import word_pattern

MARK = "▁"
MEMO = 800_000
PAIRS = 300_000
INF = float("inf")
NORMAL, UNKNOWN, BYTE, USER = 1, 2, 6, 4  # fixed values of the model format
UNIGRAM, BPE = 1, 2


class Transducer:
    def __init__(self, path: str, memo: int = MEMO) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules, kind = model.normalizer_spec, model.trainer_spec.model_type
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models without character map are compiled")
        if any(p.type == USER for p in model.pieces):
            raise ValueError("user-defined pieces are not compiled")
        self.prefix, self.bpe = rules.add_dummy_prefix, kind == BPE
        self.pieces = [p.piece for p in model.pieces]
        self.score = [p.score for p in model.pieces]
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if self.bpe and not all(ch in self.id for piece in self.id for ch in piece):  # merging would join characters that are no pieces
            raise ValueError("a BPE model's pieces must be made of characters that are pieces")
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.unknown = None if len(byte) == 256 else unknown
        self.fallback = lambda ch: [unknown] if self.unknown is not None else [byte[b] for b in ch.encode("utf-8", "replace")]
        self.worst = min(self.score[i] for i in self.id.values()) - 10.0
        self.trie = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.trie.add_word(piece, (len(piece), i))
        self.trie.make_automaton()
        # what each id gives in decoding
        self.out = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode() if p.type == NORMAL else b"" for p in model.pieces]
        pattern = word_pattern(list(self.id))
        self.words = pattern.findall if pattern else lambda text: [text]
        self.pair: dict[int, bool] = {}
        outer = self

        class Memo(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= memo:
                    self.clear()
                got = np.array(outer.shortest_path(word), "<u4").tobytes()
                if len(word) < 64:
                    self[word] = got
                return got

        self.memo = Memo()

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short string: always the best pair, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = -INF, -1
            for i in range(len(parts) - 1):
                j = self.id.get(parts[i] + parts[i + 1])
                if j is not None and self.score[j] > best:
                    best, at = self.score[j], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stable(self, left: int, right: int) -> bool:
        """Whether the acceptor lets right follow left; -1 stands for a text's start or a byte arc."""
        key = left << 32 | right
        got = self.pair.get(key)
        if got is None:
            if len(self.pair) >= PAIRS:
                self.pair.clear()
            a, b = self.pieces[left] if left >= 0 else "", self.pieces[right]
            got = self.pair[key] = self.merged(a + b) == ([a, b] if a else [b])
        return got

    def shortest_path(self, text: str) -> list[int]:
        """Composes normalised text with the transducer: ids of the path of least weight.

        A state is a place and, for the acceptor's sake, the piece before it; of the states at one place at most one is reached
        at finite weight by a BPE model, and only the lightest counts for a unigram model.
        """
        n = len(text)
        weight, last, back = [INF] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        weight[0] = 0.0
        arcs = self.trie.iter(text)
        end, entry = next(arcs, (n, None))
        bpe, score, stable, alone = self.bpe, self.score, self.stable, self.id
        for i in range(n):
            at = i + 1
            while end == i:
                size, piece = entry
                start = at - size
                if weight[start] < INF:
                    w = weight[start] if bpe else weight[start] - score[piece]
                    if w < weight[at] and (not bpe or stable(last[start], piece)):
                        weight[at], last[at], back[at] = w, piece, start
                end, entry = next(arcs, (n, None))
            if text[i] not in alone and weight[i] < INF:
                w = weight[i] if bpe else weight[i] - self.worst
                if w < weight[at]:
                    weight[at], last[at], back[at] = w, -1, i
        out: list[int] = []
        at = n
        while at:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out += reversed(self.fallback(text[back[at]]))
            at = back[at]
        return out[::-1]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        text = text.replace(" ", MARK)
        ids = b"".join(map(self.memo.__getitem__, self.words(MARK + text if self.prefix else text)))
        if self.unknown is None:
            return ids
        each = np.frombuffer(ids, "<u4")  # neighbouring unknown characters are one piece, across words too
        again = (each[1:] == self.unknown) & (each[:-1] == self.unknown)
        return each[np.r_[True, ~again]].tobytes()

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_TRANSDUCERS: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each Python worker: later tasks find its words encoded."""
    if path not in _TRANSDUCERS:
        _TRANSDUCERS[path] = Transducer(path)
    return _TRANSDUCERS[path]


def encode(docs: DataFrame, model_path: str, carry: list[str]) -> DataFrame:
    """The carried columns of docs (..., text) and ids (binary, little-endian unsigned 32-bit)."""
    small_batches(docs.sparkSession)
    rows = docs.select(*carry, docs.text.alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_path)
        for b in batches:
            yield pa.record_batch([*b.columns[:-1], pa.array([t.encode(x) for x in b.column(b.num_columns - 1).to_pylist()], pa.binary())], names=[*carry, "ids"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", ids binary")


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """rows (..., ids) with the column text."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_path)
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array([t.decode(x or b"") for x in b.column(names.index("ids")).to_pylist()], pa.string())], names=[*names, "text"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", text string")
