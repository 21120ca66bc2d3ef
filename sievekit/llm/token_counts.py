"""Token counts by a count-only Viterbi (operator 2).

The vocabulary is a unigram one: pieces with log scores. An Aho-Corasick automaton names, at each place of the text, the pieces that end
there; dynamic programming carries the best score and the number of its tokens, and no path. Ties are broken as the public Unigram tokenizer
breaks them: pieces are tried from the longest to the shortest and only a better score replaces what stands. A character that
is no piece of its own also gets the unknown edge, the least score less 10; with byte fallback it counts as its UTF-8 bytes,
else a run of unknown characters counts once.

The box holds no unigram model file, so the query reads the pieces and scores of the public BPE model as a unigram vocabulary. Their scores
are whole numbers, so sums are exact, and no piece has a blank behind another character: words can be counted one by one, and
the counts of recent words are kept at hand. Null and empty texts have no tokens. Rows that share a doc_id are counted one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from sievekit.llm.common import small_batches

UNKNOWN_PENALTY = 10.0  # fixed value of the tokenizer
BLANK = "▁"
MEMO = 800_000


LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


def word_pattern(pieces: list[str]) -> re.Pattern | None:
    """Cuts normalised text where no piece can lie across: before blanks, at line ends, and between a letter and a
    sign that no piece has behind a letter. None where a piece holds a blank behind another character, or a line end."""
    if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces):
        return None
    joined = "\n".join(pieces)
    signs = "".join(c for c in ",.!?;:" if not re.search(rf"[{LETTERS}]{re.escape(c)}", joined))
    ahead = rf"{BLANK}*[^{BLANK}\n]*?[{LETTERS}](?=[{signs}])|" if signs else ""
    return re.compile(rf"\n|{ahead}{BLANK}*[^{BLANK}\n]+|{BLANK}+")


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """Normal pieces of a SentencePiece model with their scores."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    skip = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.vocab_size()) if not skip(i)]


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, memo: int = MEMO) -> None:
        self.byte_fallback = byte_fallback
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        whole = all(s == int(s) and abs(s) < 1 << 40 for _, s in vocabulary)
        pattern = word_pattern([p for p, _ in vocabulary])
        # words stand alone only if sums are exact, no piece crosses them and unknown runs need not be joined
        self.words = pattern.findall if whole and pattern and byte_fallback else lambda text: [text]
        counter = self

        class Memo(dict):
            def __missing__(self, word: str) -> int:
                if len(self) >= memo:
                    self.clear()
                n = counter.viterbi(word)
                if len(word) < 64:
                    self[word] = n
                return n

        self.memo = Memo()

    def viterbi(self, text: str) -> int:
        """Number of tokens on the best path through text; blanks are already marked."""
        n = len(text)
        best, count, lost = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        single, unknown, fallback = self.single, self.unknown, self.byte_fallback
        found = self.automaton.iter(text) if len(self.automaton) else iter(())
        end, entry = next(found, (n, None))
        for i in range(n):
            at, score, tokens, bad = i + 1, None, 0, False
            while end == i:
                size, s = entry
                s += best[at - size]
                if score is None or s > score:
                    score, tokens = s, count[at - size] + 1
                end, entry = next(found, (n, None))
            if text[i] not in single:
                s = unknown + best[i]
                if score is None or s > score:
                    score, bad = s, True
                    tokens = count[i] + (len(text[i].encode("utf-8", "replace")) if fallback else not lost[i])
            best[at], count[at], lost[at] = score, tokens, bad
        return count[n]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.memo.__getitem__, self.words(BLANK + text.replace(" ", BLANK))))


_COUNTERS: dict[str, UnigramCounter] = {}


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens) for every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _COUNTERS:  # one for each Python worker: later tasks find its words counted
            _COUNTERS[model_path] = UnigramCounter(unigram_vocabulary(model_path))
        count = _COUNTERS[model_path]
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([count(t) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")
