"""Alignment of two tokenizers over the same texts (operator 11).

Tokenizer A is a byte-level BPE, B a piece model with byte fallback that puts a blank before the text. Where a token of A and one of B end at the same byte,
a group ends; tokens of a group are linked, each of A with each of B. A pair of ids counts the documents that hold it linked.

Fragments: the tokens that end in a range of bytes make a fragment: an open prefix (up to the first common end), closed groups, an open
suffix (behind the last common end), or one open stretch without a common end. Fragments that follow one another compose: suffix and prefix make a closed group.
This is associative, and the empty fragment is neutral. A text beyond RANGE bytes is cut where neither tokenizer can join tokens, its parts are encoded in tasks
of their own, and the tokens are dealt to byte ranges that don't care for words or groups. Ranges are composed in a tree, FAN at a time, in
rounds of grouping; a round carries counts, pairs and the open ends, no text. The digest of the groups, which is sequential, is taken from the same
fragments in order, one at a time. Shorter texts are one range and are aligned where they are read.

Both tokenizers are cut at a blank between two characters that are no white space: A's pattern never goes on across it, and B has no piece with a
blank behind another character (a vocabulary that has one is refused). Parts between such blanks recur: a batch of texts encodes and aligns each
distinct part once, all of them in one pass over arrays.

Counts are sums over documents, taken in the tasks first. They go back to the documents as a sorted array that is broadcast up to
MOST_PAIRS pairs (16 bytes each), and beyond that by a join of each document's distinct pairs, which Spark splits where a pair is
frequent. Both give the same rows.

Null and empty texts, and those whose tokens of A or B don't spell a blank and the text, have no tokens: zeros and an empty digest. Special tokens' strings are plain text.
Rows that share a doc_id are documents of their own. Only doc_id and text are read. A part without a place to cut is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from sievekit.llm.common import small_batches, stored

RANGE = 64 << 10
FAN = 16
TOGETHER = 3 << 20  # bytes of texts whose parts are aligned at once
PLAIN = 10_000
MOST_PAIRS = 4 << 20
HELD = 4 << 20  # pairs that a task holds before it sums them
CUT = re.compile(r"(?<=\S) (?=\S)")
BLANK = "▁"

Group = tuple[tuple[int, ...], tuple[int, ...]]
NONE = np.zeros(0, np.int64)


def byte_decoder() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@dataclass
class Fragment:
    """head: up to the first common end, or all if there is none (not cut); tail: behind the last; links: how often each pair is linked in closed groups."""

    cut: bool = False
    head: Group = ((), ())
    tail: Group = ((), ())
    n_groups: int = 0
    links: Counter = field(default_factory=Counter)
    bad: bool = False
    n: tuple[int, int] = (0, 0)


def joined(x: Group, y: Group) -> Group:
    return x[0] + y[0], x[1] + y[1]


def links_of(g: Group, width: int) -> Counter:
    a, b = Counter(g[0]), Counter(g[1])
    return Counter({i * width + j: n * m for i, n in a.items() for j, m in b.items()})


def composed(x: Fragment, y: Fragment, width: int) -> Fragment:
    """x followed by y."""
    n, bad = (x.n[0] + y.n[0], x.n[1] + y.n[1]), x.bad or y.bad
    if not x.cut:
        return Fragment(y.cut, joined(x.head, y.head), y.tail, y.n_groups, y.links, bad, n)
    if not y.cut:
        return Fragment(True, x.head, joined(x.tail, y.head), x.n_groups, x.links, bad, n)
    links = x.links + links_of(joined(x.tail, y.head), width)
    links.update(y.links)
    return Fragment(True, x.head, y.tail, x.n_groups + 1 + y.n_groups, links, bad, n)


def closed(f: Fragment, width: int) -> tuple[int, Counter]:
    """Number of groups and links of a whole text: its head is a group of its own, and its tail is empty."""
    return (f.n_groups + 1, f.links + links_of(f.head, width)) if f.cut else (0, Counter())


def shown(groups: list[Group]) -> str:
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


#: Fixed value: how the byte-level model of the public file cuts texts into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def lengths(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, parts), np.int64, len(parts))


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (n[i] of them) for each i, one after another."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


class Parts:
    """Alignments of distinct parts of texts: of each part its tokens, groups, groups as text, and links as a slice of `links`."""

    def __init__(self, n: np.ndarray, shown: list[bytes], links: np.ndarray, first: np.ndarray, n_links: np.ndarray, bad: np.ndarray) -> None:
        self.n, self.shown, self.links, self.first, self.n_links, self.bad = n, shown, links, first, n_links, bad


class Aligner:
    def __init__(self, path_a: str, path_b: str) -> None:
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        decode = byte_decoder()
        vocabulary = {bytes(decode[c] for c in token): i for token, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in decode for c in token)}
        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        of = model["vocab"]
        # the same model as ranks, which is faster: where ids are in the order of the merges
        self.ranks = None
        if [of[m] for m in merges] == list(range(256, 256 + len(merges))):
            bpe = {k: v for k, v in vocabulary.items() if v < 256 + len(merges)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=WORD_PATTERN, mergeable_ranks=bpe, special_tokens={})
        self.bytes_a = [b""] * (1 + max(of.values(), default=0))
        for token, i in vocabulary.items():
            self.bytes_a[i] = token
        self.width = self.b.get_piece_size()
        self.bytes_b = []
        for i in range(self.width):
            piece = self.b.id_to_piece(i)
            if BLANK in piece.lstrip(BLANK):
                raise ValueError("a piece holds a blank behind another character: texts can't be cut at blanks")
            self.bytes_b.append(bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace(BLANK, " ").encode())
        self.size_a, self.size_b = lengths(self.bytes_a), lengths(self.bytes_b)
        # ids as text with what follows: a token or the other side, a token or the next group
        self.text = np.array([f"{i}{c}" for c in ",|" for i in range(len(self.bytes_a))] + [f"{i}{c}" for c in ",;" for i in range(self.width)], "S")

    def ids_a(self, parts: list[str]) -> np.ndarray:
        """Ids of parts that each have a blank before them; long ones, whose words may be long too, go to the tokenizers library."""
        if self.ranks and all(len(p) <= PLAIN for p in parts):
            plain = [p == p.strip() for p in parts]  # these can stand in one text
            out, i = [], 0
            while i < len(parts):
                j = i
                while j < len(parts) and plain[j]:
                    j += 1
                if j > i:
                    out += self.ranks.encode_ordinary(" " + " ".join(parts[i:j]))
                else:
                    out += self.ranks.encode_ordinary(" " + parts[i])
                    j += 1
                i = j
            return np.array(out, np.int64)
        encode = lambda p: self.ranks.encode_ordinary(" " + p) if self.ranks and len(p) <= PLAIN else self.a.encode(" " + p, add_special_tokens=False).ids
        return np.fromiter(chain.from_iterable(map(encode, parts)), np.int64)

    def ids_b(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(chain.from_iterable(self.b.encode(parts, num_threads=1)), np.int64)

    def spelled(self, a: np.ndarray, b: np.ndarray, raw: bytes) -> bool:
        return b"".join([self.bytes_a[i] for i in a.tolist()]) == raw == b"".join([self.bytes_b[i] for i in b.tolist()])

    def parts(self, parts: list[str]) -> Parts:
        """Alignments of parts, each with the blank before it; all are worked on at once."""
        parts = sorted(parts, key=lambda p: p != p.strip()) if self.ranks else parts
        raw = [b" " + p.encode() for p in parts]
        a, b = self.ids_a(parts), self.ids_b(parts)
        bad = np.zeros(len(parts), bool)
        if not self.spelled(a, b, b"".join(raw)):
            own = [(self.ids_a([p]), self.ids_b([p])) for p in parts]
            bad = np.array([not self.spelled(x, y, r) for (x, y), r in zip(own, raw)])
            raw = [b"" if f else r for f, r in zip(bad, raw)]
            a, b = (np.concatenate([NONE, *(x[k] for x, f in zip(own, bad) if not f)]) for k in (0, 1))
        ends = np.cumsum(lengths(raw))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        mark = np.zeros((2, (ends[-1] if len(ends) else 0) + 1), bool)
        mark[0, end_a] = True
        mark[1, end_b] = True
        last_a, last_b = mark[1, end_a], mark[0, end_b]  # tokens that end a group
        in_a, in_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        groups = int(last_a.sum())
        n_a, n_b = np.bincount(in_a, minlength=groups), np.bincount(in_b, minlength=groups)
        # tokens in the order in which they are shown
        words = np.empty(len(a) + len(b), self.text.dtype)
        words[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[in_a]] = self.text[a + last_a * len(self.bytes_a)]
        words[np.arange(len(b)) + np.cumsum(n_a)[in_b]] = self.text[2 * len(self.bytes_a) + b + last_b * self.width]
        of_word = np.char.str_len(words)
        letters = words.view(np.uint8)
        text = letters[letters > 0].tobytes()
        times = n_b[in_a]
        links = np.repeat(a, times) * self.width + b[spread((np.cumsum(n_b) - n_b)[in_a], times)]

        def each(at: np.ndarray, total: np.ndarray) -> np.ndarray:
            """Running totals at the ends of the parts."""
            return np.concatenate(([0], total))[np.searchsorted(at, ends, side="right")]

        up_a, up_b = (np.searchsorted(e, ends, side="right") for e in (end_a, end_b))
        up_g = each(end_a, np.cumsum(last_a))
        up_l = each(end_a, np.cumsum(times))
        up_t = np.concatenate(([0], np.cumsum(of_word)))[up_a + up_b]
        from_t = np.concatenate(([0], up_t[:-1])) if len(up_t) else up_t
        shown = [text[i : max(i, j - 1)] for i, j in zip(from_t.tolist(), up_t.tolist())]
        n = np.stack([np.diff(u, prepend=0) for u in (up_a, up_b, up_g)]) if len(parts) else np.zeros((3, 0), np.int64)
        n_links = np.diff(up_l, prepend=0)
        self.order = parts
        return Parts(n, shown, links, up_l - n_links, n_links, bad)

    def aligned(self, texts: list[str]) -> list[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """n_a, n_b, n_groups, digest, pairs (sorted) and how often each is linked, of whole texts."""
        nothing = 0, 0, 0, "", NONE, NONE
        cut = [CUT.split(t) if t else [] for t in texts]
        got = self.parts(list(set(chain.from_iterable(cut))))
        code = {p: i for i, p in enumerate(self.order)}
        at = [[code[p] for p in c] for c in cut]
        size = lengths(at)
        of, flat = np.repeat(np.arange(len(texts)), size), np.fromiter(chain.from_iterable(at), np.int64, int(size.sum()))
        sums = np.stack([np.bincount(of, x[flat], len(texts)) for x in (*got.n, got.bad)]).astype(np.int64)
        both, times = np.unique(of * max(1, len(code)) + flat, return_counts=True)
        of, flat = both // max(1, len(code)), both % max(1, len(code))
        n = got.n_links[flat]
        links = got.links[spread(got.first[flat], n)]
        most = int(links.max(initial=0)) + 1
        keys, inverse = np.unique(np.repeat(of, n) * most + links, return_inverse=True)
        linked = np.bincount(inverse, np.repeat(times, n), len(keys)).astype(np.int64)
        edge = np.searchsorted(keys, np.arange(len(texts) + 1) * most)
        out = []
        for i, c in enumerate(at):
            if not c or sums[3, i]:
                out.append(nothing)
                continue
            digest = hashlib.sha256(b";".join([got.shown[j] for j in c])).hexdigest()
            lo, hi = edge[i], edge[i + 1]
            out.append((*sums[:3, i].tolist(), digest, keys[lo:hi] - i * most, linked[lo:hi]))
        return out

    def ranged(self, part: str, start: int, size: int) -> list[tuple[int, Fragment, list[Group]]]:
        """(first byte, fragment, its closed groups) of each byte range of `size` that tokens of a part, from byte `start` of its text, end in."""
        pieces = CUT.split(part)
        a, b = self.ids_a(pieces), self.ids_b(pieces)
        raw = b" " + part.encode()
        if not self.spelled(a, b, raw):
            return [(start, Fragment(bad=True), [])]
        ends = [start + np.cumsum(size[x]) for size, x in ((self.size_a, a), (self.size_b, b))]
        common = np.intersect1d(*ends)
        out, lo = [], start
        for stop in range((start // size + 1) * size, start + len(raw) + size, size):
            # tokens that end in (lo, stop], and the common ends there
            cut = common[(common > lo) & (common <= stop)]
            ids = []
            for x, e in ((a.tolist(), ends[0]), (b.tolist(), ends[1])):
                at = np.searchsorted(e, [lo, *cut, stop], side="right")
                ids.append([tuple(x[i:j]) for i, j in zip(at[:-1], at[1:])])
            n = sum(map(len, ids[0])), sum(map(len, ids[1]))
            pieces = list(zip(*ids))
            if sum(n):
                links = Counter()
                for g in pieces[1:-1]:
                    links.update(links_of(g, self.width))
                tail = pieces[-1] if len(cut) else ((), ())
                out.append((lo, Fragment(bool(len(cut)), pieces[0], tail, max(0, len(cut) - 1), links, False, n), pieces[1:-1]))
            lo = stop
        return out


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(keys, return_inverse=True)
    return k, np.bincount(at, n, len(k)).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in planes of bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(z: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel()


def packed_links(keys: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    return packed(np.diff(keys, prepend=0)), packed(n)


def short_rows(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*paths)
        for b in batches:
            step = max(1, b.num_rows * TOGETHER // max(1, b.column(1).nbytes))
            for i in range(0, b.num_rows, step):
                some = b.slice(i, step)
                got = aligner.aligned([t or "" for t in some.column(1).to_pylist()])
                links = [packed_links(*g[4:]) for g in got]
                columns = [pa.array([g[j] for g in got], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.record_batch([some.column(0), *columns, pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], names=ROW)

    return docs.mapInArrow(run, schema_of(docs))


ROW = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"]


def schema_of(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary, times binary"


FRAGMENT = "rid long, at long, cut boolean, bad boolean, head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>, n_groups long, n_a long, n_b long, pairs binary, times binary"


def to_row(rid: int, at: int, f: Fragment) -> dict:
    keys = np.fromiter(f.links.keys(), np.int64, len(f.links))
    order = np.argsort(keys)
    pairs, times = packed_links(keys[order], np.fromiter(f.links.values(), np.int64, len(keys))[order])
    return {"rid": rid, "at": at, "cut": f.cut, "bad": f.bad, "head_a": list(f.head[0]), "head_b": list(f.head[1]), "tail_a": list(f.tail[0]), "tail_b": list(f.tail[1]), "n_groups": f.n_groups, "n_a": f.n[0], "n_b": f.n[1], "pairs": pairs, "times": times}


def from_row(r: dict) -> Fragment:
    links = Counter(dict(zip(np.cumsum(unpacked(r["pairs"])).tolist(), unpacked(r["times"]).tolist())))
    return Fragment(r["cut"], (tuple(r["head_a"]), tuple(r["head_b"])), (tuple(r["tail_a"]), tuple(r["tail_b"])), r["n_groups"], links, r["bad"], (r["n_a"], r["n_b"]))


def arrow_schema(df_schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.rsplit(" ", 1) for c in df_schema.split(", "))])


def long_rows(docs: DataFrame, paths: tuple[str, str], size: int, fan: int) -> DataFrame:
    """Rows of long texts: parts encoded in tasks of their own, fragments composed in a tree."""

    def to_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, start = 0, 0
                while True:
                    m = CUT.search(text, at + size)
                    part = text[at : m.start()] if m else text[at:]
                    yield pa.record_batch([pa.array([rid], pa.int64()), pa.array([start], pa.int64()), pa.array([part], pa.string())], names=["rid", "at", "part"])
                    if not m:
                        break
                    at, start = m.end(), start + 1 + len(part.encode())

    leaf = FRAGMENT + ", groups string"

    def to_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*paths)
        for b in batches:
            for rid, at, part in zip(*(c.to_pylist() for c in b.columns)):
                rows = [to_row(rid, lo, f) | {"groups": shown(g)} for lo, f, g in aligner.ranged(part, at, size)]
                yield pa.RecordBatch.from_pylist(rows, arrow_schema(leaf))

    numbered = stored(docs.withColumn("rid", F.monotonically_increasing_id()))
    parts = numbered.select("rid", "text").mapInArrow(to_parts, "rid long, at long, part string")
    fragments = stored(parts.repartition(F.col("rid"), F.col("at")).mapInArrow(to_fragments, leaf))
    width = width_of(paths)

    def compose(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["at"])
        f = Fragment()
        for r in rows:
            f = composed(f, from_row(r), width)
        return pa.Table.from_pylist([to_row(rows[0]["rid"], rows[0]["at"], f)], arrow_schema(FRAGMENT))

    tree = fragments.drop("groups")
    last = fragments.agg(F.max("at")).first()[0] or 0
    span = size * fan
    while True:
        tree = tree.groupBy("rid", F.floor(F.col("at") / span)).applyInArrow(compose, FRAGMENT)
        if span > last:
            break
        tree, span = stored(tree), span * fan

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                f = from_row(r)
                n, links = (0, Counter()) if f.bad else closed(f, width)
                keys = np.array(sorted(links), np.int64)
                pairs, times = packed_links(keys, np.array([links[x] for x in keys.tolist()], np.int64))
                n_a, n_b = (0, 0) if f.bad else f.n
                yield pa.record_batch([[r["rid"]], [n_a], [n_b], [n], [f.bad], [pairs], [times]], names=["rid", "n_a", "n_b", "n_groups", "bad", "pairs", "times"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fragments in order, one open group and one hash at a time."""
        rid, state, first, open_ = None, None, True, ((), ())

        def add(text: str) -> None:
            nonlocal first
            state.update((text if first else ";" + text).encode())
            first = False

        def done() -> pa.RecordBatch:
            if open_ != ((), ()):
                add(shown([open_]))
            return pa.record_batch([[rid], [state.hexdigest()]], names=["rid", "digest"])

        for b in batches:
            for r in b.to_pylist():
                if r["rid"] != rid:
                    if state is not None:
                        yield done()
                    rid, state, first, open_ = r["rid"], hashlib.sha256(), True, ((), ())
                open_ = joined(open_, (tuple(r["head_a"]), tuple(r["head_b"])))
                if r["cut"]:
                    add(shown([open_]))
                    if r["groups"]:
                        add(r["groups"])
                    open_ = tuple(r["tail_a"]), tuple(r["tail_b"])
        if state is not None:
            yield done()

    counts = tree.mapInArrow(finish, "rid long, n_a long, n_b long, n_groups long, bad boolean, pairs binary, times binary")
    ordered = fragments.select("rid", "at", "cut", "head_a", "head_b", "tail_a", "tail_b", "groups").repartition("rid").sortWithinPartitions("rid", "at")
    both = counts.join(ordered.mapInArrow(digests, "rid long, digest string"), "rid").join(numbered.select("rid", "doc_id"), "rid")
    return both.withColumn("groups_sha256", F.when(F.col("bad"), "").otherwise(F.col("digest"))).select(*ROW)


def width_of(paths: tuple[str, str]) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=paths[1]).get_piece_size()


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): in how many rows a pair stands; best: no pair of its id of A stands in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c) for c in np.unique(np.concatenate(held), return_counts=True)], names=["pair", "n"])

        for b in batches:
            for z in b.column(0).to_pylist():
                held.append(np.cumsum(unpacked(z)))
                size += len(held[-1])
                if size >= HELD:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    total = rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    total = stored(total.withColumn("a", F.expr(f"pair div {width}")))
    most = total.groupBy("a").agg(F.max("n").alias("most"))  # an id of A has width pairs at most
    return stored(total.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def align(docs: DataFrame, path_a: str, path_b: str, size: int = RANGE, fan: int = FAN, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    paths, docs = (path_a, path_b), docs.select("doc_id", "text")
    long = F.coalesce(F.octet_length("text") >= size, F.lit(False))
    rows = short_rows(docs.filter(~long), paths).unionByName(long_rows(docs.filter(long), paths, size, fan))
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()))
    counts = pair_counts(rows, width_of(paths))
    if counts.count() <= most_pairs:
        return by_broadcast(rows, counts)
    return by_join(rows, counts)


RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def by_broadcast(rows: DataFrame, counts: DataFrame) -> DataFrame:
    t = counts.orderBy("pair").toArrow()
    table = rows.sparkSession.sparkContext.broadcast(tuple(t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = table.value
        for b in batches:
            sums = []
            for keys, times in zip(b.column("pairs").to_pylist(), b.column("times").to_pylist()):
                at, m = np.searchsorted(pair, np.cumsum(unpacked(keys))), unpacked(times)
                sums.append((int(m.sum()), int(m[best[at]].sum()), int((m * n[at]).sum())))
            by_name = dict(zip(b.schema.names, b.columns)) | {c: pa.array([s[j] for s in sums], pa.int64()) for j, c in enumerate(("n_links", "n_best", "count_sum"))}
            yield pa.record_batch([by_name[c] for c in RESULT], names=RESULT)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def by_join(rows: DataFrame, counts: DataFrame) -> DataFrame:
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, keys, times in zip(*(c.to_pylist() for c in b.columns)):
                k = np.cumsum(unpacked(keys))
                yield pa.record_batch([pa.array(np.full(len(k), rid, np.int64)), pa.array(k), pa.array(unpacked(times))], names=["rid", "pair", "times"])

    asked = rows.select("rid", "pairs", "times").mapInArrow(links, "rid long, pair long, times long").join(counts, "pair")
    sums = asked.groupBy("rid").agg(
        F.sum("times").alias("n_links"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    got = rows.drop("pairs", "times").join(sums, "rid", "left")
    return got.select(*(F.coalesce(c, F.lit(0)).alias(c) if c in ("n_links", "n_best", "count_sum") else F.col(c) for c in RESULT))
