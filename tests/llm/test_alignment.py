"""Alignment of two tokenizers against their libraries on whole texts, and the monoid of fragments."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sievekit.llm.alignment import Aligner, Fragment, align, closed, composed
from sievekit.llm.queries import QUERIES

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  two  blanks ", "a\nb  c", "▁x", "nul\0 here", "<|endoftext|> <s> </s> <unk>", "你好 世界 😀😀 x", "tab\tand　wide nb \x1c y", "it's we'll  'tis", "x" * 300, "end ", "\n\n  \n", "é" * 40, "a ▁ b"]


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(PATHS[0])
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def whole(text, libraries):
    """Groups of a text from both libraries' tokens of all of it."""
    t, sp = libraries
    if not text:
        return []
    # the byte-level alphabet, from its definition
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    of = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            of[chr(256 + len([x for x in range(b) if x not in plain]))] = b
    a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    of_a = [bytes(of[c] for c in t.id_to_token(i)) for i in a]
    of_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(of_a) == b"".join(of_b) == b" " + text.encode():
        return []

    def ends(parts):
        at, out = 0, []
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    ea, eb = ends(of_a), ends(of_b)
    groups, lo = [], 0
    for e in sorted(set(ea) & set(eb)):
        groups.append(([i for i, x in zip(a, ea) if lo < x <= e], [i for i, x in zip(b, eb) if lo < x <= e]))
        lo = e
    return groups


def expected(texts, libraries):
    found = [whole(t or "", libraries) for t in texts]
    count = Counter(p for groups in found for p in {(a, b) for x, y in groups for a in x for b in y})
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for groups in found:
        links = [(a, b) for x, y in groups for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n = sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups)
        out.append((*n, len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def test_query_against_the_libraries(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_fragment_alignment"][0](spark, "/root/testdata/sf0.001").collect()}
    want = expected([r.text for r in docs], libraries)
    assert got == {r.doc_id: w for r, w in zip(docs, want)}


@pytest.mark.parametrize("size, most_pairs", [(64 << 10, 4 << 20), (7, 4 << 20), (64, 0), (500, 0)])
def test_any_range_and_both_ways_give_the_same(spark, libraries, size, most_pairs):
    rng = random.Random(3)
    texts = [None, *ODD, *(" ".join(rng.choices(["the", "Quality", "naïve", "x1y2", "😀", "don't", "\n", "", "12345", "zzqqzz"], k=rng.choice([3, 40, 300]))) for _ in range(12))]
    texts += texts[5:9]
    rows = [(i // 2, t, "c", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, rid int")
    got = align(docs, *PATHS, size=size, fan=2, most_pairs=most_pairs).collect()
    want = [(i, *w) for (i, *_), w in zip(rows, expected(texts, libraries))]
    assert sorted(map(tuple, got)) == sorted(want)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (1, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in align(docs, *PATHS).collect()}
    assert got[None].n_links == got[None].n_best == got[None].count_sum == 2 and got[1].groups_sha256 == "" and got[1].n_a == 0
    assert align(docs.limit(0), *PATHS).collect() == []


def test_fragments_are_a_monoid():
    aligner = Aligner(*PATHS)
    text = "An unbelievably 你好 long-winded sentence about naïveté, 😀 and so on. " * 3
    parts = [f for _, f, _ in aligner.ranged(text, 0, 3)]
    rng = random.Random(1)

    def fold(some):
        if len(some) == 1:
            return some[0]
        i = rng.randint(1, len(some) - 1)
        return composed(fold(some[:i]), fold(some[i:]), aligner.width)

    trees = [fold(parts) for _ in range(20)]
    assert all(t == trees[0] for t in trees)
    assert composed(Fragment(), trees[0], aligner.width) == trees[0] == composed(trees[0], Fragment(), aligner.width)
    n, links = closed(trees[0], aligner.width)
    whole_ = aligner.aligned([text])[0]
    assert n == whole_[2] and trees[0].n == whole_[:2] and dict(links) == dict(zip(whole_[4].tolist(), whole_[5].tolist()))
