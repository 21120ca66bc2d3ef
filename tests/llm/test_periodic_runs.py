"""Periodic runs against the definition, written out."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from sievekit.llm.periodic_runs import collapsed, numbered, periodic_runs, planted, runs_of, segments
from sievekit.llm.queries import QUERIES


def by_definition(w, least=24, repeats=3):
    """Maximal stretches of each period; those whose smallest period it is."""
    n, out = len(w), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(least, repeats * q) and not any(all(w[x] == w[x + d] for x in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(150))
def test_runs_by_definition(seed):
    rng = random.Random(seed)
    w = []
    while len(w) < rng.choice([30, 120, 400]):
        unit = [rng.choice("abcdefgh"[: rng.choice([1, 2, 4, 8])]) for _ in range(rng.choice([1, 2, 3, 7, 9, 15, 16, 17, 31, 33, 50]))]
        w += (unit * rng.choice([1, 3, 3, 4, 9]))[: rng.choice([10, 24, 60, 500])]
        w += rng.choices("abcxyz", k=rng.choice([0, 0, 1, 5]))
    assert runs_of(numbered([c.encode() for c in w])) == by_definition(w)
    assert runs_of(numbered([c.encode() for c in w]), 9, 4) == by_definition(w, 9, 4)


def test_segments_hold_no_rare_word_and_every_run():
    rng = np.random.default_rng(1)
    ids = np.concatenate((rng.integers(0, 400, 3000), np.tile(rng.integers(0, 400, 70), 5), rng.integers(0, 400, 900)))
    found = segments(ids, 24, 3)
    for lo, hi in found:
        assert np.unique(ids[lo:hi], return_counts=True)[1].min() >= 3
    assert any(lo <= 3000 and hi >= 3350 for lo, hi in found)


def test_long_texts_are_not_quadratic():
    ids = np.concatenate((np.zeros(200_000, np.int64), np.tile(np.arange(50_000), 4), np.random.default_rng(0).integers(0, 50, 200_000)))
    got = runs_of(ids)
    assert (0, 200_001, 1) in got and (200_000, 200_000, 50_000) in got


def test_collapsed_keeps_first_periods():
    words = [b"x"] + [b"a", b"b"] * 12 + [b"y"]
    assert collapsed(words, runs_of(numbered(words))) == "x a b y"


def test_query_against_definition(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"][0](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(docs)
    n_planted = 0
    for i, text in docs.items():
        w = text.encode().split()
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            n_planted += 1
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
            assert w == planted(i, text.encode().split())
        if len(w) > 700 and h % 10:
            continue  # the definition is cubic
        runs = by_definition(w)
        gone = {x for s, size, q in runs for x in range(s + q, s + size)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
    assert n_planted > 10


def test_edge_cases(spark):
    rows = [(1, None, 0.5), (1, "", 0.5), (None, "a " * 40, 0.5), (2, "a " * 40, 0.5), (2, "a " * 40, 0.5), (3, "   é\tb", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs double")
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect()))
    one = [(0, 40, 1)]
    assert got == [(0, 40, one, "a"), (1, 0, [], ""), (1, 0, [], ""), (2, 40, one, "a"), (2, 40, one, "a"), (3, 3, [], "   é b")]
    assert periodic_runs(docs.limit(0)).collect() == []
