"""The Kneser-Ney model of operator 6 against plain Python, and what its bands reject."""

import random
from collections import Counter, defaultdict
from math import exp, log

import numpy as np
import pytest

from sievekit.llm import char_model, quality_rules
from sievekit.llm.char_model import ORDER


def judged(spark, texts, parts=5, **more):
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(texts)], "doc_id long, text string, lang string").repartition(parts)
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, ["doc_id"], **more).collect()}
    return [got[i] for i in range(len(texts))]


def plain_perplexities(texts):
    """Modified Kneser-Ney of one language's texts, with everything in memory and strings as keys."""
    clean = [" ".join(t.lower().split()) for t in texts]
    padded = [" " * (ORDER - 1) + t for t in clean]
    raw = {k: Counter(p[i - k + 1 : i + 1] for p in padded for i in range(ORDER - 1, len(p))) for k in range(1, ORDER + 1)}
    n = {ORDER: raw[ORDER]}
    for k in range(ORDER - 1, 0, -1):
        n[k] = Counter(g[1:] for g in n[k + 1])

    def discounts(k):
        a = [max(1, sum(v == i for v in n[k].values())) for i in range(1, 5)]
        y = a[0] / (a[0] + 2 * a[1])
        return [min(max(i - (i + 1) * y * a[i] / a[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]

    d = {k: discounts(k) for k in n}
    total, spare = defaultdict(int), defaultdict(float)
    for k in n:
        for g, v in n[k].items():
            total[k, g[:-1]] += v
            spare[k, g[:-1]] += d[k][min(v, 3) - 1]
    weight = {c: spare[c] / total[c] for c in total}
    p = {"": 1 / (len(n[1]) + 1)}
    for k in range(1, ORDER + 1):
        for g, v in n[k].items():
            p[g] = max(v - d[k][min(v, 3) - 1], 0) / total[k, g[:-1]] + weight[k, g[:-1]] * p[g[1:]]
    copies = Counter(texts)
    out = []
    for t, c, q in zip(texts, clean, padded):
        own = {k: Counter(q[i - k + 1 : i + 1] for i in range(ORDER - 1, len(q))) for k in raw}
        known = lambda g: not g or raw[len(g)][g] > copies[t] * own[len(g)][g]  # noqa: E731, B023
        s = 0.0
        for i in range(ORDER - 1, len(q)):
            w = 0.0
            for k in range(ORDER, -1, -1):
                g = q[i - k + 1 : i + 1]
                if known(g):
                    s += w + log(p[g])
                    break
                if known(g[:-1]):
                    w += log(weight.get((k, g[:-1]), 1.0))
        out.append(exp(-s / len(c)) if c else None)
    return out


VOCABULARY = ["the", "Cat", "sat", "on", "mat,", "dog.", "é", "привет", "x" * 9, "don't", "1/2", "\n\t", "你好世界", "😀", "nul\0"]


@pytest.mark.parametrize("most_rows, parts", [(1 << 20, 1), (1 << 20, 7), (0, 5)])
def test_op6_equals_a_plain_model_in_any_partitioning_and_both_ways(spark, monkeypatch, most_rows, parts):
    monkeypatch.setattr(char_model, "HELD", 200)
    monkeypatch.setattr(char_model, "CHUNK", 2000)
    rng = random.Random(2)
    texts = [" ".join(rng.choices(VOCABULARY, k=rng.randint(1, 80))).strip() + f" z{i % 20}" for i in range(30)]
    texts += [texts[0], texts[0], "unlike anything", "ω" * 20, " \n"]
    got = judged(spark, [(t, "en") for t in texts] + [("the cat sat on another language", None)], parts, most_rows=most_rows)
    want = plain_perplexities(texts)
    assert [r["perplexity"] for r in got[:-1]] == [w if w is None else pytest.approx(w, rel=2e-4) for w in want]
    alone = plain_perplexities(["the cat sat on another language"])[0]
    assert got[-1]["perplexity"] == pytest.approx(alone, rel=2e-4)


def test_op6_verdicts_do_not_depend_on_partitions(spark):
    docs = [(r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert judged(spark, docs, 1) == judged(spark, docs, 13) == judged(spark, docs, 4, most_rows=0)


def test_texts_with_more_characters_than_fit_are_counted_all_the_same():
    rng = random.Random(1)
    for alphabet in (range(97, 123), range(0x4E00, 0x4E40), range(0x3400, 0x3400 + 6000)):
        c = char_model.characters("".join(chr(rng.choice(alphabet)) for _ in range(9000)) + "".join(map(chr, alphabet)))
        rows, n, codes = char_model.grams(c)
        assert (codes is None) == (len(alphabet) > 4096)
        own = char_model.Own(rows, n, codes)
        at = [32] * (ORDER - 1) + c.tolist()
        want = Counter(tuple(reversed(at[i : i + ORDER])) for i in range(len(c)))
        assert dict(zip(map(tuple, rows.tolist()), n.tolist())) == want and rows.tolist() == sorted(rows.tolist())
        for skip, k in ((0, 1), (0, 3), (1, 3), (1, 5), (0, 5)):
            part = Counter()
            for x, m in want.items():
                part[x[: k - skip]] += m
            assert own.times(np.arange(9), skip, k).tolist() == [part[tuple(x[skip:k])] for x in rows[:9].tolist()]


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "".join(chr(0x4E00 + 7 * i) for i in range(200))])
def test_op6_knows_the_words_of_any_script(spark, letters):
    rng = random.Random(8)
    words = ["".join(rng.choices(letters, k=rng.randint(4, 8))) for _ in range(300)]
    clean = [rng.choices(words, k=120) for _ in range(80)]
    respelled = [["".join(rng.sample(w, len(w))) for w in t] for t in clean[:3]]
    got = judged(spark, [(" ".join(t), "xx") for t in [*clean[3:], *respelled]])
    assert min(r["perplexity"] for r in got[77:]) > 3 * max(r["perplexity"] for r in got[:77])


def without_repeats(rng, words):
    """Words drawn at random so that no run of three comes twice: little choice, yet the base rules pass."""
    out, seen = rng.choices(words, k=2), set()
    while free := [w for w in words if (*out[-2:], w) not in seen]:
        out.append(rng.choice(free))
        seen.add(tuple(out[-3:]))
    return out


def test_op6_bands_reject_both_ends_and_keep_clean_texts(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(2000)]
    clean = [rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(80, 400)) for _ in range(300)]
    damaged = [[w if rng.random() > 0.5 else "".join(rng.sample(w, len(w))) for w in t] for t in clean[:5]]
    foreign = [["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(100)] for _ in range(5)]
    low = [t for t in (without_repeats(rng, words[:5]) for _ in range(60)) if len(t) >= 55][:5]
    assert len(low) == 5
    texts = [(" ".join(t), "xx") for t in [*clean[5:], *damaged, *foreign, *low]]
    got = judged(spark, texts)
    assert not any(r["base_failed"] for r in got)
    assert sum(r["kept"] for r in got[:295]) >= 292
    assert not any(r["kept"] for r in got[295:])
    assert all(r["perplexity"] > r["high_perplexity"] for r in got[295:305]) and all(r["perplexity"] < r["low_perplexity"] for r in got[305:])


def test_op6_damaged_texts_of_the_corpus_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    rng = random.Random(4)
    some = [r for r in docs if 1000 < len(r.text) < 6000][::12][:40]
    letters = "abcdefghijklmnopqrstuvwxyz"
    harmed = ["".join(rng.choice(letters) if c.isalpha() and rng.random() < 0.15 else c for c in r.text) for r in some]
    got = judged(spark, [*((r.text, r.lang) for r in docs), *((t, r.lang) for t, r in zip(harmed, some))])
    assert sum(r["kept"] for r in got[len(docs) :]) <= 2
    fine = [r for r in got[: len(docs)] if not r["base_failed"]]
    assert sum(r["kept"] for r in fine) >= 0.93 * len(fine)


def test_op6_refuses_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "b")], "perplexity long, text string, lang string")
    with pytest.raises(ValueError):
        quality_rules.quality_rules(docs, ["perplexity"])
