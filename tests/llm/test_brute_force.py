"""The registered queries against brute force, public libraries or held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from sievekit.llm import packing, quality_rules, suffix_dedup, toxicity
from sievekit.llm.fingerprint import difference, fingerprints, sketch
from sievekit.llm.piece_transducer import Transducer
from sievekit.llm.queries import QUERIES
from sievekit.llm.sentence_dedup import runs, sentences
from sievekit.llm.token_counts import UnigramCounter, unigram_vocabulary

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def rows(spark, name, sf=SMALL):
    return {r["doc_id"]: r for r in QUERIES[name][0](spark, sf).collect()}


def uncovered(raw: bytes, windows: Counter, length: int) -> bytes:
    mark = bytearray(len(raw))
    for i in range(len(raw) - length + 1):
        if windows[raw[i : i + length]] > 1:
            mark[i : i + length] = b"\1" * length
    return bytes(x for x, m in zip(raw, mark) if not m)


def test_op7_removes_repeated_strings(spark, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    windows = Counter(r[i : i + 400] for r in raw.values() for i in range(len(r) - 399))
    got = rows(spark, "op7_suffix_dedup")
    assert len(got) == len(raw)
    for i, r in raw.items():
        left = uncovered(r, windows, 400)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(r), len(r) - len(left), hashlib.sha256(left).hexdigest())


def test_op7_frequent_kgrams_take_the_counted_way(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("ab", k=90)) for _ in range(4)]
    texts = ["".join(rng.choice(base)[rng.randint(0, 30) :] + rng.choice("xyz") for _ in range(4)) for _ in range(12)]
    windows = Counter(t.encode()[i : i + 40] for t in texts for i in range(len(t) - 39))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (0, 3, 10_000):
        got = suffix_dedup.suffix_dedup(docs, length=40, k=8, hot=hot).collect()
        assert {r["doc_id"]: bytes(r["kept"]) for r in got} == {i: uncovered(t.encode(), windows, 40) for i, t in enumerate(texts)}


def test_op7_sort_survives_hash_collisions(monkeypatch):
    monkeypatch.setattr(suffix_dedup.Contexts, "common", lambda self, x, y: np.minimum(self.end[x] - self.start[x], self.end[y] - self.start[y]))
    parts = [bytes(random.Random(i).choices(b"ab", k=9)) for i in range(20)]
    order, lcp = suffix_dedup.Contexts(parts).sort(np.zeros(20, np.int64))
    assert [parts[i] for i in order] == sorted(parts)


def word_set(text: str) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def nearest(texts: dict[int, str]) -> dict[int, int]:
    sets, holders, parent = {i: word_set(t) for i, t in sorted(texts.items())}, defaultdict(list), {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        shared = Counter()
        for x in s:
            shared.update(holders[x])
            holders[x].append(i)
        for j, c in shared.items():
            if 100 * c >= 85 * (len(s) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in texts}


def test_op10_components(spark, texts):
    got, want = rows(spark, "op10_bbit_minhash"), nearest(texts)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(word_set(t)), want[i], want[i] == i) for i, t in texts.items()}


def paragraphs(text):
    """The words of each line, cut after a stop and after every word whose hash is a multiple of 16."""
    found = set()
    for line in text.split("\n"):
        part = []
        for w in re.findall(r"[^ \t\n\x0b\f\r]+", line):
            part.append(w)
            if w[-1] in ".!?" or xxhash.xxh64_intdigest(w.encode(), 42) % 16 == 0:
                found.add(tuple(part))
                part = []
        if part:
            found.add(tuple(part))
    return found


def test_op9_fingerprints(spark, texts):
    got, ids = rows(spark, "op9_bloom_lookup_fingerprints"), sorted(texts)
    for n, i in enumerate(ids):
        t, other = texts[i], texts[ids[(n + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + other[: len(t) // 2]
        a, b, c = map(paragraphs, (t, edited, other))
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["near_edited"] == pytest.approx(len(a & b) / len(a | b)) and got[i]["near_next"] == pytest.approx(len(a & c) / len(a | c))


def test_op9_one_line_texts_stay_near_their_edits(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    lines = [" ".join(word() for _ in range(rng.randint(80, 140))) + rng.choice(["", "."]) for _ in range(60)]
    got = fingerprints(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert len(got) == 60 and sum(r["near_edited"] > r["near_next"] for r in got) >= 54  # a half without a cut is rare at this length


@pytest.mark.parametrize("kept", [0, 1, 900, 2990, 3000])
def test_op9_differences_of_long_documents(spark, kept):
    """Thousands of differing paragraphs, so that sketches get stuck and groups are dealt again."""
    both = spark.range(1).selectExpr("transform(sequence(1, 3000), x -> xxhash64(x)) a", f"transform(sequence({3001 - kept}, {6000 - kept}), x -> xxhash64(x)) b")
    cells = both.withColumns({"ca": F.expr(sketch("a")), "cb": F.expr(sketch("b"))})
    assert cells.select(F.expr(difference("a", "b", "ca", "cb"))).first()[0] == 2 * (3000 - kept)


def test_op8_packs_every_id_once(spark, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = QUERIES["op8_sos_packing"][0](spark, SMALL).collect()
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        parts[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts.items():
        ids, at = np.array(whole.encode(t, add_special_tokens=False).ids + [2], "<u4"), 0
        for r in sorted(parts[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == 1 << (at.bit_length() - 1) <= 4096


def test_op8_level_has_the_least_sum_of_squares():
    rng, state = random.Random(2), packing.SumOfSquares(32)
    for d in range(400):
        n = rng.randint(1, 31)
        count = state.count.copy()

        def cost(level):
            c = count.copy()
            c[level] -= level > 0
            c[level + n] += level + n < 32
            return (c[1:32] ** 2).sum()

        allowed = [0] + [h for h in range(1, 33 - n) if count[h]]
        assert cost(state.level_for(n)) == min(map(cost, allowed))
        state.place((d, 0, np.arange(n), n))


def test_op5_against_a_plain_loop(spark, texts):
    first, gone = {}, {i: set() for i in texts}
    for i in sorted(texts):
        for at, n, h in runs(sentences(texts[i])):
            if first.setdefault(h, (i, at)) != (i, at):
                gone[i].update(range(at, at + n))
    got = rows(spark, "op5_sentence_spans")
    for i, t in texts.items():
        left = "".join(s for n, s in enumerate(sentences(t)) if n not in gone[i])
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (len(gone[i]), hashlib.sha256(left.encode()).hexdigest())
    assert any(gone.values())


def test_op6_base_counts(spark, texts):
    got = rows(spark, "op6_kneser_ney_rules")
    for i, t in texts.items():
        w, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", t), set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        tri = Counter(zip(w, w[1:], w[2:]))
        repeat = len({j + k for j, x in enumerate(zip(w, w[1:], w[2:])) if tri[x] > 1 for k in range(3)})
        r = got[i]
        assert [r[c] for c in quality_rules.COUNTS] == [len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, repeat]
        assert r["base_failed"] == (len(w) < 50 or 100 * repeat > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def odd_texts() -> list[str]:
    rng = random.Random(3)
    some = ["", " ", "  a ", "\n\n", "Hello  world\n你好 x<s>", "zażółć 😀😀", "x" + " " * 15 + "y" + " " * 40, "def f(x):\n        return x**2", "a\tb\x00c", "12345678901234567890", "a" * 40]
    return some + ["".join(rng.choices("abcdefghij  .,\n-'\"()ABCéü你", k=rng.randint(1, 120))) for _ in range(200)]


def test_op3_encodes_and_decodes_as_the_model(texts):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    t, sp = Transducer(path), SentencePieceProcessor(model_file=path)
    for x in [*texts.values(), *odd_texts()]:
        ids = t.encode(x)
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(x) and t.decode(ids) == sp.decode(sp.encode(x)) == x


def test_op2_counts_as_the_unigram_tokenizer(texts):
    from tokenizers import models

    vocabulary = unigram_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    count = UnigramCounter(vocabulary)
    whole = models.Unigram([("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *vocabulary], 0, True)
    for x in [*texts.values(), *odd_texts()]:
        if "<" not in x:
            assert count(x) == (len(whole.tokenize("▁" + x.replace(" ", "▁"))) if x else 0)
    # ties, unknown runs and fractions of scores: whole texts, without byte fallback
    small = [("a", -1.5), ("b", -1.5), ("ab", -3.0), ("ba", -2.25), ("▁", -2.0), ("▁a", -3.5)]
    count, whole = UnigramCounter(small, byte_fallback=False), models.Unigram([("<unk>", 0.0), *small], 0, False)
    rng = random.Random(4)
    for _ in range(300):
        x = "".join(rng.choices("ab c", k=rng.randint(1, 30)))
        assert count(x) == len(whole.tokenize("▁" + x.replace(" ", "▁"))), x


def test_op1_tells_poor_from_good_outside_the_sample(spark):
    from sievekit.llm import quality_classifier
    from sievekit.llm.queries import documents, grades

    docs, known = documents(spark, MIDDLE), grades(spark, MIDDLE)
    blob = quality_classifier.train(docs, known.filter("doc_id % 3 <> 0"), 3)
    got = quality_classifier.quality_scores(docs, blob, ["doc_id"]).join(known.filter("doc_id % 3 = 0"), "doc_id").collect()
    right = [(r["tail_probability"] >= 0.5) == (r["grade"] > 0) for r in got]
    assert sum(right) >= 0.95 * len(right)
    assert np.mean([r["expected_grade"] for r in got if r["grade"] == 2]) > np.mean([r["expected_grade"] for r in got if r["grade"] == 0]) + 1


def test_op4_held_out_documents_and_inserted_letters(spark):
    from sievekit.llm.queries import documents, labels

    docs, known = documents(spark, "/root/testdata/sf0.1"), labels(spark, "/root/testdata/sf0.1")
    blob = toxicity.train(docs, known, most=1000)
    got = toxicity.toxicity(docs.join(known.select("doc_id", "toxic"), "doc_id").select("doc_id", "text"), blob).filter("held_out").join(known, "doc_id").collect()
    toxic = [r["predicted"] for r in got if r["toxic"] == 1]
    clean = [r["predicted"] for r in got if r["toxic"] == 0]
    assert np.mean(toxic) >= 0.85 and np.mean(clean) <= 0.02
    model = toxicity.Model.load(blob)
    for plain, odd in (("such an idiot he is", "such an id.i*ot he is"), ("you stupid man", "you s t u p i d man"), ("what a clown", "what a cl0wn")):
        assert model.score(odd) == pytest.approx(model.score(plain), abs=0.05)
    word = lambda x: model.best(*toxicity.folded(x))
    assert word("idxiot") > word("reading") and word("pathextic") > word("thether")


def test_op4_kernel_counts_gapped_subsequences():
    def plain(a, b):
        def count(s):
            s, got = f" {s} ", defaultdict(float)
            for i in range(len(s)):
                for places, weight in toxicity.COMBOS:
                    if i + places[-1] < len(s):
                        x = s[i] + "".join(s[i + p] for p in places)
                        if " " not in s[i + 1 : i + places[-1]]:
                            got[x] += weight
            return got

        x, y = count(a), count(b)
        return sum(v * y[k] for k, v in x.items()) / sum(v * v for v in y.values()) ** 0.5

    kernel = toxicity.Kernel(["idiot", "stupid", "reader"])
    s, starts = toxicity.folded("an idxiot reads stupidly")
    got = kernel.words(s, starts) * toxicity.norms(s, starts)[:, None]
    want = [[plain(w, z) for z in ("idiot", "stupid", "reader")] for w in ("an", "idxiot", "reads", "stupidly")]
    assert np.allclose(got, want, atol=1e-5)


def test_pipeline_stages_against_brute_force(spark):
    docs, kept = corpus_pipeline.documents(spark, SMALL), None
    text = lambda d: {r["doc_id"]: r["text"] for r in d.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = text(docs), corpus_pipeline.stored(stage(spark, docs, SMALL))
        if name == "quality rules":
            assert all(len(re.findall(r"[^\x20\x09-\x0D]+", t)) >= 50 for t in text(docs).values())
        if name == "MinHash near-dedup":
            assert set(text(docs)) == {i for i, c in nearest(before).items() if i == c}
        if name == "suffix-array dedup":
            raw = {i: t.encode() for i, t in before.items()}
            windows = Counter(r[i : i + 400] for r in raw.values() for i in range(len(r) - 399))
            assert text(docs) == {i: uncovered(r, windows, 400).decode(errors="ignore") for i, r in raw.items()}
        if name == "packing":
            kept = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("m")).collect()
            assert {r["doc_id"] for r in kept} == set(before) and all(r["n"] == r["m"] for r in kept)
    assert kept
