"""Toxicity by a subsequence-kernel support vector machine with Nystroem landmarks (operator 4).

Texts are folded to letters and blanks (accents, case and signs inside words dropped, look-alike digits turned into letters,
spelled-out letters joined). The kernel of two words counts their common subsequences of P letters within a span of SPAN, each gap
costing LAMBDA, over the words' norms; it bears inserted characters up to the span. Landmarks are words that differ most between toxic
and other labelled documents, and random ones. Words of labelled sentences become Nystroem features: kernel values with the
landmarks times the inverse root of the landmarks' own kernel. A linear SVM is fitted in rounds; a sentence counts by its most
toxic word, and a toxic document by its most toxic sentences, as the round before saw them. The decision is linear in the
subsequences, so it folds into one table for scoring. A document's score is a logistic curve of the decision on its best
sentence, fitted on training documents that the SVM has not seen.

Fitted in one task on at most 2 * SAMPLE labelled rows; scored for every whole text. Null and empty texts have no sentence and get the
score of the lowest decision seen in training. Rows that share a doc_id are scored one by one. Only doc_id and text are read, and the labels' doc_id and toxic.
"""

from __future__ import annotations

import io
import itertools
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievekit.llm.common import fit_in_task, sample_rows, small_batches

P, SPAN, LAMBDA = 4, 6, 0.5
LETTERS = 27  # 0 is the blank
SAMPLE = 3000
LANDMARKS = 256
#: A missed toxic document weighs as much as this many others in the fit of the score.
MISS_COST = 3.0
REG = 0.2
#: Look-alikes of letters.
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
DROP = 27
COMBOS = [(c, LAMBDA ** (c[-1] + 1 - P)) for c in itertools.combinations(range(1, SPAN), P - 1)]


def _fold() -> np.ndarray:
    table = np.full(0x250, DROP, np.uint8)
    for c in range(len(table)):
        base = LOOK_ALIKE.get(chr(c)) or unicodedata.normalize("NFD", chr(c))[0].lower()
        if chr(c).isspace():
            table[c] = 0
        elif "a" <= base <= "z":
            table[c] = ord(base) - ord("a") + 1
    return table


FOLD = _fold()


def folded(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single blanks with a blank at both ends, and the blank before each word."""
    c = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    s = FOLD[np.minimum(c, len(FOLD) - 1)]
    s = np.concatenate(([0], s[s != DROP], [0])).astype(np.uint8)
    s = np.concatenate((s[:1], s[1:][(s[1:] > 0) | (s[:-1] > 0)]))
    if len(s) > 4:  # a blank between two single letters goes
        single = np.zeros(len(s), bool)
        single[1:-1] = (s[1:-1] > 0) & (s[:-2] == 0) & (s[2:] == 0)
        gone = np.zeros(len(s), bool)
        gone[2:-2] = (s[2:-2] == 0) & single[1:-3] & single[3:-1]
        s = s[~gone]
    return s, np.flatnonzero(s == 0)[:-1]


def norms(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The words' norms, with each of a word's subsequences counted as a feature of its own."""
    size = np.diff(np.append(starts, len(s) - 1)) + 1
    square = np.zeros(len(size))
    for places, weight in COMBOS:
        square += weight * weight * np.maximum(0, size - places[-1])
    return np.sqrt(np.maximum(square, 1.0))


def subsequences(s: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each choice of places: the code of the subsequence that starts at 0, 1, ... and its weight.

    No blank may lie inside; one may be the first or last letter. Others get code 0.
    """
    blanks = np.concatenate(([0], np.cumsum(s == 0)))
    x = [s.astype(np.int32) * LETTERS**i for i in range(P - 1, -1, -1)]
    for places, weight in COMBOS:
        n = len(s) - places[-1]
        if n > 0:
            code = x[0][:n].copy()
            for p, y in zip(places, x[1:]):
                code += y[p : p + n]
            code *= blanks[places[-1] : places[-1] + n] == blanks[1 : 1 + n]
            yield code, weight


def profile(word: str) -> dict[int, float]:
    """A string's subsequences with their weights, scaled to length 1."""
    s = np.array([0, *(ord(c) - 96 for c in word), 0], np.uint8)
    got: Counter = Counter()
    for code, weight in subsequences(s):
        for c in code[code > 0].tolist():
            got[c] += weight
    norm = sum(v * v for v in got.values()) ** 0.5
    return {c: v / norm for c, v in got.items()}


def table_sums(s: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Weighted sums of a table over the subsequences that start at each place."""
    f = np.zeros(len(s))
    for code, weight in subsequences(s):
        f[: len(code)] += weight * table[code]
    return f


class Kernel:
    """Kernel values of strings with the landmarks."""

    def __init__(self, words: list[str]) -> None:
        profiles = [profile(w) for w in words]
        self.codes = np.array(sorted({c for p in profiles for c in p}), np.int64)
        self.row = np.full(LETTERS**P, -1, np.int32)
        self.row[self.codes] = np.arange(len(self.codes))
        self.phi = np.zeros((len(self.codes), len(words)), np.float32)
        for j, p in enumerate(profiles):
            for c, v in p.items():
                self.phi[self.row[c], j] = v
        self.likeness = np.zeros(LETTERS**P, np.float32)
        self.likeness[self.codes] = self.phi[:, : len(words) * 3 // 4].max(axis=1, initial=0)
        own = self.phi.T @ self.phi
        value, vector = np.linalg.eigh(own.astype(np.float64))
        good = value > 1e-6 * value.max(initial=1)
        self.root = (vector[:, good] / np.sqrt(value[good])) @ vector[:, good].T

    def words(self, s: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Kernel values (words x landmarks)."""
        out = np.zeros((len(starts), self.phi.shape[1]), np.float32)
        for code, weight in subsequences(s):
            r = self.row[code]
            hit = np.flatnonzero(r >= 0)
            if len(hit):
                of = np.searchsorted(starts, hit, "right") - 1
                first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                out[of[first]] += weight * np.add.reduceat(self.phi[r[hit]], first, axis=0)
        return out / norms(s, starts)[:, None].astype(np.float32)


def letters(s: np.ndarray) -> list[str]:
    return (s + 96).tobytes().decode().replace("`", " ").split()


def landmarks(docs: list[tuple[list[str], int]], most: int, rng) -> list[str]:
    """Words whose share of toxic documents differs most from that of others, by the likelihood ratio; and random ones."""
    n = Counter(y for _, y in docs)
    count = [Counter(), Counter()]
    for words, y in docs:
        count[y].update({w for w in words if 3 <= len(w) <= 24})

    def ratio(w: str) -> float:
        a, b = count[1][w], count[0][w]
        p = (a + b) / max(1, n[0] + n[1])
        if a * n[0] <= b * n[1]:
            return 0.0
        return 2 * (a * np.log(a / (n[1] * p)) + (b * np.log(b / (n[0] * p)) if b else 0))

    best = sorted((w for w in count[1]), key=lambda w: (-ratio(w), w))[: most * 3 // 4]
    common = sorted(set(count[0]) - set(best))
    return best + [common[i] for i in sorted(rng.choice(len(common), min(len(common), most - len(best)), replace=False))] if common else best


def taken(s: np.ndarray, starts: np.ndarray, take: np.ndarray, rng=None) -> tuple[np.ndarray, np.ndarray]:
    """The taken words; with rng, each with a letter put in at random."""
    ends = np.append(starts[1:], len(s) - 1)
    out = [np.zeros(1, np.uint8)]
    for i in take:
        word = s[starts[i] + 1 : ends[i]]
        if rng is not None:
            word = np.insert(word, rng.integers(1, max(2, len(word))), rng.integers(1, LETTERS))
        out.append(np.append(word, 0).astype(np.uint8))
    got = np.concatenate(out)
    return got, np.flatnonzero(got == 0)[:-1]


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = REG, steps: int = 30) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss, by Newton steps over the rows inside the margin."""
    d = np.concatenate((x, np.ones((len(x), 1))), 1).astype(np.float64)
    ridge = np.eye(d.shape[1]) * reg
    ridge[-1, -1] = 1e-3
    w, inside = np.zeros(d.shape[1]), np.ones(len(y), bool)
    for _ in range(steps):
        a = d[inside] * weight[inside, None]
        w = np.linalg.solve(ridge + a.T @ d[inside], a.T @ y[inside])
        now = y * (d @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps, slightly held back."""
    a = np.zeros(2)
    d = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ a, -30, 30)))
        g = d.T @ (weight * (p - y)) + 1e-2 * a
        h = (d * (weight * p * (1 - p))[:, None]).T @ d + 1e-2 * np.eye(2)
        a -= np.clip(np.linalg.solve(h, g), -2, 2)
    return float(a[0]), float(a[1])


class Model:
    def __init__(self, table: np.ndarray, slope: float, offset: float, lowest: float) -> None:
        self.table, self.slope, self.offset, self.lowest = table, slope, offset, lowest

    def best(self, s: np.ndarray, starts: np.ndarray) -> float:
        """The decision on the best sentence, that is, on its best word."""
        if not len(starts):
            return self.lowest
        return float((np.add.reduceat(table_sums(s, self.table), starts) / norms(s, starts)).max())

    def score(self, text: str | None) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.slope * self.best(*folded(text)) + self.offset, -40, 40))))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, table=self.table, rest=np.array([self.slope, self.offset, self.lowest]))
        return out.getvalue()

    @staticmethod
    def load(blob: bytes) -> "Model":
        got = np.load(io.BytesIO(blob))
        return Model(got["table"], *got["rest"].tolist())


def fit(rows: list[tuple[str | None, int]], prior: float, most: int = LANDMARKS, rounds: int = 5) -> Model:
    """rows (text, toxic); prior: share of toxic documents among the labelled ones."""
    rng = np.random.default_rng(11)
    table = np.zeros(LETTERS**P, np.float32)
    if len({y for _, y in rows}) < 2:
        return Model(table, 0.0, -30.0 if not rows or rows[0][1] == 0 else 30.0, 0.0)
    texts = [(*folded(t), y) for t, y in rows]
    texts = [t for t in texts if len(t[1])]
    held = rng.random(len(texts)) < 0.25
    train = [t for t, h in zip(texts, held) if not h]
    kernel = Kernel(landmarks([(letters(s), y) for s, _, y in train], most, rng))
    others: list[np.ndarray] = []  # words of documents that aren't toxic, more of them each round
    strength = kernel.likeness
    for _ in range(rounds):
        toxic, odd = [], []
        for s, starts, y in train:
            f = np.add.reduceat(table_sums(s, strength), starts) / norms(s, starts)
            best = np.argsort(-f, kind="stable")[: 5 if y else 3]
            if y:
                best = best[f[best] >= 0.8 * f[best[0]]] if f[best[0]] > 0 else best[:1]  # its other insults too
                toxic.append(kernel.words(*taken(s, starts, best)))
                odd.append(kernel.words(*taken(s, starts, best, rng)))
            else:
                best = np.union1d(best, rng.choice(len(starts), min(len(starts), 2), replace=False))
                others.append(kernel.words(*taken(s, starts, best)))
        x = np.concatenate((*others, *toxic, *odd)) @ kernel.root
        y = np.ones(len(x))
        y[: sum(map(len, others))] = -1
        w, _ = svm(x, y, np.where(y > 0, (y < 0).sum() / max(1, (y > 0).sum()) / 3, 1.0))
        table[kernel.codes] = kernel.phi @ (kernel.root @ w)
        strength = table
    model = Model(table, 1.0, 0.0, 0.0)
    some = [t for t, h in zip(texts, held) if h] or texts
    best = np.array([model.best(s, starts) for s, starts, _ in some])
    y = np.array([t[2] for t in some], float)
    toxic = max(y.mean(), 1e-3)
    weight = np.where(y == 1, MISS_COST * prior / toxic, (1 - prior) / max(1 - toxic, 1e-3))
    model.slope, model.offset = logistic(best, y, weight)
    model.lowest = float(min(best.min(), 0.0))
    return model


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> bytes:
    """Fits on labels (doc_id, toxic) that aren't held out, joined to docs (doc_id, text)."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    ids = sample_rows(known.filter("toxic = 1"), "doc_id", most).union(sample_rows(known.filter("toxic = 0"), "doc_id", most))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").orderBy("doc_id", "text").limit(4 * most).select("text", "toxic")
    prior = min(max(float(share or 0.0), 1e-3), 1 - 1e-3)
    return fit_in_task(rows, lambda got: fit([(r["text"], r["toxic"]) for r in got], prior).dump())


def toxicity(docs: DataFrame, blob: bytes) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.load(blob)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([model.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    small_batches(docs.sparkSession)
    got = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
