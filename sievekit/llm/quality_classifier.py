"""Ordinal quality classifier (operator 1).

A cumulative-link model: P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector for all grades and thresholds kept
in order by their logged gaps. x holds the square roots of the shares of hashed character trigrams, so that its length is 1 for any
text. Fitted in one task on at most SAMPLE labelled rows, those with the least hash of doc_id; scored for every whole text.

Null and empty texts have x = 0 and are scored by the thresholds alone. Labels without a grade are not learnt from. Rows that share a doc_id
are scored one by one. The caller names the columns to carry through.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievekit.llm.common import lean, fit_in_task, sample_rows, small_batches

BINS = 1 << 14
SAMPLE = 6000
EPOCHS = 30
#: Documents less likely than this to have at least grade 1 are rejected.
LEAST_TAIL = 0.3


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the text's character trigrams and the square roots of their shares."""
    c = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0)
    c = np.concatenate(([2], c, [3])).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(50)
    n = np.bincount(h.astype(np.int64), minlength=BINS)
    at = np.flatnonzero(n)
    return at, np.sqrt(n[at] / len(h))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(grades: np.ndarray, xs: list[tuple[np.ndarray, np.ndarray]], levels: int, epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by adaptive gradient steps over small batches; each grade counts alike."""
    rng = np.random.default_rng(7)
    w, g2 = np.zeros(BINS), np.full(BINS, 1e-6)
    raw, r2 = np.zeros(levels - 1), np.full(levels - 1, 1e-6)  # first threshold, then logged gaps
    raw[0] = -0.5 * (levels - 2)
    share = np.bincount(grades, minlength=levels).astype(float)
    cost = np.where(share > 0, len(grades) / np.maximum(share, 1) / max(1, (share > 0).sum()), 0)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(xs)), max(1, len(xs) // 32)):
            theta = np.cumsum(np.concatenate((raw[:1], np.exp(raw[1:]))))
            gw, gt = np.zeros(BINS), np.zeros(levels - 1)
            for i in part:
                at, v = xs[i]
                k, s = grades[i], float(w[at] @ v)
                up = sigmoid(theta[k] - s) if k < levels - 1 else 1.0
                low = sigmoid(theta[k - 1] - s) if k else 0.0
                p = max(up - low, 1e-9)
                du, dl = up * (1 - up) * (k < levels - 1), low * (1 - low) * (k > 0)
                scale = cost[k] / len(part)
                gw[at] += scale * (du - dl) / p * v
                if k < levels - 1:
                    gt[k] -= scale * du / p
                if k:
                    gt[k - 1] += scale * dl / p
            gw += decay * w
            graw = np.concatenate(([gt.sum()], [gt[j:].sum() * np.exp(raw[j]) for j in range(1, levels - 1)]))
            g2 += gw * gw
            w -= rate * gw / np.sqrt(g2)
            r2 += graw * graw
            raw -= 0.1 * graw / np.sqrt(r2)
    return w, np.cumsum(np.concatenate((raw[:1], np.exp(raw[1:]))))


class Model:
    def __init__(self, blob: bytes) -> None:
        got = np.load(io.BytesIO(blob))
        self.w, self.theta = got["w"], got["theta"]

    def score(self, text: str | None) -> tuple[float, np.ndarray]:
        """Expected grade and P(grade >= k) for k = 1, 2, ..."""
        at, v = features(text)
        tail = sigmoid(float(self.w[at] @ v) - self.theta)
        return float(tail.sum()), tail


def train(docs: DataFrame, graded: DataFrame, levels: int, most: int = SAMPLE) -> bytes:
    """graded (doc_id, grade in 0..levels-1) joined to docs (doc_id, text): the model's bytes."""
    chosen = sample_rows(graded.filter("grade IS NOT NULL").select("doc_id", F.col("grade").cast("int")), "doc_id", most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").limit(2 * most).select("grade", "text")

    def run(rows: list[dict]) -> bytes:
        out = io.BytesIO()
        if rows:
            w, theta = fit(np.array([r["grade"] for r in rows]), [features(r["text"]) for r in rows], levels)
        else:
            w, theta = np.zeros(BINS), np.arange(levels - 1) - 0.5 * levels
        np.savez(out, w=w, theta=theta)
        return out.getvalue()

    return fit_in_task(rows, run)


def quality_scores(docs: DataFrame, blob: bytes, carry: list[str], at_least: int = 1) -> DataFrame:
    """The carried columns of docs (..., text) with expected_grade and tail_probability = P(grade >= at_least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(blob)
        for b in batches:
            got = [model.score(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.record_batch([*b.columns[:-1], pa.array([g for g, _ in got], pa.float64()), pa.array([float(t[at_least - 1]) for _, t in got], pa.float64())], names=[*carry, "expected_grade", "tail_probability"])

    small_batches(docs.sparkSession)
    kept = docs.select(*carry, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1])
    return kept.mapInArrow(lean(run), f"{schema}, expected_grade double, tail_probability double")
