"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.llm.multi_index import Index, best_of, fitted, nearest
from sievekit.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, shard int, cell string"


def brute(vectors: dict[int, list[float]], queries: list[int], k: int = 20):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], float)
    out = {}
    for q in queries:
        s = x @ np.array(vectors[q], float)
        s = np.round(s, 12)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return out


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_against_brute_force(spark, sf):
    path = f"/root/testdata/sf{sf}"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()}
    got = {}
    for r in QUERIES["op13_multi_index"][0](spark, path).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    true = brute(vectors, [i for i in vectors if i % 20 == 0])
    assert set(got) == set(true)
    hits = 0
    for q, rows in got.items():
        assert [r.rank for r in rows] == list(range(1, len(true[q]) + 1)) and q not in {r.vec_id for r in rows}
        assert all(abs(r.score - np.dot(np.array(vectors[r.vec_id], float), np.array(vectors[q], float))) < 1e-12 for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hits += len({r.vec_id for r in rows} & {i for i, _ in true[q]})
    assert hits >= 0.9 * sum(map(len, true.values()))


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)


def found(spark, rows, **more):
    got = nearest(table(spark, rows), F.col("vec_id") % 20 == 0, **more).orderBy("query_id", "rank").collect()
    return {q: [(r.vec_id, round(r.score, 9)) for r in got if r.query_id == q] for q in {r.query_id for r in got}}


def test_copies_are_whole_and_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(0)
    other = [(i, rng.normal(size=6).astype("f4").tolist()) for i in range(1000, 1200)]
    rows = [(i, [1.0, 0.0, 0.0, 0.0, 2.0, 0.0]) for i in range(300)] + other
    got = found(spark, rows, target=1.0, shard=40)
    true = brute(dict(rows), [i for i, _ in rows if i % 20 == 0])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in true.items()}
    assert [i for i, _ in got[0]] == [i for i, s in true[0]]


def test_norms_differ(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=9) * rng.choice([0.1, 1, 5])).astype("f4").tolist()) for i in range(800)]
    true, got = brute(dict(rows), list(range(0, 800, 20))), found(spark, rows)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in true[q]}) for q in true) >= 0.9 * 20 * 40


def test_edge_cases(spark):
    bad = [(20, None), (None, [1.0, 0.0]), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [None, 1.0]), (100, [float("inf"), 1.0]), (120, [1.0]), (140, [])]
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0]), (160, [0.0, 1.0])]
    assert found(spark, rows + bad) == {0: [(1, 0.5), (160, 0.0), (2, -1.0)], 160: [(1, 0.5), (0, 0.0), (2, 0.0)]}
    assert found(spark, []) == {} and found(spark, bad[:2]) == {}
    assert found(spark, [(0, [1.0])]) == {}
    assert found(spark, [(0, [2.0]), (3, [3.0])]) == {0: [(3, 6.0)]}


def test_walk_is_in_order_of_distance():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 5))
    longest = float(np.sqrt((x * x).sum(1).max()))
    index = Index((fitted(x[:, :2], 7), fitted(np.hstack((x[:, 2:], np.zeros((500, 1)))), 9)), longest)
    index.filled(np.bincount(index.cells(x), minlength=63), 20)
    d1, d2 = index.to_centroids(x[:1])
    cells = index.walk(d1[0], d2[0], 500)
    total = (d1[0][:, None] + d2[0]).ravel()
    assert [total[c] for c in cells] == sorted(total[c] for c in np.flatnonzero(index.size))
    assert index.before(d1[0], d2[0], np.array(cells))[-1] == 500
    at = [(index.first[c] + j, c) for c in range(63) for j in range(index.parts[c]) if index.size[c]]
    assert len({s for s, _ in at}) <= index.shards and max(s for s, _ in at) < index.shards


def test_best_of_breaks_ties_by_id():
    s = np.array([1.0, 2.0, 2.0, 2.0, 0.5])
    assert [i for _, i, _ in best_of(s, [[9], [8], [3], [5], [1]], 5, 2)] == [3, 8]
