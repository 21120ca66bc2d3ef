"""Approximate nearest neighbours by largest inner product (operator 13): an inverted multi-index.

Vectors are cut into two halves, and each half is quantised by its own codebook: a vector lies in the cell of its two centroids. So that the largest
inner product is the least distance, the second half of a vector gets one more component, sqrt(longest^2 - |x|^2), and that of a query 0. A query walks
the cells by the sum of its halves' distances, kept in a heap, until the cells walked hold a share of all entries, then the entries of these cells
are scored by their original vectors in double precision.

The share is measured, not set: the exact neighbours of CALIBRATION vectors (chosen by hash, searched among all rows) show how far a walk has to go to meet
TARGET of them. Vectors without structure need a large share, and say so here rather than by a low recall.

Equal vectors are one entry with its smallest ids, as many as a result can hold (k and the query's own), so copies fill no cell. Cells lie in shards of at
most SHARD entries, a larger cell in several; nothing is dropped. A shard's entries are held in memory and its queries pass by, so a shard that
all queries ask is a long task but never a large one. What is broadcast: codebooks of MOST_CENTROIDS a half at most and the cells' numbers of entries.

Without an id, null, zero, holding null or a non-finite component, or not of the commonest length (the greater of two): takes no part. Of rows with one id the
least vector counts. Equal products: the smaller id first. An empty table has no result. Only vec_id and embedding are read.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import FloatType

from sievekit.llm.common import fit_in_task, stored

K = 20
TARGET = 0.96
CALIBRATION = 128
SAMPLE = 32_768  # vectors that the codebooks are fitted on, at most
MOST_CENTROIDS = 1024
CELL = 4  # entries a cell, on average, until the codebooks are at their largest
SHARD = 65_536
ROUNDS = 10


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding): one vector an id, all of one length, finite and not zero."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = rows.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    rows = rows.filter(F.size(v) == (sizes[0]["n"] if sizes else 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def entries_of(vectors: DataFrame, k: int) -> DataFrame:
    """(embedding, ids): the distinct vectors with their k + 1 smallest ids."""
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    return vectors.withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def matrix(column: pa.Array, kind: str = "f8") -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def halves(x: np.ndarray, longest: float | None) -> tuple[np.ndarray, np.ndarray]:
    """The two halves; longest None: of queries."""
    at = x.shape[1] // 2
    more = np.zeros(len(x)) if longest is None else np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))
    return x[:, :at], np.hstack((x[:, at:], more[:, None]))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)


def fitted(x: np.ndarray, n: int) -> np.ndarray:
    """n centroids at most, by Lloyd's rounds from the first distinct rows."""
    _, first = np.unique(x, axis=0, return_index=True)
    c = x[np.sort(first)[:n]].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([distances(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        size = np.bincount(near, minlength=len(c))
        full = size > 0
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[full] = total[full] / size[full, None]
    return c


class Index:
    """Codebooks, numbers of entries of the cells, and the shards that cells lie in."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], longest: float) -> None:
        self.books, self.longest = books, longest
        self.shape = tuple(len(b) for b in books)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (distances(h, c).argmin(1) for h, c in zip(halves(x, self.longest), self.books))
        return a * self.shape[1] + b

    def filled(self, size: np.ndarray, shard: int) -> "Index":
        """size: entries of each cell. Cells follow one another into shards; one beyond `shard` entries gets as many of its own as it needs."""
        self.size = size
        self.parts = np.maximum(1, -(-size // shard))
        self.first = np.zeros(len(size), np.int64)
        at = held = 0
        for cell, n in enumerate(size.tolist()):
            if held and held + n > shard:
                at, held = at + 1, 0
            self.first[cell] = at
            if self.parts[cell] > 1:
                at, held = at + int(self.parts[cell]), 0
            else:
                held += n
        self.shards = at + 1
        return self

    def to_centroids(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(distances(h, c) for h, c in zip(halves(q, None), self.books))

    def walk(self, d1: np.ndarray, d2: np.ndarray, most: int) -> list[int]:
        """Non-empty cells by summed distance until they hold `most` entries."""
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        s1, s2, rows, columns = d1[o1].tolist(), d2[o2].tolist(), (o1 * self.shape[1]).tolist(), o2.tolist()
        heap, out, held, size = [(s1[0] + s2[0], 0, 0)], [], 0, self.size
        while heap and held < most:
            _, i, j = heap[0]
            if j + 1 < len(s2):
                heapq.heapreplace(heap, (s1[i] + s2[j + 1], i, j + 1))
            else:
                heapq.heappop(heap)
            if not j and i + 1 < len(s1):
                heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
            cell = rows[i] + columns[j]
            if n := size[cell]:
                out.append(cell)
                held += n
        return out

    def before(self, d1: np.ndarray, d2: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many entries a walk has met when it leaves each of the cells."""
        total = (d1[:, None] + d2).ravel()
        order = np.argsort(total, kind="stable")
        met = np.cumsum(self.size[order])
        return met[np.searchsorted(total[order], total[cell], side="right") - 1]


def trained(entries: DataFrame, n: int) -> Index:
    """Codebooks from a bounded sample of the entries, the same whatever the partitioning."""
    of_hash = F.xxhash64("embedding")
    longest = entries.select(F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0]
    longest = math.sqrt(longest)
    centroids = min(MOST_CENTROIDS, max(1, math.isqrt(n // CELL)))

    def fit(rows: list[dict]) -> bytes:
        x = np.array([r["embedding"] for r in sorted(rows, key=lambda r: (r["h"], r["embedding"]))], float)
        out = io.BytesIO()
        np.savez(out, *(fitted(h, centroids) for h in halves(x, longest)))
        return out.getvalue()

    books = np.load(io.BytesIO(fit_in_task(entries.select("embedding", of_hash.alias("h")).orderBy("h", "embedding").limit(SAMPLE), fit)))
    return Index((books["arr_0"], books["arr_1"]), longest)


def top(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n greatest, and of all that equal the last of them."""
    return np.arange(len(scores)) if len(scores) <= n else np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])


def best_of(scores: np.ndarray, ids: list, own: int | None, k: int) -> list[tuple[float, int, int]]:
    """The k greatest as (score, id, place), ties to the smaller id; ids: of each entry."""
    found = sorted((-float(scores[i]), x, i) for i in top(scores, k + 1).tolist() for x in ids[i] if x != own)
    return [(-s, x, i) for s, x, i in found[:k]]


def products(entries: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Summed in one order for every row: equal vectors have equal products."""
    return np.einsum("ij,j->i", entries, q, optimize=False)


def exact(entries: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """(query, vec_id, score, embedding): the k nearest of a few given queries among all entries; top lists leave the tasks, no pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in queries]
        for b in batches:
            x, ids = matrix(b.column(0)), b.column(1).to_pylist()
            for j, (own, q) in enumerate(queries):
                held[j] += [(-s, i, x[e].tolist()) for s, i, e in best_of(products(x, np.array(q)), ids, own, k)]
                held[j] = sorted(held[j], key=lambda r: r[:2])[:k]
        rows = [(j, i, -s, v) for j, got in enumerate(held) for s, i, v in got]
        names = ["query", "vec_id", "score", "embedding"]
        kinds = [pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=names)

    got = entries.select("embedding", "ids").mapInArrow(run, "query int, vec_id long, score double, embedding array<double>")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank).filter(F.col("rank") <= k)


def needed_share(entries: DataFrame, vectors: DataFrame, index: Index, k: int, target: float, n: int) -> float:
    """The share of all entries that walks have to meet so that they meet `target` of the true neighbours of a bounded set of vectors."""
    some = vectors.select("vec_id", F.col("embedding").cast("array<double>")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION)
    queries = [(r[0], r[1]) for r in some.collect()]
    true = exact(entries, queries, k).toArrow()  # CALIBRATION * k rows at most
    if not true.num_rows:
        return 1.0
    of, cell = true["query"].to_numpy(), index.cells(matrix(true["embedding"].combine_chunks()))
    d1, d2 = index.to_centroids(np.array([q for _, q in queries], float))
    met = np.concatenate([index.before(d1[j], d2[j], cell[of == j]) for j in range(len(queries))])
    return float(np.quantile(met / n, target, method="higher"))


def nearest(rows: DataFrame, is_query: Column, k: int = K, target: float = TARGET, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found to every row of rows (vec_id, embedding) that is_query (of vec_id) picks."""
    spark = rows.sparkSession
    kind = "f4" if isinstance(rows.schema["embedding"].dataType.elementType, FloatType) else "f8"
    vectors = stored(usable(rows))
    entries = stored(entries_of(vectors, k))
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = trained(entries, n)
    code = spark.sparkContext.broadcast(index)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([*b.columns, pa.array(code.value.cells(matrix(b.column(0))), pa.int32())], names=[*b.schema.names, "cell"])

    vector = entries.schema["embedding"].dataType.simpleString()
    entries = stored(entries.mapInArrow(to_cells, f"embedding {vector}, ids array<long>, cell int"))
    size = np.zeros(index.shape[0] * index.shape[1], np.int64)
    held = entries.groupBy("cell").count().toArrow()  # MOST_CENTROIDS ** 2 rows at most
    size[held["cell"].to_numpy()] = held["count"].to_numpy()
    # few entries: smaller shards, so that every core has some
    per_shard = min(shard, max(512, -(-n // (3 * spark.sparkContext.defaultParallelism))))
    index = index.filled(size, per_shard)
    most = max(1, math.ceil(needed_share(entries, vectors, index, k, target, n) * n))
    full = spark.sparkContext.broadcast(index)

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, cell = matrix(b.column(0), kind), b.column(2).to_numpy()
                first = np.array([i[0] for i in b.column(1).to_pylist()], np.int64)
                at = full.value.first[cell] + np.abs(first // 7) % full.value.parts[cell]
                yield pa.record_batch([pa.array(at, pa.int32()), pa.array([None] * len(x), pa.int64()), pa.array([r.tobytes() for r in x], pa.binary()), b.column(1), pa.array([np.int32(c).tobytes() for c in cell], pa.binary())], names=NAMES)

    def to_walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = full.value
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1))
            d1, d2 = index.to_centroids(x)
            for i, own in enumerate(b.column(0).to_pylist()):
                cells = np.array(index.walk(d1[i], d2[i], most), np.int64)
                more = index.parts[cells]
                cells = np.repeat(cells, more)  # a cell of several shards is asked in each
                at = index.first[cells] + np.arange(len(cells)) - np.repeat(np.cumsum(more) - more, more)
                order = np.lexsort((cells, at))
                at, cells = at[order], cells[order].astype(np.int32)
                cut = np.flatnonzero(np.diff(at, prepend=-1))
                raw = x[i].astype(kind).tobytes()
                asked = [c.tobytes() for c in np.split(cells, cut[1:])]
                m = len(cut)
                yield pa.record_batch([pa.array(at[cut], pa.int32()), pa.array([own] * m, pa.int64()), pa.array([raw] * m, pa.binary()), pa.array([None] * m, pa.list_(pa.int64())), pa.array(asked, pa.binary())], names=NAMES)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, table = None, [], None
        for b in batches:
            out = []
            for at, own, raw, ids, cells in zip(*(c.to_pylist() for c in b.columns)):
                if at != shard:
                    shard, parts, table = at, [], None
                if ids is not None:
                    parts.append((np.frombuffer(cells, np.int32)[0], raw, ids))
                    continue
                if table is None:
                    parts.sort(key=lambda p: p[0])
                    x = np.frombuffer(b"".join(p[1] for p in parts), kind).astype(float).reshape(len(parts), -1) if parts else np.zeros((0, 1))
                    table = np.array([p[0] for p in parts], np.int32), x, [p[2] for p in parts]
                    parts = []
                asked = np.frombuffer(cells, np.int32)
                lo, hi = np.searchsorted(table[0], asked), np.searchsorted(table[0], asked, side="right")
                pick = np.repeat(hi - np.cumsum(hi - lo), hi - lo) + np.arange((hi - lo).sum())
                found = best_of(products(table[1][pick], np.frombuffer(raw, kind).astype(float)), [table[2][i] for i in pick.tolist()], own, k) if len(pick) else []
                out += [(own, i, s) for s, i, _ in found]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    schema = "shard int, query_id long, vector binary, ids array<long>, cells binary"
    walks = vectors.filter(is_query).repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(to_walks, schema)
    both = entries.mapInArrow(to_shards, schema).unionByName(walks)
    tasks = min(index.shards, 100_000)
    met = both.repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard", F.col("ids").isNull()).mapInArrow(scored, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


NAMES = ["shard", "query_id", "vector", "ids", "cells"]
