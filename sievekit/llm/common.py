"""Pieces shared by the corpus operators: shared storage, whole-text batches, hashing, classes of links."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Columns of the documents table; filtering stages of the pipeline return exactly these.
DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]

#: The separators of the word rule `[^\x20\x09-\x0D]+`, as a byte table.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/sievekit-shared"
    return f"{base.rstrip('/')}/sievekit-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Texts are wide rows: Spark's default number of rows in a batch for Python is lowered unless the user has set another."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def stored(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, an executor's loss costs nothing."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def per_batch(fn: Callable[[dict[str, list]], dict[str, list]], schema: pa.Schema):
    """A mapInArrow function from one of columns as lists to columns as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
                yield pa.record_batch([pa.array(got[f.name], f.type) for f in schema], schema=schema)

    return run


def packed_texts(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """(doc_id, th, z, carried columns) of docs (doc_id, text, ...): a 64-bit hash of the text and its compressed bytes, for shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([text_hash(r) for r in raw], pa.int64()), pa.array([z.compress(r) for r in raw], pa.binary())], names=["doc_id", "th", "z"])

    def carrying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in run(iter([b])):
                yield pa.record_batch([*c.columns, *b.columns[2:]], names=["doc_id", "th", "z", *carry])

    rows = docs.select("doc_id", "text", *carry)
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema[2:])
    return rows.mapInArrow(carrying, f"doc_id long, th long, z binary{more}")


def whole_characters(rows: DataFrame) -> DataFrame:
    """rows (..., kept binary) with kept as text: UTF-8 that was cut inside a character loses that character; n_chars counts the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [(t or b"").decode("utf-8", "ignore") for t in b.column(b.schema.get_field_index("kept")).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=[*b.schema.names, "text", "n_chars"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", text string, n_chars long")


def text_hash(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def lean(fn: Callable) -> Callable:
    """fn, of batches to batches, that hands freed memory back to the system when its task ends: workers stay, and share an executor's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # of the GNU library only
            ctypes.CDLL(None).malloc_trim(0)

    return run


def fit_in_task(rows: DataFrame, fit: Callable[[list[dict]], bytes]) -> bytes:
    """Fits on a sample whose size the caller has bounded, in one task; the driver gets only the model's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in b.to_pylist()]
        yield pa.record_batch([pa.array([fit(got)], pa.binary())], names=["model"])

    got = rows.repartition(1).mapInArrow(lean(run), "model binary").collect()
    return bytes(got[0][0]) if got else fit([])  # no task runs over no rows


def sample_rows(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those with the least hash of the key: the same rows whatever the partitioning."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key)).limit(most)


class Powers:
    """B^i and B^-i modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            m = max(1 << n.bit_length(), 1 << 16)
            with np.errstate(over="ignore"):
                f = np.full(m, BASE, np.uint64)
                f[0] = 1
                g = np.full(m, BASE_INV, np.uint64)
                g[0] = 1
                self.up, self.down = np.cumprod(f, dtype=np.uint64), np.cumprod(g, dtype=np.uint64)


POWERS = Powers()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (byte + 1) * B^t for t in [i, j): prefix polynomial hashes."""
    POWERS.to(len(data) + 1)
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS.up[: len(data)], out=p[1:])
    return p


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes as an array, starts and ends of the words."""
    data = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([1], IS_SPACE[data], [1])).astype(np.int8)))
    return data, edge[::2], edge[1::2]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 text."""
    data, start, end = word_bounds(raw)
    if not len(start):
        return np.zeros(0, np.uint64)
    p = prefix_hashes(data)
    return mixed((p[end] - p[start]) * POWERS.down[start])


def components(links: DataFrame) -> DataFrame:
    """links (a, b): the least id reachable from each id, as (id, component).

    Labels move along links and through their own labels until nothing changes; every round is written to
    the shared folder. Minima are taken in the tasks first; a hub's links meet its one label in a join that Spark splits where it is skewed.
    """
    both = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    label = stored(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("component")))
    while True:
        near = both.join(label, both.v == label.id).groupBy("u").agg(F.min("component").alias("near"))
        new = label.join(near, label.id == near.u).select("id", "component", F.least("component", "near").alias("to"))
        hop = label.select(F.col("id").alias("to"), F.col("component").alias("hop"))
        new = stored(new.join(hop, "to", "left").select("id", F.least("to", "hop").alias("component"), F.col("component").alias("was")))
        if new.filter("component <> was").isEmpty():
            return new.select("id", "component")
        label = new.select("id", "component")
