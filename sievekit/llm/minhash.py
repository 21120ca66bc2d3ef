"""Near-duplicate documents by b-bit MinHash (operator 10).

A document's set holds its distinct word shingles. Documents of equal sets form a class and only its least doc_id is compared. Bands
of minima give candidates: in each bucket every member is paired with the bucket's hub, the member that shares most buckets. The low bits of the minima, packed
into longs, estimate each pair's similarity, corrected for chance equality; pairs far below the threshold go, the others are confirmed
on full sets. Then buckets that still hold several components are searched again, each member outside the least member's
component against all members of other components: by signatures, which leave the members that have a pair worth a look, then these on full sets inside
the join, so that no candidate of the bands between different components stays untested and only links come out.

Null or empty text has no shingles and is linked with nothing. Rows without doc_id are linked with nothing either: their
component_id is null and they are kept. Rows that share a doc_id count as one document: a link of one is a link of all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from sievekit.llm.common import LOWER, components, lean, mixed, packed_texts, small_batches, stored, word_hashes

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 36, 8
N = BANDS * ROWS
BITS = 2
PER_LONG = 64 // BITS
#: Pairs estimated below the threshold by more than this are dropped: six standard deviations of the estimate.
MARGIN = 0.15

_rng = np.random.default_rng(20_240_601)
MULTIPLY = _rng.integers(0, 1 << 32, N, np.uint32) | np.uint32(1)
ADD = _rng.integers(0, 1 << 32, N, np.uint32)
TURN = mixed(np.arange(1, 1 + max(BANDS, 64), dtype=np.uint64))


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of all words together where there are fewer."""
    w = word_hashes((text or "").encode().translate(LOWER))
    n = len(w)
    if not n:
        return w
    k = min(k, n)
    total = np.full(n - k + 1, np.uint64(k))
    for j in range(k):
        total = mixed(total * np.uint64(0x9FB21C651E98DF25) + w[j : n - k + 1 + j])
    return np.unique(total)


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of each permutation over a set of shingles."""
    x = (s >> np.uint64(32)).astype(np.uint32)[:, None]
    got = np.full(N, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(got, (x[i : i + 512] * MULTIPLY + ADD).min(axis=0), out=got)
    return got


def band_keys(m: np.ndarray) -> np.ndarray:
    key = TURN[:BANDS].copy()
    for r in m.reshape(BANDS, ROWS).T:
        key = mixed(key * np.uint64(0x9FB21C651E98DF25) + r)
    return key.view(np.int64)


def packed_bits(m: np.ndarray) -> np.ndarray:
    """BITS low bits of each minimum after a multiplication that spreads it."""
    low = ((m * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint64).reshape(-1, PER_LONG)
    return (low << (np.uint64(BITS) * np.arange(PER_LONG, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).view(np.int64)


def estimate(a: str, b: str) -> Column:
    """Similarity of two packed signatures: equal minima by bit counts, less those equal by chance."""
    unequal = " + ".join(f"bit_count((({x}) | shiftrightunsigned({x}, 1)) & 6148914691236517205)" for x in (f"({a}[{i}] ^ {b}[{i}])" for i in range(N // PER_LONG)))
    return F.expr(f"1 - ({unequal}) / {N * (1 - 2.0**-BITS)}D")


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.list_(pa.int64()))])


def _sign(batches):
    for b in batches:
        out = []
        for i, t in zip(*(c.to_pylist() for c in b.columns)):
            s = shingles(t)
            if i is None or not len(s):
                out.append((i, len(s), None, None, None))
            else:
                m = minima(s)
                out.append((i, len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(m), packed_bits(m)))
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), SIGNED)], schema=SIGNED)


def _sets(batches):
    z = zstandard.ZstdDecompressor()
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array([shingles(z.decompress(t).decode()).view(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["id", "s"])


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, s): the full sets of the documents in ids (id)."""
    return packed_texts(docs).join(ids, F.col("doc_id") == F.col("id")).select("id", "z").mapInArrow(lean(_sets), "id long, s array<long>")


def alike(s: str, t: str, percent: int) -> Column:
    """Whether two full sets are alike enough; sizes that rule it out are looked at first."""
    a, b = F.size(s), F.size(t)
    same = F.size(F.array_intersect(s, t))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (100 * same >= percent * (a + b - same))


def confirmed(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    sets = sets_of(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    first = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("t")), "b")
    both = first.join(sets.select(F.col("id").alias("a"), "s"), "a")
    return both.filter(alike("s", "t", percent)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = stored(docs.mapInArrow(lean(_sign), "doc_id long, n_shingles long, digest binary, bands array<long>, sig array<long>"))
    own = signed.filter("digest IS NOT NULL")
    classes = stored(own.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    member = classes.select("id", F.explode("bands").alias("bucket"))
    sig = classes.select("id", "sig")
    least = percent / 100 - MARGIN

    # the hub of a bucket is the member that shares most buckets with others: of near copies that is what they were copied from
    sizes = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(member.join(sizes, "bucket"))
    central = shared.groupBy("id").agg(F.sum("n").alias("degree"))
    ranked = shared.join(central, "id").select("bucket", "id", "degree")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("degree", -F.col("id"))).alias("hub")).select("bucket", (-F.col("hub.col2")).alias("hub"))
    pairs = shared.join(hubs, "bucket").filter("hub <> id").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
    pairs = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    likely = stored(pairs.filter(estimate("sa", "sb") >= least).select("a", "b"))
    links = confirmed(docs, likely, percent)
    # versions of a document are one: each is linked with the class of every other
    versions = own.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo < hi").select("doc_id")
    same = own.join(versions, "doc_id").join(classes.select("digest", "id"), "digest").filter("doc_id <> id")
    links = stored(links.union(same.select(F.col("id").alias("a"), F.col("doc_id").alias("b"))).distinct())
    label = components(links)

    known = shared.select("bucket", "id").join(label.select("id", "component"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    mixed_up = known.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket", "low")
    rest = stored(known.join(mixed_up, "bucket").join(classes.select("id", "bands", "sig"), "id"))
    other = F.expr("x.bucket = y.bucket AND x.component <> x.low AND x.component <> y.component AND (y.component = y.low OR x.id < y.id)")
    once = F.expr("get(array_intersect(x.bands, y.bands), 0) = x.bucket")  # a pair is looked at in its first common bucket
    worth = other & (estimate("x.sig", "y.sig") >= least) & once
    # members with a pair that is worth a look on full sets, by signatures alone: a row a member at most, and only these rows get their sets
    xs = stored(rest.alias("x").join(rest.alias("y"), worth, "left_semi"))
    ys = stored(rest.alias("y").join(xs.alias("x"), worth, "left_semi"))
    sets = stored(sets_of(docs, xs.select("id").union(ys.select("id")).distinct()))
    found = xs.join(sets, "id").alias("x").join(ys.join(sets, "id").alias("y"), worth & alike("x.s", "y.s", percent))
    more = stored(found.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
    if not more.isEmpty():
        label = components(links.union(more))

    to = classes.select("digest", "id").join(label, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    got = own.select("doc_id", "n_shingles", "digest").join(to, "digest").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    bare = signed.filter("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return got.union(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
