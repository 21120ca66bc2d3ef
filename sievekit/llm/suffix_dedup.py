"""Removal of repeated byte strings by a hash-compared suffix sort (operator 7).

Every `length`-byte window names an anchor: the place of the least k-gram hash in it. Equal windows name equal
k-grams at equal offsets, so a window can only repeat at another occurrence of its anchor's k-gram. Anchors
whose k-gram occurs once are dropped; the others are grouped by k-gram with the bytes their windows cover.
In a group the right contexts and the reversed left contexts are put in suffix order by a merge sort whose
comparisons binary-search prefix polynomial hashes for the common extension, and neighbours' bytes are compared
afterwards. Small clusters of the left order are merged into large ones while each keeps its right order; that finds,
for each anchor, the furthest left and right reach of any repeated window around it. A k-gram with more than
`hot` occurrences is not gathered: its windows' hashes are counted by Spark, with the same result.

Null text is empty; repeated rows of a document are copies of each other. Only doc_id and text are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from sievekit.llm.common import POWERS, mixed, packed_texts, prefix_hashes, small_batches, stored, text_hash

LENGTH = 400
K = 32
HOT = 10_000
BLOCK = 1 << 20
#: Low bits that hold a place in a block while the high bits of a hash are compared.
PLACE = np.uint64((1 << 21) - 1)


def anchors(raw: bytes, length: int = LENGTH, k: int = K) -> Iterator[tuple[np.ndarray, ...]]:
    """(position, first and last window start, k-gram hash) of the anchors, block by block of window starts."""
    w = length - k + 1
    for at in range(0, len(raw) - length + 1, BLOCK):
        data = np.frombuffer(raw, np.uint8, min(BLOCK, len(raw) - length + 1 - at) + length - 1, at)
        p = prefix_hashes(data)
        n = len(data) - k + 1
        h = mixed((p[k:] - p[:-k]) * POWERS.down[:n])
        # least hash of each w-window, first place on ties: running minima from both sides of blocks of w
        ranked = (h & ~PLACE) | np.arange(n, dtype=np.uint64)
        grid = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
        grid[:n] = ranked
        grid = grid.reshape(-1, w)
        fore = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(back[: n - w + 1], fore[w - 1 : n]) & PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], len(place)) - 1
        yield place[first] + at, first + at, last + at, h[place[first]].view(np.int64)


class Contexts:
    """Byte strings side by side, each with its prefix hashes; strings are named by number."""

    def __init__(self, parts: list[bytes]) -> None:
        self.parts = parts
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.data = np.frombuffer(b"".join(parts) + b"\0", np.uint8)
        POWERS.to(int(size.max(initial=0)))
        self.p = np.zeros(len(self.data), np.uint64)
        power = POWERS.up[np.arange(len(self.data) - 1) - np.repeat(self.start, size)]
        np.cumsum((self.data[:-1].astype(np.uint64) + np.uint64(1)) * power, out=self.p[1:])

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of strings x and y, by binary search over prefix hashes."""
        sx, sy = self.start[x], self.start[y]
        hi = np.minimum(self.end[x] - sx, self.end[y] - sy)
        lo = np.zeros_like(hi)
        px, py = self.p[sx], self.p[sy]
        for _ in range(int(hi.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self.p[sx + mid] - px == self.p[sy + mid] - py
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(x, y)
        ax, ay = self.start[x] + n, self.start[y] + n
        cx = np.where(ax < self.end[x], self.data[np.minimum(ax, len(self.data) - 1)].astype(np.int16), -1)
        cy = np.where(ay < self.end[y], self.data[np.minimum(ay, len(self.data) - 1)].astype(np.int16), -1)
        return (cx < cy) | (or_equal & (cx == cy))

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the strings in each run of equal group numbers, and the common extension with the one before.

        Bottom-up merge sort of all groups at once: an element's place in a merged run is its own plus its rank
        in the other run, found by binary search with hash comparisons.
        """
        n = len(group)
        at = np.arange(n)
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.append(first, n))
        base, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
        order, width = np.arange(n), 1
        while width < sizes.max(initial=0):
            live = np.flatnonzero(size > width)
            b, local = base[live], at[live] - base[live]
            run = local // width
            left = run % 2 == 0
            from_ = np.minimum((run ^ 1) * width, size[live])
            to = np.minimum(from_ + width, size[live])
            lo, hi, mine = from_.copy(), to.copy(), order[live]
            for _ in range(width.bit_length()):
                open_ = np.flatnonzero(lo < hi)
                mid = (lo[open_] + hi[open_]) >> 1
                before = self.less(order[b[open_] + mid], mine[open_], ~left[open_])
                lo[open_], hi[open_] = np.where(before, mid + 1, lo[open_]), np.where(before, hi[open_], mid)
            new = order.copy()
            new[b + (run & ~1) * width + local % width + lo - from_] = mine
            order, width = new, 2 * width
        lcp = np.zeros(n, np.int64)
        inside = np.flatnonzero(at > base)
        lcp[inside] = self.common(order[inside - 1], order[inside])
        return self.verified(order, lcp, first, sizes, inside)

    def verified(self, order, lcp, first, sizes, inside) -> tuple[np.ndarray, np.ndarray]:
        """Compares the bytes of neighbours; a group in which a hash collision shows is sorted by its bytes."""
        for i in inside.tolist():
            a, b, n = self.parts[order[i - 1]], self.parts[order[i]], int(lcp[i])
            if a > b or a[:n] != b[:n] or (n < len(a) and n < len(b) and a[n] == b[n]):
                g = int(np.searchsorted(first, i, "right")) - 1
                span = slice(first[g], first[g] + sizes[g])
                order[span] = sorted(order[span].tolist(), key=self.parts.__getitem__)
                for j in range(span.start + 1, span.stop):
                    x, y = self.parts[order[j - 1]], self.parts[order[j]]
                    n = next((t for t, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
                    lcp[j] = n
        return order, lcp


def reach(left_order: list[int], left_lcp: list[int], rank: list[int], right_lcp: list[int], length: int) -> dict[int, tuple[int, int]]:
    """Furthest (left, right) of the windows of one group that repeat, for its members.

    left_order and left_lcp: members by reversed left context. rank: a member's place by right context;
    right_lcp[i]: common extension of places i - 1 and i. Clusters that agree on ever less of their left are merged, small into
    large; of a merged cluster only neighbours in the right order can give a new furthest reach.
    """
    m = len(left_order)
    table = [right_lcp]
    while 2 << (len(table) - 1) <= m:
        step, t = 1 << (len(table) - 1), table[-1]
        table.append([min(t[i], t[i + step]) if i + step < len(t) else t[i] for i in range(len(t))])

    def right(i: int, j: int) -> int:
        k = (j - i).bit_length() - 1
        return min(table[k][i + 1], table[k][j - (1 << k) + 1])

    member = [0] * m
    for x in left_order:
        member[rank[x]] = x
    cluster, best = list(range(m)), {}
    places = [[rank[x]] for x in left_order]

    def find(i: int) -> int:
        while cluster[i] != i:
            cluster[i] = cluster[cluster[i]]
            i = cluster[i]
        return i

    def meet(i: int, j: int, level: int) -> None:
        r = right(i, j)
        if level + r >= length:
            for x in (member[i], member[j]):
                a, b = best.get(x, (0, 0))
                best[x] = (max(a, level), max(b, r))

    for i in sorted(range(1, m), key=lambda i: -left_lcp[i]):
        level, a, b = left_lcp[i], find(i - 1), find(i)
        if len(places[a]) < len(places[b]):
            a, b = b, a
        big, small = places[a], places[b]
        for x in small:
            j = bisect_left(big, x)
            if j:
                meet(big[j - 1], x, level)
            if j < len(big):
                meet(x, big[j], level)
        if len(small) < 8:
            for x in small:
                big.insert(bisect_left(big, x), x)
        else:
            big += small
            big.sort()
        cluster[b], places[b] = a, []
    return best


def repeated_in_groups(rows: list[tuple[int, bytes, bytes]], length: int = LENGTH) -> list[tuple[int, int]]:
    """rows (k-gram, left context, right context from the anchor on), sorted by k-gram: each row's reach."""
    classes: dict[tuple[int, bytes, bytes], int] = {}
    count: list[int] = []
    of = []
    for row in rows:
        c = classes.setdefault(row, len(classes))
        if c == len(count):
            count.append(0)
        count[c] += 1
        of.append(c)
    keys = list(classes)
    got = [(len(x), len(r)) if n > 1 and len(x) + len(r) >= length else (0, 0) for (_, x, r), n in zip(keys, count)]
    group = np.fromiter((k[0] for k in keys), np.int64, len(keys))
    if len(keys) > 1:
        fore, back = Contexts([k[2] for k in keys]), Contexts([k[1][::-1] for k in keys])
        r_order, r_lcp = fore.sort(group)
        l_order, l_lcp = back.sort(group)
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.append(first, len(group)))
        place = np.empty(len(group), np.int64)
        place[r_order] = np.arange(len(group))
        for a, n in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            s = slice(a, a + n)
            if int(l_lcp[s].max()) + int(r_lcp[s].max()) < length:
                continue
            best = reach((l_order[s] - a).tolist(), l_lcp[s].tolist(), (place[s] - a).tolist(), r_lcp[s].tolist(), length)
            for x, (i, j) in best.items():
                got[a + x] = (max(got[a + x][0], i), max(got[a + x][1], j))
    return [got[c] for c in of]


def suffix_dedup(docs: DataFrame, carry: list[str] = (), length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, carried columns) for every row of docs (doc_id, text, ...)."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    whole_rows, docs = docs, docs.select("doc_id", "text")

    def find(batches):
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = (t or "").encode()
                th = text_hash(raw)
                for pos, lo, hi, h in anchors(raw, length, k):
                    yield pa.record_batch([pa.array([i] * len(pos), pa.int64()), pa.array(np.full(len(pos), th)), pa.array(pos), pa.array((pos - lo).astype(np.int16)), pa.array((hi - pos + length).astype(np.int16)), pa.array(h)], names=["doc_id", "th", "pos", "lt", "rt", "h"])

    def gathered(batches):
        """Fewer, larger record batches."""
        some, n = [], 0
        for b in batches:
            some.append(b)
            n += b.num_rows
            if n > 20_000:
                yield from pa.Table.from_batches(some).combine_chunks().to_batches()
                some, n = [], 0
        if some:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()

    found = stored(docs.mapInArrow(lambda it: gathered(find(it)), "doc_id long, th long, pos long, lt short, rt short, h long"))
    often = found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    texts = packed_texts(docs)

    def parts(which: str) -> DataFrame:
        """Left and right contexts of the anchors whose k-gram's count meets the condition."""
        # rows of one doc_id and text are copies: their anchors are listed together, so each text is cut once
        at = found.join(often.filter(which), "h").groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "lt", "rt", "h")).alias("at")).withColumnsRenamed({"doc_id": "pid", "th": "pth"})
        whole = texts.join(at, texts.doc_id.eqNullSafe(at.pid) & (texts.th == at.pth))
        return whole.select("doc_id", "th", "z", "at").mapInArrow(cut, "doc_id long, th long, pos long, h long, lc binary, rc binary")

    def cut(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out, size = [], 0
            for i, th, zt, at in zip(*(c.to_pylist() for c in b.columns)):
                raw = z.decompress(zt)
                for a in at:
                    p = a["pos"]
                    left, right = raw[p - a["lt"] : p], raw[p : p + a["rt"]]
                    out.append((i, th, p, a["h"], left, right))
                    size += len(left) + len(right)
                if size > 8_000_000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), CUT)], names=CUT_NAMES)
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), CUT)], names=CUT_NAMES)

    def judge(batches):
        def flush(rows):
            got = repeated_in_groups([(r["h"], r["lc"], r["rc"]) for r in rows], length)
            keep = [(r["doc_id"], r["th"], r["pos"] - i, r["pos"] + j) for r, (i, j) in zip(rows, got) if i + j]
            return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*keep) if keep else [[]] * 4)], names=["doc_id", "th", "lo", "hi"])

        rows: list[dict] = []
        size = 0
        for b in batches:
            for r in b.to_pylist():
                if size > 3_000_000 and r["h"] != rows[-1]["h"]:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r["lc"]) + len(r["rc"])
        if rows:
            yield flush(rows)

    schema = "doc_id long, th long, lo long, hi long"
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cold = parts(f"n <= {hot}").repartition(n_parts, "h").sortWithinPartitions("h").mapInArrow(judge, schema)

    def windows(batches):
        for b in batches:
            for r in b.to_pylist():
                raw, p = r["lc"] + r["rc"], len(r["lc"])
                d = [xxhash.xxh3_128_digest(raw[s : s + length]) for s in range(len(raw) - length + 1)]
                n = len(d)
                at = np.arange(n) + r["pos"] - p
                yield pa.record_batch([pa.array([r["doc_id"]] * n, pa.int64()), pa.array([r["th"]] * n, pa.int64()), pa.array(at), pa.array(d, pa.binary())], names=["doc_id", "th", "lo", "d"])

    many = parts(f"n > {hot}").mapInArrow(lambda it: gathered(windows(it)), "doc_id long, th long, lo long, d binary")
    twice = many.groupBy("d").agg(F.count("*").alias("n")).filter("n > 1").select("d")
    warm = many.join(twice, "d").select("doc_id", "th", "lo", (F.col("lo") + length).alias("hi"))
    # map-side: windows of a document that overlap become one span only later, per document
    spans = cold.union(warm).groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")).withColumnRenamed("doc_id", "sid").withColumnRenamed("th", "sth")

    def clean(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for i, zt, spans in zip(*(c.to_pylist() for c in b.columns[:3])):
                raw = z.decompress(zt)
                kept, at, n, removed = [], 0, 0, 0
                merged: list[list[int]] = []
                for s in sorted((s["lo"], s["hi"]) for s in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                for lo, hi in merged:
                    kept.append(raw[at:lo])
                    at, n, removed = hi, n + 1, removed + hi - lo
                rest = b"".join([*kept, raw[at:]])
                out.append((i, len(raw), removed, n, rest))
            done = [pa.array(c, t) for c, t in zip(zip(*out), CLEAN)]
            yield pa.record_batch([*done, *b.columns[3:]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *carry])

    rows = packed_texts(whole_rows, carry) if carry else texts
    both = rows.join(spans, rows.doc_id.eqNullSafe(spans.sid) & (rows.th == spans.sth), "left").select(rows.doc_id, "z", "spans", *carry)
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in both.schema[3:])
    return both.mapInArrow(clean, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary{more}")


CUT = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
CUT_NAMES = ["doc_id", "th", "pos", "h", "lc", "rc"]
CLEAN = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
