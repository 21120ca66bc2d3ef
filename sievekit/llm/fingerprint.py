"""Document fingerprints: invertible Bloom lookup sketches of paragraphs (operator 9). DataFrame and SQL functions only.

A line is cut into paragraphs after each word that ends in a stop or whose hash is a multiple of CUT, whatever the line's length; cuts depend on the words
alone, so an edit changes the paragraphs that it touches. A paragraph's digest hashes its words; a text without blanks is one paragraph a line.
A fingerprint has CELLS cells in three blocks; each distinct digest lies in one cell of each block, and a cell holds count, XOR of digests and XOR of
their check hashes. Two fingerprints are subtracted cell by cell and peeled: a cell that holds one digest gives it away, which
frees others, until nothing is left and all digests in which the versions differ are known. Where peeling gets stuck, a larger table is filled with
both versions' digests, entered with the version's sign: cells empty or of one digest are settled, and the digests of all others go to the next table, under another
hash. Every round settles more than half of them; what is left after RETRIES rounds (never, for practical purposes) is compared directly, so that the likeness is exact in any case.

likeness = shared / all distinct paragraphs (1 where both texts have none). The next document is found without a global sort: documents go
to ranges of doc_id, and the first of each range is also sent to the end of the range before it.

Null text is empty; rows with null doc_id come first; rows that share a doc_id follow each other by text. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

WIDTH = 16  # cells of a block of a fingerprint; a power of two
CELLS = 3 * WIDTH
ROUNDS = 12
CUT = 16
CELLS_EACH = 2  # cells of a retry's table for each digest in it
RETRIES = 40
RANGE = 2000
MOST_RANGES = 100_000

ZERO = "named_struct('n', 0, 'k', 0L, 'h', 0L)"


def check(key: str) -> str:
    return f"xxhash64({key}, 77)"


def let(value: str, name: str, body: str) -> str:
    """body with name standing for value, which is worked out once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def cell_of(key: str, block: int, width: int) -> str:
    return f"(shiftrightunsigned({key}, {block * (width.bit_length() - 1)}) & {width - 1}L)"


def digests(text: str) -> str:
    """Distinct digests of a text's paragraphs."""
    ends = f"filter(sequence(1, size(w)), i -> i = size(w) OR right(get(w, i - 1), 1) IN ('.', '!', '?') OR pmod(xxhash64(get(w, i - 1)), {CUT}) = 0)"
    parts = let(ends, "e", "transform(e, (x, k) -> xxhash64(slice(w, if(k = 0, 0, get(e, k - 1)) + 1, x - if(k = 0, 0, get(e, k - 1)))))")
    lines = f"filter(transform(split({text}, '\\\\n'), l -> filter(split(l, '\\\\s+'), x -> x <> '')), w -> size(w) > 0)"
    return f"array_distinct(flatten(transform({lines}, w -> {parts})))"


def sketch(keys: str) -> str:
    """Cells of the named array of digests, block after block.

    A block's digests are turned until the bits that name the cell lead and sorted among the least value of each cell, so a cell is what lies between two of these.
    """
    bits = WIDTH.bit_length() - 1
    top = 64 - bits

    def block(j: int) -> str:
        low = (j + 1) * bits
        turned = f"transform({keys}, x -> shiftleft(x, {64 - low}) | shiftrightunsigned(x, {low}))"
        back = lambda x: f"(shiftrightunsigned({x}, {64 - low}) | shiftleft({x}, {low}))"
        least = f"transform(sequence(0L, {WIDTH - 1}L), c -> shiftleft(c, {top}))"
        at = lambda c: f"cast(array_position(o, shiftleft({c}, {top})) AS int)"
        inside = let(at("c"), "p", f"slice(o, p + 1, if(c = {WIDTH // 2 - 1}, size(o) + 1, {at('c + 1L')}) - p - 1)")  # negative numbers come first
        add = f"(a, x) -> named_struct('n', a.n + 1, 'k', a.k ^ x, 'h', a.h ^ {check(back('x'))})"
        cell = f"aggregate({inside}, {ZERO}, {add}, a -> named_struct('n', a.n, 'k', {back('a.k')}, 'h', a.h))"
        return let(f"sort_array(concat({turned}, {least}))", "o", f"transform(sequence(0L, {WIDTH - 1}L), c -> {cell})")

    return f"concat({', '.join(map(block, range(3)))})"


def subtracted(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"


def peeled(cells: str) -> str:
    """The digests in a subtracted sketch; NULL where peeling gets stuck."""
    pure = f"array_distinct(transform(filter(s.c, x -> (x.n = 1 OR x.n = -1) AND x.h = {check('x.k')}), x -> named_struct('k', x.k, 'n', x.n)))"
    take = f"(a, y) -> named_struct('n', a.n - y.n, 'k', a.k ^ y.k, 'h', a.h ^ {check('y.k')})"
    block = lambda j: f"transform(slice(s.c, {j * WIDTH + 1}, {WIDTH}), (x, i) -> aggregate(filter(p, y -> {cell_of('y.k', j, WIDTH)} = i), x, {take}))"
    step = let(pure, "p", f"if(size(p) = 0, named_struct('c', s.c, 'f', s.f, 'end', true), named_struct('c', concat({', '.join(map(block, range(3)))}), 'f', concat(s.f, transform(p, y -> y.k)), 'end', false))")
    left = "exists(s.c, x -> x.n <> 0 OR x.k <> 0L OR x.h <> 0L)"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('c', {cells}, 'f', cast(array() AS array<bigint>), 'end', false), (s, r) -> if(s.end, s, {step}), s -> if({left}, NULL, s.f))"


def by_tables(a: str, b: str) -> str:
    """Number of digests in one of two sets only: tables of at least CELLS_EACH cells for each digest still unknown, both versions entered with their signs.

    A cell that is empty after subtraction held shared digests, one that holds a single digest gives it away; the digests of all other cells go on to
    the next round's table, under its own hash.
    """
    side = lambda x, n: f"transform({x}, k -> named_struct('k', k, 'n', {n}))"
    cell = lambda i: f"shiftrightunsigned(get(o, {i}).k, 64 - w)"
    placed = "sort_array(transform(s.left, x -> named_struct('k', xxhash64(x.k, r), 'n', x.n)))"
    starts = f"filter(sequence(0, size(o) - 1), i -> i = 0 OR {cell('i')} <> {cell('i - 1')})"
    add = f"(a, x) -> named_struct('n', a.n + x.n, 'k', a.k ^ x.k, 'h', a.h ^ {check('x.k')})"
    kind = f"if(c = {ZERO}, 0, if((c.n = 1 OR c.n = -1) AND c.h = {check('c.k')}, 1, 2))"
    judged = f"named_struct('z', {let(f'aggregate(v, {ZERO}, {add})', 'c', kind)}, 'v', v)"
    cells = f"transform(b, (x, i) -> {let('slice(o, x + 1, coalesce(get(b, i + 1), size(o)) - x)', 'v', judged)})"
    table = let(f"cast(ceil(log2({CELLS_EACH} * size(s.left))) AS int)", "w", let(placed, "o", let(starts, "b", cells)))
    step = let(table, "t", "named_struct('left', flatten(transform(filter(t, y -> y.z = 2), y -> y.v)), 'found', s.found + size(filter(t, y -> y.z = 1)))")
    keys = lambda n: f"transform(filter(s.left, x -> x.n = {n}), x -> x.k)"
    rest = f"s.found + size(array_except({keys(1)}, {keys(-1)})) + size(array_except({keys(-1)}, {keys(1)}))"
    start = f"named_struct('left', concat({side(a, 1)}, {side(b, -1)}), 'found', 0)"
    return f"aggregate(sequence(1, {RETRIES}), {start}, (s, r) -> if(size(s.left) = 0, s, {step}), s -> if(size(s.left) = 0, s.found, {rest}))"


def difference(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """Number of digests in one of two sets only: from the fingerprints, and by larger tables where these don't hold enough."""
    return f"coalesce(array_size({peeled(subtracted(cells_a, cells_b))}), {by_tables(a, b)})"


def likeness(a: str, b: str, n: str) -> str:
    both = f"(size({a}) + size({b}) - {n}) / 2"
    return f"if(size({a}) + size({b}) = 0, 1D, cast({both} / (size({a}) + size({b}) - {both}) AS double))"


def written(keys: str, cells: str) -> str:
    """A fingerprint as text: the number of paragraphs and the cells."""
    return f"concat(size({keys}), '|', array_join(transform({cells}, x -> if(x.n = 0, '', concat(x.n, ':', hex(x.k), ':', hex(x.h)))), ','))"


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with digests and cells, and the next document's text, digests and cells."""
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE)))
    width = max(1, -(-((high or 0) - (low or 0) + 1) // ranges))
    low_bucket = ((low or 0) // width) - 1
    bucket = F.coalesce(F.expr(f"(doc_id - pmod(doc_id, {width}L)) div {width}L"), F.lit(low_bucket)).cast("long")
    docs = docs.withColumn("bucket", bucket)
    # at most MOST_RANGES + 2 rows: the first doc_id of each range, and the range before it (of the first: the last)
    firsts = docs.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("first"))
    by = Window.orderBy("bucket")
    firsts = firsts.select("bucket", F.col("first.doc_id").alias("first_id"), F.lag("bucket").over(by).alias("before"), F.max("bucket").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
    firsts = firsts.select(F.coalesce("before", "last").alias("to"), F.col("bucket").alias("b"), "first_id")
    heads = docs.join(F.broadcast(firsts), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    heads = heads.groupBy("to").agg(F.min("text").alias("text"))
    rows = docs.select("bucket", F.lit(0).alias("extra"), "doc_id", "text").union(heads.select("to", F.lit(1), F.lit(None).cast("long"), "text"))
    # only texts are exchanged; their sketches are made once, where the window finds them
    rows = rows.repartition("bucket").withColumn("keys", F.expr(digests("text"))).withColumn("cells", F.expr(sketch("keys")))
    order = Window.partitionBy("bucket").orderBy("extra", "doc_id", "text")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", "keys", "cells")})
    return rows.filter("extra = 0").drop("extra", "bucket")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 AS int)), substring(next_text, 1, cast(n_chars div 2 AS int)))"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "keys", "cells", "next_keys", "next_cells", F.expr(digests("edited")).alias("edited_keys"))
    rows = rows.withColumn("edited_cells", F.expr(sketch("edited_keys")))
    rows = rows.withColumns({"d_edited": F.expr(difference("keys", "edited_keys", "cells", "edited_cells")), "d_next": F.expr(difference("keys", "next_keys", "cells", "next_cells"))})
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.expr(written("keys", "cells")).alias("fingerprint"), F.expr(written("edited_keys", "edited_cells")).alias("edited_fingerprint"),
        F.expr(likeness("keys", "edited_keys", "d_edited")).alias("near_edited"), F.expr(likeness("keys", "next_keys", "d_next")).alias("near_next"),
    )
