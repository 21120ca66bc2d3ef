"""Render base tables to text documents (round-trip fixtures).

The driver's tables hold no embedded JSON / key-value / table fragments, so
correctness is checked by rendering rows to text with ordered Spark
expressions, extracting them back and comparing with the base table.  Every
renderer is a pure projection or an ordered ``groupBy`` aggregate; its size
grows with the table it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a table's files for one task of heavy work, and the most tasks.
SPREAD_BYTES, SPREAD_MOST = 4 << 20, 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tasks(spark: SparkSession, t: DataFrame) -> int:
    """Three rounds of tasks at least, and one task for every few MB of files."""
    size = int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return min(max(least, -(-size // SPREAD_BYTES)), SPREAD_MOST)


def rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is heavy on each row: dealt out to many tasks, however few files or row groups hold it, before rows become texts."""
    t = table(spark, sf_dir, name)
    return t.repartition(_tasks(spark, t))


def _num(c) -> F.Column:
    return F.col(c).cast("string")


def kv_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-KV: one document per customer, a heading line then ``Key: value`` lines."""
    c = rows(spark, sf_dir, "customer")
    text = F.concat(
        F.lit("Customer record\n"),
        F.lit("Customer Key: "), _num("c_custkey"), F.lit("\n"),
        F.lit("Name: "), F.col("c_name"), F.lit("\n"),
        F.lit("\n"),
        F.lit("Acct-Bal: "), _num("c_acctbal"), F.lit("\n"),
        F.lit("Segment: "), F.col("c_mktsegment"), F.lit("\n"),
        F.lit("Nation Key: "), _num("c_nationkey"), F.lit("\n"),
        F.lit("That is all for this customer.\n"),
    )
    return c.select(F.col("c_custkey").alias("doc_id"), F.lit("customers").alias("source_id"), text.alias("text"))


def kv_mixed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KV + JSON + prose per customer, with the KV line that touches ``{`` (E5).

    Layout: block A (2 lines), prose, block B (2 lines; its second line ends
    right where a JSON object starts on the next line when c_custkey is even,
    so that line is excluded), then JSON, then block C (1 line).
    """
    c = rows(spark, sf_dir, "customer")
    touch = (F.col("c_custkey") % 2) == 0
    text = F.concat(
        F.lit("name: "), F.col("c_name"), F.lit("\nsegment: "), F.col("c_mktsegment"), F.lit("\n"),
        F.lit("Some prose between blocks.\n"),
        F.lit("balance: "), _num("c_acctbal"), F.lit("\nnation: "), _num("c_nationkey"), F.lit("\n"),
        F.when(touch, F.lit("")).otherwise(F.lit("\nMore prose.\n")),
        F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))), F.lit("\n"),
        F.lit("Closing prose.\ncustkey: "), _num("c_custkey"), F.lit("\n"),
    )
    return c.select(F.col("c_custkey").alias("doc_id"), F.lit("customers").alias("source_id"), text.alias("text"))


def kv_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same key twice per order; after cleaning ``Order-Ref`` and ``order ref`` collide."""
    o = rows(spark, sf_dir, "orders")
    text = F.concat(
        F.lit("ref: "), _num("o_orderkey"), F.lit("\n"),
        F.lit("status: "), F.col("o_orderstatus"), F.lit("\n"),
        F.lit("ref: "), _num("o_custkey"), F.lit("\n"),
        F.lit("Order-Ref: "), F.col("o_orderpriority"), F.lit("\n"),
        F.lit("order ref: "), _num("o_totalprice"), F.lit("\n"),
    )
    return o.select(F.col("o_orderkey").alias("doc_id"), F.lit("orders").alias("source_id"), text.alias("text"))


def json_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-JSON: prose, blank line, one JSON object per order, blank line, prose."""
    o = rows(spark, sf_dir, "orders")
    obj = F.to_json(F.struct(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority",
        F.col("o_totalprice").cast("string").alias("price_text"),
    ))
    text = F.concat(F.lit("Order note for customer "), _num("o_custkey"), F.lit(".\n\n"), obj,
                    F.lit("\n\nEnd of note.\n"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.lit("orders").alias("source_id"), text.alias("text"))


def json_damaged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-JSON-BAD: by ``o_orderkey % 4``: 0 clean, 1 trailing comma, 2 single quotes, 3 unrepairable."""
    o = rows(spark, sf_dir, "orders")
    k, st = _num("o_orderkey"), F.col("o_orderstatus")
    variant = F.col("o_orderkey") % 4
    obj = (
        F.when(variant == 0, F.concat(F.lit('{"key": '), k, F.lit(', "status": "'), st, F.lit('"}')))
        .when(variant == 1, F.concat(F.lit('{"key": '), k, F.lit(', "status": "'), st, F.lit('",}')))
        .when(variant == 2, F.concat(F.lit("{'key': "), k, F.lit(", 'status': '"), st, F.lit("'}")))
        .otherwise(F.concat(F.lit('{"key": '), k, F.lit(', "status" '), st, F.lit("}")))
    )
    text = F.concat(F.lit("Damaged export line.\n"), obj, F.lit("\nTrailer.\n"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.lit("orders").alias("source_id"), text.alias("text"))


def csv_customers_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-CSV: one CSV block per nation of its customers (header + rows ordered by key).

    Delimiter is ',' for even nation keys and TAB for odd ones.
    """
    c = table(spark, sf_dir, "customer")
    delim = F.when(F.col("c_nationkey") % 2 == 0, F.lit(",")).otherwise(F.lit("\t"))
    row = F.concat_ws("|", _num("c_custkey"), F.col("c_name"), F.col("c_mktsegment"), _num("c_acctbal"))
    per_row = c.select("c_nationkey", "c_custkey", F.regexp_replace(row, r"\|", "%s").alias("r"))
    grouped = per_row.groupBy("c_nationkey").agg(
        F.expr("listagg(r, '\\n') within group (order by c_custkey)").alias("body"))
    header = F.lit("custkey%sname%ssegment%sacctbal")
    d = delim
    text = F.concat(
        F.lit("Customers of nation "), _num("c_nationkey"), F.lit(" follow.\n\n"),
        F.regexp_replace(header, "%s", d), F.lit("\n"),
        F.regexp_replace(F.col("body"), "%s", d), F.lit("\n\nEnd of list.\n"),
    )
    return grouped.select(F.col("c_nationkey").cast("long").alias("doc_id"), F.lit("nations").alias("source_id"),
                          text.alias("text"))


def html_nations_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-HTML: one ``<table>`` per region listing its nations."""
    n = table(spark, sf_dir, "nation")
    cells = F.concat(F.lit("<tr><td>"), _num("n_nationkey"), F.lit("</td><td> "), F.col("n_name"),
                     F.lit(" </td><td>"), _num("n_regionkey"), F.lit("</td></tr>"))
    grouped = n.select("n_regionkey", "n_nationkey", cells.alias("tr")).groupBy("n_regionkey").agg(
        F.expr("listagg(tr, '\\n') within group (order by n_nationkey)").alias("body"))
    text = F.concat(
        F.lit("<p>Nations of region "), _num("n_regionkey"), F.lit("</p>\n<table class=\"t\">\n<thead><tr><th>Nation Key</th>"
              "<th>Nation-Name</th><th>Region Key</th></tr></thead>\n<tbody>\n"),
        F.col("body"), F.lit("\n</tbody>\n</table>\n<p>end</p>\n"),
    )
    return grouped.select(F.col("n_regionkey").cast("long").alias("doc_id"), F.lit("regions").alias("source_id"),
                          text.alias("text"))


def yaml_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-YAML: front matter with part fields, then prose."""
    p = rows(spark, sf_dir, "part")
    text = F.concat(
        F.lit("---\n"),
        F.lit("partkey: "), _num("p_partkey"), F.lit("\n"),
        F.lit("brand: \""), F.col("p_brand"), F.lit("\"\n"),
        F.lit("size: "), _num("p_size"), F.lit("\n"),
        F.lit("retailprice: "), _num("p_retailprice"), F.lit("\n"),
        F.lit("---\n"),
        F.lit("Part description follows.\n"),
    )
    return p.select(F.col("p_partkey").alias("doc_id"), F.lit("parts").alias("source_id"), text.alias("text"))


def yaml_inline_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline YAML: heading line, then space-free ``key: value`` lines."""
    p = rows(spark, sf_dir, "part")
    text = F.concat(
        F.lit("# Part sheet\n"),
        F.lit("part_key: "), _num("p_partkey"), F.lit("\n"),
        F.lit("part_size: "), _num("p_size"), F.lit("\n"),
        F.lit("part_type: \""), F.col("p_type"), F.lit("\"\n"),
        F.lit("Thanks.\n"),
    )
    return p.select(F.col("p_partkey").alias("doc_id"), F.lit("parts").alias("source_id"), text.alias("text"))


def code_block_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fenced block per region (and an unclosed one for odd keys)."""
    r = table(spark, sf_dir, "region")
    text = F.concat(
        F.lit("Intro\n```sql\nselect "), _num("r_regionkey"), F.lit(";\n```\nmiddle\n"),
        F.when(F.col("r_regionkey") % 2 == 1, F.concat(F.lit("```\n"), F.col("r_name"), F.lit("\n"))).otherwise(F.lit("")),
    )
    return r.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lit("regions").alias("source_id"),
                    text.alias("text"))


def mixed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-MIX: key-value block, JSON object and prose per customer.

    Every third customer also gets a 3-row CSV block, every fifth an HTML
    table of one row.  The CSV block comes before the JSON line: the CSV scan
    treats everything after a line starting with ``{`` as JSON (rule E9).
    """
    c = rows(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    csv = F.when(k % 3 == 0, F.concat(F.lit("a,b\n1,2\n3,4\n\n"))).otherwise(F.lit(""))
    html = F.when(k % 5 == 0, F.concat(F.lit("<table><tr><td>"), _num("c_custkey"), F.lit("</td></tr></table>\n")))\
        .otherwise(F.lit(""))
    text = F.concat(
        F.lit("Profile\nname: "), F.col("c_name"), F.lit("\nsegment: "), F.col("c_mktsegment"), F.lit("\n"),
        F.lit("Prose line.\n"), csv,
        F.to_json(F.struct(k.alias("id"), F.col("c_acctbal").alias("bal"))), F.lit("\n"),
        F.lit("Prose again.\n"), html,
    )
    return c.select(k.alias("doc_id"), F.lit("customers").alias("source_id"), text.alias("text"))


def pages_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-PAGES: turns joined by form-feed, with NBSP and hyphen-newline injected."""
    cv = table(spark, sf_dir, "conversations")
    turn_text = F.concat(F.col("role"), F.lit(": "), F.col("text"),
                         F.when(F.col("turn") % 2 == 0, F.lit(" hyphen-\nated")).otherwise(F.lit("")),
                         F.when(F.col("turn") % 3 == 0, F.lit("\r\n\n\n\nsoft\u00adhy")).otherwise(F.lit("")))
    grouped = cv.select("conv_id", "turn", turn_text.alias("t")).groupBy("conv_id").agg(
        F.expr("listagg(t, chr(12)) within group (order by turn)").alias("text"))
    return grouped.select(F.col("conv_id").alias("doc_id"), F.lit("conversations").alias("source_id"), "text")


def typed_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-TYPES: one key-value document per line item; ``qty`` changes its text form.

    By (l_orderkey + l_linenumber) % 5: 0 integer text, 1 decimal text, 2 'n/a'
    (null), 3 a word (string), 4 'true' (boolean).  Source = l_returnflag.
    """
    li = rows(spark, sf_dir, "lineitem")
    form = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    qty = (F.when(form == 0, F.col("l_quantity").cast("bigint").cast("string"))
           .when(form == 1, (F.col("l_quantity") + F.lit(0.5)).cast("string"))
           .when(form == 2, F.lit("n/a")).when(form == 3, F.lit("several")).otherwise(F.lit("true")))
    text = F.concat(F.lit("Line item\nqty: "), qty, F.lit("\nflag: "), F.col("l_linestatus"), F.lit("\n"))
    doc_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return li.select(doc_id.alias("doc_id"), F.col("l_returnflag").alias("source_id"), text.alias("text"))


def optional_field_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON per order with an optional field (absent when key % 3 = 0) and a
    nullable one (explicit null when key % 4 = 0).  Source = o_orderstatus."""
    o = rows(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit('{"id": '), _num("o_orderkey"), F.lit(', "price": '), _num("o_totalprice"),
        F.lit(', "prio": "'), F.col("o_orderpriority"), F.lit('"'),
        F.when(k % 3 != 0, F.concat(F.lit(', "opt": '), _num("o_custkey"))).otherwise(F.lit("")),
        F.lit(', "maybe": '), F.when(k % 4 == 0, F.lit("null")).otherwise(F.concat(F.lit('"v'), _num("o_orderkey"), F.lit('"'))),
        F.lit("}"),
    )
    return o.select(k.alias("doc_id"), F.col("o_orderstatus").alias("source_id"), text.alias("text"))


def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON per order with a nested object, a list of line objects and a list of tags."""
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    line = F.concat(F.lit('{"n": '), _num("l_linenumber"), F.lit(', "qty": '), _num("l_quantity"), F.lit("}"))
    lines = li.select("l_orderkey", "l_linenumber", line.alias("j")).groupBy("l_orderkey").agg(
        F.expr("listagg(j, ', ') within group (order by l_linenumber)").alias("lines"))
    j = o.join(lines, o.o_orderkey == lines.l_orderkey, "left").repartition(_tasks(spark, li))
    text = F.concat(
        F.lit('Export:\n{"order": {"key": '), _num("o_orderkey"), F.lit(', "status": "'), F.col("o_orderstatus"),
        F.lit('"}, "lines": ['), F.coalesce(F.col("lines"), F.lit("")), F.lit('], "tags": ["p", "'),
        F.col("o_orderpriority"), F.lit('"]}\n'),
    )
    return j.select(F.col("o_orderkey").alias("doc_id"), F.lit("orders").alias("source_id"), text.alias("text"))


def evolving_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON upload per order; a ``rush`` field exists from 1998 on.  Source = priority."""
    o = rows(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.concat(F.lit('{"id": '), _num("o_orderkey"), F.lit(', "price": '), _num("o_totalprice"),
                    F.when(F.year("o_orderdate") >= 1998, F.lit(', "rush": true')).otherwise(F.lit("")), F.lit("}"))
    return o.select(k.alias("doc_id"), F.col("o_orderpriority").alias("source_id"), text.alias("text"))


def two_batch_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-EVOL: batch 1 (before 1998) and batch 2 (from 1998) of order documents.

    Batch 2 adds ``rush``, drops ``old_code``, turns ``price`` into text and
    makes ``opt`` optional.  Column ``version`` carries the batch number.
    """
    o = rows(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    v2 = F.year("o_orderdate") >= 1998
    v1_text = F.concat(F.lit('{"id": '), _num("o_orderkey"), F.lit(', "price": '), _num("o_totalprice"),
                       F.lit(', "opt": '), _num("o_custkey"), F.lit(', "old_code": "c'), _num("o_orderkey"), F.lit('"}'))
    v2_text = F.concat(F.lit('{"id": '), _num("o_orderkey"), F.lit(', "price": "USD '), _num("o_totalprice"), F.lit('"'),
                       F.when(k % 2 == 0, F.concat(F.lit(', "opt": '), _num("o_custkey"))).otherwise(F.lit("")),
                       F.lit(', "rush": true}'))
    return o.select(k.alias("doc_id"), F.col("o_orderpriority").alias("source_id"),
                    F.when(v2, 2).otherwise(1).alias("version"), F.when(v2, v2_text).otherwise(v1_text).alias("text"))


def two_family_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two record families for table grouping: account blocks (even keys; every
    key % 10 = 4 lacks ``nation``) and ticket blocks (odd keys)."""
    c = rows(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    account = F.concat(F.lit("Account\nname: "), F.col("c_name"), F.lit("\nsegment: "), F.col("c_mktsegment"),
                       F.lit("\nbalance: "), _num("c_acctbal"),
                       F.when(k % 10 != 4, F.concat(F.lit("\nnation: "), _num("c_nationkey"))).otherwise(F.lit("")),
                       F.lit("\nEnd\n"))
    ticket = F.concat(F.lit("Ticket\nticket: "), _num("c_custkey"), F.lit("\ntier: tier-"), F.lower(F.col("c_mktsegment")),
                      F.lit("\nminutes: "), (F.col("c_nationkey") * 3).cast("string"), F.lit("\nEnd\n"))
    return c.select(k.alias("doc_id"), F.lit("customers").alias("source_id"), F.lit(1).alias("version"),
                    F.when(k % 2 == 0, account).otherwise(ticket).alias("text"))


def varied_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON per order whose field ``v`` changes its type with ``o_orderkey % 5``: integer, number in quotes
    beyond what typing turns into one, boolean, null, absent.  ``big`` holds whole numbers that doubles can't tell apart."""
    o = rows(spark, sf_dir, "orders")
    kind = F.col("o_orderkey") % 5
    v = (F.when(kind == 0, F.concat(F.lit(', "v": '), _num("o_custkey"))).when(kind == 1, F.concat(F.lit(', "v": "c'), _num("o_custkey"), F.lit('"')))
         .when(kind == 2, F.lit(', "v": true')).when(kind == 3, F.lit(', "v": null')).otherwise(F.lit("")))
    text = F.concat(F.lit("Note\n"), F.lit('{"k": '), _num("o_orderkey"), v, F.lit(', "big": 900719925474099'), (F.col("o_orderkey") % 10).cast("string"), F.lit("}\n"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.lit("orders").alias("source_id"), text.alias("text"))


def damaged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order, damaged by ``o_orderkey % 6``: 0 sound JSON, 1 a date that doesn't exist in front
    matter, 2 JSON nested too deeply (every tenth of them, else sound), 3 unclosed tables, 4 a table nested deeply but sound, 5 broken JSON."""
    o = rows(spark, sf_dir, "orders")
    deep = 20_000
    kind = F.col("o_orderkey") % 6
    sound = (kind == 0) | (kind == 2) & (F.col("o_orderkey") % 60 != 2)
    text = (F.when(sound, F.concat(F.lit('{"k": '), _num("o_orderkey"), F.lit("}\n")))
            .when(kind == 1, F.lit("---\nd: 2024-02-30\ne: 1\n---\nend\n"))
            .when(kind == 2, F.concat(F.repeat(F.lit('{"a":'), deep), F.lit("1"), F.repeat(F.lit("}"), deep), F.lit("\n")))
            .when(kind == 3, F.repeat(F.lit("<table><tr><td>x "), 50))
            .when(kind == 4, F.concat(F.lit("<table>"), F.repeat(F.lit("<div>"), 3000), F.lit("<tr><td>"), _num("o_orderkey"), F.lit("</td></tr></table>\n")))
            .otherwise(F.lit('{"a" 1}\n')))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.lit("orders").alias("source_id"), text.alias("text"))


def tree_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON per order with its lines, version 1 before 1998 and 2 from then on; source = priority.

    `lines[].disc` misses where there is no discount, `lines[].tax` is null where it is 0, an order may have no comment. Version 2 of the
    first four priorities has `ship` (an object), no `old.code`, and text for `lines[].qty`; that of the fifth is the same as version 1.
    """
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    many = _tasks(spark, li)
    changed = lambda day, priority: (F.year(day) >= 1998) & ~F.col(priority).startswith("5")
    li = li.join(o.select(F.col("o_orderkey").alias("l_orderkey"), changed("o_orderdate", "o_orderpriority").alias("new")), "l_orderkey")
    qty = F.when(F.col("new"), F.concat(F.lit('"'), F.col("l_quantity").cast("int"), F.lit(' pcs"'))).otherwise(F.col("l_quantity").cast("int").cast("string"))
    line = F.concat(F.lit('{"n": '), _num("l_linenumber"), F.lit(', "qty": '), qty,
                    F.when(F.col("l_discount") > 0, F.concat(F.lit(', "disc": '), _num("l_discount"))).otherwise(F.lit("")),
                    F.lit(', "tax": '), F.when(F.col("l_tax") > 0, _num("l_tax")).otherwise(F.lit("null")), F.lit("}"))
    lines = li.select("l_orderkey", "l_linenumber", line.alias("j")).groupBy("l_orderkey").agg(F.expr("listagg(j, ', ') within group (order by l_linenumber)").alias("lines"))
    j = o.join(lines, o.o_orderkey == lines.l_orderkey, "left").repartition(many).withColumn("new", changed("o_orderdate", "o_orderpriority"))
    text = F.concat(
        F.lit('{"id": '), _num("o_orderkey"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(', "note": "x"')).otherwise(F.lit("")),
        F.when(F.col("new"), F.concat(F.lit(', "ship": {"mode": "m", "days": '), (F.col("o_orderkey") % 7).cast("string"), F.lit('}, "old": {"key": 1}')))
        .otherwise(F.lit(', "old": {"key": 1, "code": "c"}')),
        F.lit(', "lines": ['), F.coalesce(F.col("lines"), F.lit("")), F.lit("]}"))
    return j.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("source_id"), F.when(F.year("o_orderdate") >= 1998, 2).otherwise(1).alias("version"), text.alias("text"))
