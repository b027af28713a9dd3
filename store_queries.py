"""Driver queries that go through statements, calls and files of a store, and their SQL.

Each query makes a store of its own in the shared folder, fills it from whole tables,
and returns what a user of the statement or call gets.
"""

from __future__ import annotations

import io
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import queries as base
from queries import _E0, _KEY, _MONEY, DAY, NOW, E, k
from tessera import functions as fn
from tessera import tools
from tessera.errors import TableError
from tessera.model import DELETE_CELL, DELETE_FAMILY, DELETE_ROW, Family, Group, Schema
from tessera.plans import CellInterval, RowInterval, ScanBuilder, ScanSpec
from tessera.plans.planner import in_order
from tessera.scratch import shared_dir
from tessera.session import Session
from tessera.shell import Shell
from tessera.sources import facts, generator, sink

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register the function under its name, with its SQL."""

    def register(build):
        QUERIES[build.__name__] = build
        ORACLES[build.__name__] = sql
        return build

    return register


def session(spark: SparkSession) -> Session:
    return Session(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", clock=lambda: NOW)


def path(s: Session, name: str) -> str:
    return f"{s.store.root}/files/{name}"


def shown(cells: DataFrame) -> DataFrame:
    return cells.select("row", "cf", "cq", F.col("value").cast("string").alias("value"))


def lines(spark: SparkSession, texts) -> DataFrame:
    return spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, line string")


def numbered(spark: SparkSession, file: str) -> DataFrame:
    """Lines of a file, or of a folder's parts by their names, with their numbers, to hold an order against SQL's.

    Spark reads the largest parts first, so a line's place is its part's name, its split's begin
    and its place in the split.  That is written aside once, as the next pass may split
    otherwise; the splits' counts make it a number without gaps.
    """
    aside, split = f"{file}-read-{uuid.uuid4().hex}", ["file_name", "file_block_start"]
    place = F.monotonically_increasing_id().alias("at")
    read = spark.read.text(file).select(*[f"_metadata.{c}" for c in split], place, F.col("value").alias("line"))
    read.write.parquet(aside)
    rows = spark.read.schema(read.schema).parquet(aside)
    splits = rows.groupBy(*split).agg(F.min("at").alias("first"), F.count("*").alias("held"))
    # a row a split
    earlier = Window.orderBy(F.length("file_name"), *split).rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.select(*split, (F.coalesce(F.sum("held").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(F.broadcast(begins), split).select((F.col("at") + F.col("shift")).cast("int").alias("n"), "line")


def values(*texts: str) -> str:
    """SQL for :func:`lines` of fixed texts."""
    rows = ", ".join(f"({n}, '{t.replace(chr(39), chr(39) * 2)}')" for n, t in enumerate(texts))
    return f"SELECT CAST(n AS INTEGER) AS n, line FROM (VALUES {rows}) AS v(n, line)"


# ---------------------------------------------------------------- loading files

_CUSTOMER = ("c_name", "c_nationkey", "c_mktsegment")


def customer_cells(spark, d) -> DataFrame:
    """A cell for each of three columns of each customer."""
    t = base._table(spark, d, "customer")
    parts = F.array(*[F.struct(F.lit(c[2:]).alias("cf"), F.col(c).cast("string").alias("value")) for c in _CUSTOMER])
    return t.select(base.PaddedKey("c_custkey").text().alias("row"), F.explode(parts).alias("c")).select("row", "c.cf", "c.value")


def customers(spark, d) -> Session:
    s = session(spark)
    s.execute("CREATE TABLE customer (name, nationkey, mktsegment)")
    s.load("customer", customer_cells(spark, d))
    return s


_C0 = " UNION ALL ".join(f"""SELECT {_KEY.format("c_custkey")} AS "row", '{c[2:]}' AS cf, {n} AS cf_id, '' AS cq, CAST({c} AS VARCHAR) AS value FROM customer""" for n, c in enumerate(_CUSTOMER, 1))
_C = f"({_C0})"
_CELLS = '"row", cf, cq, value'


@query(
    f"""SELECT CAST(o_orderkey AS VARCHAR) || ' ' || o_orderpriority AS "row", cf, '' AS cq, value FROM (
    SELECT *, unnest(['status', 'total']) AS cf, unnest([o_orderstatus, {_MONEY.format("o_totalprice")}]) AS value FROM orders)"""
)
def load_file_into_table(spark, d):
    """Packed files without a header and a file that names their columns."""
    s = session(spark)
    o = base._table(spark, d, "orders")
    o.select(F.concat_ws("\t", "o_orderkey", "o_orderstatus", base._money("o_totalprice"), "o_orderpriority")).write.option("compression", "gzip").text(path(s, "in"))
    s.store.files.write(path(s, "names"), ["#key\tstatus\ttotal\tprio\n"])
    s.execute("CREATE TABLE orders (status, total)")
    s.execute(f"LOAD DATA INFILE HEADER_FILE='{path(s, 'names')}' ROW_KEY_COLUMN=key+prio '{path(s, 'in')}' INTO TABLE orders")
    return shown(s.execute("SELECT * FROM orders").cells)


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS \"row\", 'f' AS cf, 'status' AS cq, o_orderstatus AS value FROM orders UNION ALL SELECT 'key', 'f', 'status', 'f:status'")
def load_header_line(spark, d):
    """The first line of each file names the columns; an equal line further down is data."""
    s = session(spark)
    o = base._table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("f:status"))
    again = spark.createDataFrame([("key", "f:status")], o.schema)
    o.union(again).write.options(header=True, sep="\t").csv(path(s, "in"))
    s.execute("CREATE TABLE t (f)")
    s.execute(f"LOAD DATA INFILE '{path(s, 'in')}' INTO TABLE t")
    return shown(s.execute("SELECT * FROM t").cells)


@query("SELECT o_orderpriority AS prio, count(*) AS keys, CAST(10 + min(length(o_orderpriority)) AS INTEGER) AS shortest, CAST(10 + max(length(o_orderpriority)) AS INTEGER) AS longest FROM orders GROUP BY 1")
def load_uniquify(spark, d):
    """Nine random characters behind each key, so that lines of one key stay rows of their own."""
    s = session(spark)
    o = base._table(spark, d, "orders")
    o.select(F.concat_ws("\t", "o_orderpriority", "o_orderstatus")).write.text(path(s, "in"))
    s.store.files.write(path(s, "names"), ["prio\tstatus\n"])
    s.execute("CREATE TABLE t (status)")
    s.execute(f"LOAD DATA INFILE HEADER_FILE='{path(s, 'names')}' ROW_UNIQUIFY_CHARS=9 '{path(s, 'in')}' INTO TABLE t")
    found = s.execute("SELECT * FROM t").cells.select("row").distinct()
    prio = F.expr("left(row, length(row) - 10)")
    size = F.length("row")
    return found.groupBy(prio.alias("prio")).agg(F.count("*").alias("keys"), F.min(size).alias("shortest"), F.max(size).alias("longest"))


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS "row", 'name' AS cf, '' AS cq, s_name AS value FROM supplier WHERE s_suppkey % 3 <> 1
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'nation', '', CAST(s_nationkey AS VARCHAR) FROM supplier WHERE s_suppkey % 3 = 0
    UNION ALL SELECT 'left out', 'lines', '', CAST(count(*) AS VARCHAR) FROM supplier WHERE s_suppkey % 3 = 1"""
)
def load_short_long_lines(spark, d):
    """Lines without a key are reported, missing fields make no cell, further ones are passed over."""
    s = session(spark)
    t = base._table(spark, d, "supplier")
    key, name, nation = (F.col(c).cast("string") for c in ("s_suppkey", "s_name", "s_nationkey"))
    line = F.when(F.col("s_suppkey") % 3 == 0, F.concat_ws("\t", key, name, nation, F.lit("more")))
    line = line.when(F.col("s_suppkey") % 3 == 1, F.concat_ws("\t", F.lit("NULL"), name)).otherwise(F.concat_ws("\t", key, name))
    t.select(line.alias("value")).write.text(path(s, "in"))
    s.store.files.write(path(s, "names"), ["key\tname\tnation\n"])
    s.execute("CREATE TABLE t (name, nation)")
    report = s.execute(f"LOAD DATA INFILE HEADER_FILE='{path(s, 'names')}' '{path(s, 'in')}' INTO TABLE t")
    out = report.rejected.select(F.lit("left out"), F.lit("lines"), F.lit(""), F.count("*").cast("string"))
    return shown(s.execute("SELECT * FROM t").cells).union(out)


@query(f"SELECT \"row\" || chr(9) || cf || chr(9) || value AS line FROM {_C} UNION ALL SELECT '#row' || chr(9) || 'column' || chr(9) || 'value'")
def load_into_file(spark, d):
    """A file of rows rewritten as a file of single cells."""
    s = session(spark)
    c = base._table(spark, d, "customer").select(base.PaddedKey("c_custkey").text().alias("key"), *[F.col(n).alias(n[2:]) for n in _CUSTOMER])
    c.write.options(header=True, sep="\t").csv(path(s, "in"))
    s.execute(f"LOAD DATA INFILE '{path(s, 'in')}' INTO FILE '{path(s, 'out')}'")
    return spark.read.text(path(s, "out")).select(F.col("value").alias("line"))


@query(f"SELECT cf, count(*) AS cells, count(DISTINCT \"row\") AS \"rows\" FROM {_C} GROUP BY cf")
def load_standard_input(spark, d):
    """The same through standard input."""
    s = session(spark)
    c = base._table(spark, d, "customer").select(F.concat_ws("\t", base.PaddedKey("c_custkey").text(), *_CUSTOMER))
    was, sys.stdin = sys.stdin, io.StringIO("\n".join(["key\tname\tnationkey\tmktsegment", *(r[0] for r in c.toLocalIterator())]))
    try:
        s.execute("CREATE TABLE customer (name, nationkey, mktsegment)")
        s.execute("LOAD DATA INFILE '-' INTO TABLE customer")
    finally:
        sys.stdin = was
    return s.execute("SELECT * FROM customer").cells.groupBy("cf").agg(F.count("*").alias("cells"), F.countDistinct("row").alias("rows"))


_LATEST = f"""SELECT "row", cf, '' AS cq, value FROM (SELECT *, row_number() OVER (PARTITION BY "row", cf ORDER BY rev DESC) AS age FROM ({_E0}))
  WHERE age = 1 AND CAST("row" AS BIGINT) % 5 <> 0 AND NOT (CAST("row" AS BIGINT) % 7 = 3 AND cf = 'view')"""


@query(f"{_LATEST} UNION ALL SELECT DISTINCT {_KEY.format('user_id')}, 'signup', '', 'again' FROM events WHERE user_id % 10 = 0")
def update_script(spark, d):
    """Events, deletes of every scope and new inserts, stamped in the order of lines."""
    s = session(spark)
    e = base._table(spark, d, "events")
    user, users = base.PaddedKey("user_id").text(), e.select("user_id").distinct()
    part = lambda rows, n, at, *fields: rows.select(F.lit(n).alias("part"), at.alias("at"), F.concat_ws("\t", F.lit("AUTO"), *fields).alias("line"))
    script = part(e, 0, F.col("event_id"), user, "event_type", base._money("value"))
    script = script.union(part(users.filter("user_id % 5 = 0"), 1, F.col("user_id"), user, F.lit("DELETE")))
    script = script.union(part(users.filter("user_id % 7 = 3"), 1, F.col("user_id"), user, F.lit("view"), F.lit("DELETE")))
    script = script.union(part(users.filter("user_id % 10 = 0"), 2, F.col("user_id"), user, F.lit("signup"), F.lit("again")))
    sink.write_lines(script.orderBy("part", "at").select("line"), path(s, "script"), "AUTO")
    s.execute("CREATE TABLE events (click, error, purchase, signup, view)")
    assert s.execute(f"UPDATE events '{path(s, 'script')}'").lines == ["too few fields: AUTO"]
    return shown(s.execute("SELECT * FROM events REVS 1").cells)


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS "row", cf, cq, value FROM (SELECT p_partkey,
    unnest(['name', 'category', 'property', 'property']) AS cf, unnest(['', '', 'p_brand', 'p_size']) AS cq,
    unnest([p_name, 'part', p_brand, CAST(p_size AS VARCHAR)]) AS value FROM part) WHERE value <> ''"""
)
def load_facts(spark, d):
    s = session(spark)
    topics = base._table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    s.execute("CREATE TABLE facts (name, category, property)")
    s.load("facts", facts.fact_cells(topics, "part", key="p_partkey", name="p_name"))
    return shown(s.execute("SELECT * FROM facts").cells)


@query("SELECT lpad(CAST(n AS VARCHAR), 6, '0') AS \"row\", cf, size, letters FROM range(2000) AS r(n), (VALUES ('a', 12, 12), ('b', 5, 0)) AS c(cf, size, letters)")
def generated(spark, d):
    """Two columns of random characters for each key of a rising sequence."""
    s = session(spark)
    s.execute("CREATE TABLE t (a, b)")
    columns = [generator.ColumnSpec("a", value_size=12, charset="xyz"), generator.ColumnSpec("b", value_size=5, charset="0")]
    s.load("t", generator.generate(spark, [generator.Part(form="%06d")], columns, 2000 * (12 + 5 + 2 + 16)))
    value = F.col("value").cast("string")
    letters = F.length(F.regexp_replace(value, "[^xyz]", ""))
    return s.execute("SELECT * FROM t").cells.select("row", "cf", F.length(value).alias("size"), letters.alias("letters"))


# ---------------------------------------------------------------- reading

_LINE = "\"row\" || chr(9) || cf || chr(9) || value"
_ORDERED = f"SELECT CAST(row_number() OVER (ORDER BY \"row\", cf_id) {{}} AS INTEGER) AS n, {_LINE} AS line FROM {_C}"


@query(f"SELECT {_LINE} AS line FROM {_C}")
def select_lines(spark, d):
    return customers(spark, d).execute("SELECT * FROM customer").rendered


@query(f"{_ORDERED.format('')} UNION ALL SELECT 0, '#row' || chr(9) || 'column' || chr(9) || 'value'")
def select_into_file(spark, d):
    """One packed file with a header, in the order of keys and families."""
    s = customers(spark, d)
    s.execute(f"SELECT * FROM customer INTO FILE '{path(s, 'out.gz')}'")
    return numbered(spark, path(s, "out.gz"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY \"row\", cf_id, ts DESC, rev DESC) - 1 AS INTEGER) AS n, \"row\" || chr(9) || cf || chr(9) || value AS line FROM {E}")
def merge_order(spark, d):
    """Cells of several segments in one order: key, family, newest first."""
    s = session(spark)
    s.execute("CREATE TABLE events (click, error, purchase, signup, view)")
    found = base.events(spark, d).cells()
    for n in range(3):
        table = s.store.table("events")
        table.append(found.filter(F.col("rev") % 3 == n))
    sink.write_folder(s.scan("events"), path(s, "out"))
    return numbered(spark, path(s, "out"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY \"row\", cf_id) - 1 AS INTEGER) AS n, {_LINE} AS line FROM {_C} WHERE \"row\" > '{k(5)}'")
def scanner_blocks(spark, d):
    """A cursor by statements: created, fetched block by block until nothing comes, destroyed."""
    s = customers(spark, d)
    scanner = s.execute(f"CREATE SCANNER ON customer['{k(5)}'..??]").scanner
    got: list[str] = []
    while block := s.execute(f"FETCH SCANBLOCK {scanner}").lines:
        assert len(block) <= s.CHUNK
        got += block
    s.execute(f"DESTROY SCANNER {scanner}")
    return lines(spark, [x.split("\t", 1)[1] for x in got])


@query(f"SELECT \"row\", count(*) AS cells, min(value) AS least FROM {_C} GROUP BY \"row\"")
def scanner_rows(spark, d):
    """The same cells through a cursor's rows, by calls."""
    s = customers(spark, d)
    scanner = s.open_scanner(s.scan("customer"))
    got = []
    while row := s.next_row(scanner):
        got.append((row[0].row, len(row), min(bytes(c.value).decode() for c in row)))
    s.close_scanner(scanner)
    return spark.createDataFrame(got, "row string, cells long, least string")


@query(f"SELECT {_CELLS} FROM (SELECT \"row\", cf, cq, value FROM {_C} WHERE CAST(\"row\" AS BIGINT) IN (SELECT n_nationkey FROM nation) UNION ALL SELECT \"row\", 'cell', '', value FROM {_C} WHERE cf = 'name' AND CAST(\"row\" AS BIGINT) IN (SELECT n_nationkey FROM nation) UNION ALL SELECT \"row\", 'cells', '', value FROM {_C} WHERE cf = 'nationkey')")
def get_calls(spark, d):
    """Rows and cells by calls, for each key that a nation has; and all cells of a family."""
    s = customers(spark, d)
    got = []
    for r in base._table(spark, d, "nation").select("n_nationkey").collect():
        key = k(r[0])
        got += [(key, c.cf, c.cq, bytes(c.value).decode()) for c in s.get_row("customer", key)]
        cell = s.get_cell("customer", key, "name")
        got += [] if cell is None else [(key, "cell", "", cell.decode())]
    got += [(c.row, "cells", c.cq, bytes(c.value).decode()) for c in s.get_cells("customer", ScanSpec(families=("nationkey",)))]
    return spark.createDataFrame(got, "row string, cf string, cq string, value string")


@query(f"SELECT {_CELLS} FROM {_C} WHERE cf IN ('name', 'mktsegment') AND \"row\" >= '{k(10)}' AND \"row\" < '{k(90)}'")
def scan_builder(spark, d):
    s = customers(spark, d)
    spec = ScanBuilder().add_column("name").add_column("mktsegment").add_row_interval(k(10), True, k(90), False).set_max_versions(1)
    return shown(s.scan("customer", spec.get()))


@query(f"SELECT \"row\", cf, cq, value FROM {_C} WHERE \"row\" || cf >= '{k(20)}' || 'name'")
def stored_cells(spark, d):
    """All cells of the segments as a DataFrame, for jobs that read in parallel."""
    s = customers(spark, d)
    return shown(tools.stored(s.store.table("customer"), k(19))).filter(~((F.col("row") == k(20)) & (F.col("cf") < "name")))


# ---------------------------------------------------------------- writing

@query(
    """SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS "row", 'name' AS cf, '' AS cq, s_name AS value FROM supplier WHERE s_suppkey % 5 <> 0
    UNION ALL SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0'), 'nation', 'key', CAST(s_nationkey AS VARCHAR) FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 0"""
)
def mutators(spark, d):
    """Cells set and deleted through a mutator, in several flushes."""
    s = session(spark)
    s.create_table("supplier", Schema.define([Family("name"), Family("nation")]))
    rows = base._table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").orderBy("s_suppkey").collect()
    with s.mutator("supplier", flush_cells=len(rows)) as m:
        for r in rows:
            m.set(k(r.s_suppkey), "name", r.s_name)
            m.set(k(r.s_suppkey), "nation:key", str(r.s_nationkey))
        for r in rows:
            if r.s_suppkey % 5 == 0:
                m.set_delete(k(r.s_suppkey))
            elif r.s_suppkey % 3 == 0:
                m.set_delete(k(r.s_suppkey), "nation:key")
    return shown(s.scan("supplier"))


@query("SELECT lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS \"row\", 'name' AS cf, 'q' AS cq, n_name AS value, CAST(n_nationkey AS BIGINT) AS ts FROM nation WHERE n_nationkey % 4 <> 1 AND n_nationkey % 4 <> 2")
def mutators_by_number(spark, d):
    """Cells as arrays of strings, flags and times among them, through mutators that are named by a number."""
    s = session(spark)
    s.create_table("nation", Schema.define([Family("name")]))
    rows = base._table(spark, d, "nation").select("n_nationkey", "n_name").collect()
    m = s.open_mutator("nation")
    s.set_cells(m, [(k(r[0]), "name", "q", r[1], str(r[0])) for r in rows])
    for r in rows:
        if r[0] % 4 == 1:
            s.set_cell(m, (k(r[0]), "name", "q", "", str(r[0] + 1), "", str(DELETE_CELL)))
        elif r[0] % 4 == 2:
            s.set_cell(m, (k(r[0]), "name", "", "", str(r[0] + 1), "", str(DELETE_FAMILY)))
    s.flush_mutator(m)
    s.set_cell(m, (k(0), "", "", "", "0", "", str(DELETE_ROW)))  # hides what is older than 0: nothing
    s.close_mutator(m)
    return s.scan("nation").select("row", "cf", "cq", F.col("value").cast("string").alias("value"), "ts")


@query(
    "SELECT lpad(CAST(r_regionkey AS VARCHAR), 10, '0') AS \"row\", 'before' AS part, 0 AS cells FROM region "
    "UNION ALL SELECT lpad(CAST(r_regionkey AS VARCHAR), 10, '0'), r_name, 1 FROM region WHERE r_regionkey % 2 = 0"
)
def unflushed_and_unbuffered(spark, d):
    """Statements whose cells wait in mutators, and reads through scanners: nothing before the flush, then what wasn't deleted."""
    s = session(spark)
    s.execute("CREATE TABLE region (name)")
    rows = base._table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()
    waiting = [s.execute(f"INSERT INTO region VALUES ('{k(r[0])}', 'name', '{r[1]}')", noflush=True).mutator for r in rows]
    waiting += [s.execute(f"DELETE * FROM region WHERE ROW = '{k(r[0])}'", noflush=True).mutator for r in rows if r[0] % 2]
    held = s.next_cells(s.execute("SELECT * FROM region", unbuffered=True).scanner)
    found = [(k(r[0]), "before", len(held)) for r in rows]
    for m in waiting:
        s.close_mutator(m)
    scanner = s.execute("SELECT * FROM region", unbuffered=True).scanner
    while block := s.next_cells(scanner):
        found += [(c.row, bytes(c.value).decode(), 1) for c in block]
    return spark.createDataFrame(found, "row string, part string, cells int")


@query(f"SELECT * FROM (SELECT min(event_id) + 0 AS first_rev, max(event_id) AS last_rev, count(*) AS cells, 0 AS part FROM events UNION ALL SELECT 1 + max(event_id), max(event_id) + count(*), count(*), 1 FROM events)")
def revisions(spark, d):
    """Explicit revisions, then stamped ones: dense, and after all of the first commit."""
    s = session(spark)
    s.execute("CREATE TABLE events (click, error, purchase, signup, view)")
    found = base.events(spark, d).cells()
    s.store.table("events").append(found)
    s.load("events", found.select("row", "cf", "cq", "value"))
    rows = [(x.min_rev, x.max_rev, x.cells, n) for n, x in enumerate(s.store.table("events").manifest().segments)]
    return spark.createDataFrame(rows, "first_rev long, last_rev long, cells long, part int")


@query(f"SELECT {_CELLS} FROM {_C} UNION ALL SELECT 'segments at most', '', '', '20'")
def merging_compactions(spark, d):
    """Commits beyond the number of segments that a table may have: the smallest are merged, and nothing changes."""
    s = customers(spark, d)
    for n in range(22):
        s.execute(f"INSERT INTO customer VALUES ('zz', 'name', '{n}')")
    s.execute("DELETE * FROM customer WHERE ROW = 'zz'")
    most = min(20, len(s.store.table("customer").manifest().segments))
    told = spark.createDataFrame([("segments at most", "", "", "20" if most <= 20 else str(most))], "row string, cf string, cq string, value string")
    return shown(s.execute("SELECT * FROM customer").cells).union(told)


@query(f"SELECT {_CELLS} FROM {_C} WHERE CAST(\"row\" AS BIGINT) % 2 = 0 UNION ALL SELECT 'removed', '', '', '2'")
def vacuumed(spark, d):
    """After a major compaction its inputs, and so the deleted cells, are removed from disk."""
    s = customers(spark, d)
    odd = base._table(spark, d, "customer").filter("c_custkey % 2 = 1").select(base.PaddedKey("c_custkey").text().alias("row"))
    s.load("customer", odd.select("row", F.lit("").alias("cf"), F.lit(None).cast("string").alias("value"), F.lit(DELETE_ROW).alias("flag")))
    table = s.store.table("customer")
    table.compact()
    removed = spark.createDataFrame([("removed", "", "", str(len(table.vacuum())))], "row string, cf string, cq string, value string")
    return shown(tools.stored(table)).union(removed)


@query(f"SELECT {_CELLS} FROM {_C}")
def group_options(spark, d):
    """Groups with compressors, Bloom filters and block sizes of their own."""
    s = session(spark)
    s.execute("CREATE TABLE customer (name, nationkey, mktsegment, ACCESS GROUP a COMPRESSOR='zlib' BLOOMFILTER='rows' (name), ACCESS GROUP b IN_MEMORY COMPRESSOR='none' BLOCKSIZE=8192 (nationkey), ACCESS GROUP c BLOOMFILTER='rows+cols' (mktsegment))")
    s.load("customer", customer_cells(spark, d))
    return shown(s.execute("SELECT * FROM customer").cells)


# ---------------------------------------------------------------- tables

DDL = "CREATE TABLE TTL=1 WEEK MAX_VERSIONS=3 {} (title TTL=1.5 DAYS, author MAX_VERSIONS=2, year, ACCESS GROUP people BLOCKSIZE=4096 (author))"
DDL_TEXT = ("", "CREATE TABLE {} (", "  author MAX_VERSIONS=2 TTL=604800,", "  title MAX_VERSIONS=3 TTL=129600,", "  year MAX_VERSIONS=3 TTL=604800,", "  ACCESS GROUP people BLOCKSIZE=4096 (author),", "  ACCESS GROUP default (title, year)", ")")


@query(values(*(x.format("books") for x in DDL_TEXT)))
def show_create_table(spark, d):
    s = session(spark)
    s.execute(DDL.format("books"))
    return lines(spark, s.execute("SHOW CREATE TABLE books").text())


@query(values(*(x.format("other") for x in DDL_TEXT)))
def create_table_like(spark, d):
    s = session(spark)
    s.execute(DDL.format("books"))
    s.execute("CREATE TABLE other LIKE books")
    return lines(spark, s.execute("SHOW CREATE TABLE other").text())


@query(values("books", "copy", "dropped twice", "no such table"))
def show_and_drop_tables(spark, d):
    s = session(spark)
    s.run("CREATE TABLE books (a); CREATE TABLE gone (a); CREATE TABLE copy LIKE books; DROP TABLE gone; DROP TABLE IF EXISTS gone")
    try:
        s.execute("DROP TABLE gone")
        again = "dropped"
    except TableError:
        again = "no such table"
    return lines(spark, [*s.execute("SHOW TABLES").text(), "dropped twice", again])


@query(values("author 1 0 0", "title 2 3 129600", "generation 1", "same"))
def describe_table(spark, d):
    """The schema as XML, with ids and without, read back."""
    s = session(spark)
    s.execute("CREATE TABLE books (title MAX_VERSIONS=3 TTL=36 HOURS, author, ACCESS GROUP g (author))")
    xml = "\n".join(s.execute("DESCRIBE TABLE WITH IDS books").text())
    schema = Schema.from_xml(xml)
    plain = Schema.from_xml("\n".join(s.execute("DESCRIBE TABLE books").text()))
    names = [f"{f.name} {f.id} {f.max_versions} {f.ttl}" for f in schema.families]
    return lines(spark, [*names, f"generation {schema.generation}", "same" if plain.groups == schema.groups else "other"])


@query(values("books 1", "b,a 2", "books", "other", "books"))
def catalog_calls(spark, d):
    """Tables made, altered, opened, named and dropped by calls."""
    s = session(spark)
    s.create_table("books", Schema.define([Family("a")]))
    s.create_table("other", Schema.define([Family("b"), Family("a")], [Group("g", ("b",))]).to_xml())
    told = [f"books {s.get_table_id('books')}", f"{','.join(f.name for f in Schema.from_xml(s.get_schema('other')).live())} {s.get_table_id('other')}", *s.get_tables()]
    s.alter_table("books", s.open_table("books").schema.alter([("add", (Family("c"),), ())]))
    s.drop_table("other")
    return lines(spark, [*told, *s.get_tables()])


_BAD = {
    "interval of rows": "SELECT * FROM t WHERE ('z' < ROW < 'a')",
    "interval of cells": "SELECT * FROM t WHERE 'b','c' < CELL < 'a','c'",
    "rows and cells": "SELECT * FROM t WHERE ROW = 'a' AND CELL = 'a','c'",
    "limit twice": "SELECT * FROM t LIMIT 1 LIMIT 2",
    "revs twice": "SELECT * FROM t REVS 1 REVS 2",
    "family": "SELECT x FROM t",
    "table": "SELECT * FROM nowhere",
    "prefix of a time": "SELECT * FROM t WHERE TIMESTAMP =^ '2008-01-01'",
    "key": "INSERT INTO t VALUES ('', 'c', 'v')",
    "same table": "CREATE TABLE t (c)",
    "dropped family": "ALTER TABLE t DROP (x)",
}


@query(values(*(f"{n}: refused" for n in _BAD)))
def refused_statements(spark, d):
    s = session(spark)
    s.execute("CREATE TABLE t (c, b)")
    told = []
    for name, text in _BAD.items():
        try:
            s.execute(text)
            told.append(f"{name}: taken")
        except TableError:
            told.append(f"{name}: refused")
    return lines(spark, told)


@query(values("HELP has select", "HELP has insert", "HELP has load data infile", "nothing to do"))
def help_and_administration(spark, d):
    s = session(spark)
    told = [f"HELP has {t}" for t in ("select", "insert", "load data infile") if s.execute(f"HELP {t}").lines[0].lower().startswith(t)]
    done = all("nothing to do" in s.execute(x).lines[0] for x in ("CLOSE", "SHUTDOWN"))
    return lines(spark, [*told, "nothing to do" if done else "?"])


# ---------------------------------------------------------------- tools

@query("SELECT 'customer' AS \"table\", 3 * count(*) AS cells, 2 AS segments, 1 AS markers FROM customer")
def dump_segments(spark, d):
    """The listing of segments as a file, with its counts."""
    s = customers(spark, d)
    s.execute("DELETE * FROM customer WHERE ROW = 'none'")
    s.execute(f"DUMP NOKEYS '{path(s, 'dump')}'")
    read = spark.read.text(path(s, "dump")).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("p"))
    listed = read.groupBy(F.col("p")[0].alias("name")).agg(F.sum(F.col("p")[2].cast("long")).alias("held"), F.count("*").cast("int").alias("segments"))
    known = tools.counts(s.store).select("table", "cells", "markers")
    both = listed.join(known, (F.col("name") == F.col("table")) & (F.col("held") == F.col("cells")))
    return both.select("table", (F.col("cells") - F.col("markers")).alias("cells"), "segments", F.col("markers").cast("int").alias("markers"))


@query(f"SELECT min(\"row\") AS first, max(\"row\") AS last, count(*) AS cells, min(rev) AS first_rev, max(rev) AS last_rev FROM ({_E0})")
def list_segments(spark, d):
    """What the manifest knows of a segment: bounds, counts, revisions."""
    s = session(spark)
    s.execute("CREATE TABLE events (click, error, purchase, signup, view)")
    s.store.table("events").append(base.events(spark, d).cells())
    return tools.segments(s.store).select("first", "last", "cells", "first_rev", "last_rev")


@query(f"SELECT {_CELLS}, '<' AS side FROM {_C} WHERE CAST(\"row\" AS BIGINT) % 50 = 0 UNION ALL SELECT 'new', 'name', '', 'x', '>'")
def merge_difference(spark, d):
    s = customers(spark, d)
    before = shown(s.scan("customer"))
    t = base._table(spark, d, "customer").filter("c_custkey % 50 = 0").select(base.PaddedKey("c_custkey").text().alias("row"))
    s.load("customer", t.select("row", F.lit("").alias("cf"), F.lit(None).cast("string").alias("value"), F.lit(DELETE_ROW).alias("flag")))
    s.execute("INSERT INTO customer VALUES ('new', 'name', 'x')")
    return sink.differences(before, shown(s.scan("customer")))


@query("SELECT CAST(200 AS BIGINT) AS wrote, CAST(2 AS BIGINT) AS commits, CAST(25 AS BIGINT) AS requests, 2 * CAST(25 AS BIGINT) AS cells")
def load_and_query_drivers(spark, d):
    """A load in two commits, then random point reads; the figures without their times."""
    s = session(spark)
    s.execute("CREATE TABLE t (f)")
    row = [generator.Part(form="%04d", high=99)]
    wrote = tools.update(s, "t", row, [generator.ColumnSpec("f", value_size=20)], 200 * 37, commits=2)
    read = tools.query(s, "t", [f"{n:04d}" for n in range(25)])
    rows = [(wrote.cells, wrote.requests, read.requests, 2 * read.cells)]
    return spark.createDataFrame(rows, "wrote long, commits long, requests long, cells long")


@query(values("CREATE TABLE t (a);", "INSERT INTO t VALUES ('r', 'a', 'x;y');", "SELECT * FROM t;", "r\ta\tx;y", "SELECT * FROM u;", "Error: table 'u' does not exist", "1 tables", "done"))
def shell_script(spark, d):
    out = io.StringIO()
    Shell(session(spark), out, test_mode=True).run("CREATE TABLE t (a); INSERT INTO t VALUES ('r', 'a', 'x;y'); SELECT * FROM t; SELECT * FROM u; status; print done; quit; print never")
    return lines(spark, out.getvalue().splitlines())


@query(f"SELECT {_CELLS} FROM (SELECT *, row_number() OVER (PARTITION BY \"row\" ORDER BY cf_id) AS n FROM {_C}) WHERE n = 1")
def statements_in_a_script(spark, d):
    """Several statements in one text; the last one's cells."""
    s = customers(spark, d)
    done = s.run("ALTER TABLE customer ADD (note) DROP (mktsegment); ALTER TABLE customer DROP (nationkey); SELECT * FROM customer REVS 1")
    return shown(in_order(done[-1].cells))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
