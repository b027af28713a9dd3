"""Driver queries over cell views of the tables, and their SQL.

E: events as versioned cells (row: user, family: type).  O: orders, a family a
column.  L: line items, a cell a measure.  D: documents.  C: conversations.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import functions as fn
from tessera.dialect.statements import LoadOptions
from tessera.model import CELL_SCHEMA, DELETE_CELL, DELETE_FAMILY, DELETE_ROW, Family, Schema
from tessera.operators import visibility
from tessera.plans import CellInterval, RowInterval, ScanSpec
from tessera.relational import PaddedKey, View, cells, pivot
from tessera.scratch import shared_dir
from tessera.sources import sink, tsv, weblog

# ---------------------------------------------------------------- views

E_FAMILIES = ("click", "error", "purchase", "signup", "view")
O_FAMILIES = ("status", "total", "date", "priority", "cust")
L_FAMILIES = ("quantity", "price", "discount", "tax", "flag", "status")


def _schema(*names: str, **options) -> Schema:
    return Schema.define([Family(n, **options) for n in names])


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(column: str) -> F.Column:
    return F.col(column).cast("decimal(18,2)").cast("string")


def events(spark, sf_dir, schema: Schema | None = None) -> View:
    return View(_table(spark, sf_dir, "events"), schema or _schema(*E_FAMILIES), PaddedKey("user_id"), fn.nanos_of(F.col("ts")), F.col("event_id"), by_family=(F.col("event_type"), _money("value")))


def orders(spark, sf_dir) -> View:
    values = {"status": F.col("o_orderstatus"), "total": _money("o_totalprice"), "date": F.date_format("o_orderdate", "yyyy-MM-dd"), "priority": F.col("o_orderpriority"), "cust": F.col("o_custkey")}
    return View(_table(spark, sf_dir, "orders"), _schema(*O_FAMILIES), PaddedKey("o_orderkey"), fn.nanos_of(F.col("o_orderdate")), F.col("o_orderkey"), values)


def lineitems(spark, sf_dir) -> View:
    values = {"quantity": _money("l_quantity"), "price": _money("l_extendedprice"), "discount": _money("l_discount"), "tax": _money("l_tax"), "flag": F.col("l_returnflag"), "status": F.col("l_linestatus")}
    cq = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", _money("l_extendedprice"), F.date_format("l_shipdate", "yyyy-MM-dd"))
    return View(_table(spark, sf_dir, "lineitem"), _schema(*L_FAMILIES), PaddedKey("l_orderkey"), fn.nanos_of(F.col("l_shipdate")), F.lit(1), values, cq=cq)


def documents(spark, sf_dir) -> View:
    values = {"text": F.col("text"), "meta:lang": F.col("lang"), "meta:source": F.col("source"), "meta:n_chars": F.col("n_chars")}
    return View(_table(spark, sf_dir, "documents"), _schema("text", "meta"), PaddedKey("doc_id"), F.lit(0), F.col("doc_id"), values)


def turns(spark, sf_dir) -> View:
    cq = F.concat_ws(":", F.lpad(F.col("turn").cast("string"), 6, "0"), "role")
    return View(_table(spark, sf_dir, "conversations"), _schema("turn"), PaddedKey("conv_id"), F.lit(0), F.col("conv_id"), {"turn": F.col("text")}, cq=cq)


def shown(found: DataFrame, *more: str) -> DataFrame:
    return found.select(*more, "row", "cf", "cq", "ts", F.col("value").cast("string").alias("value"))


_MONEY = "CAST(CAST({} AS DECIMAL(18,2)) AS VARCHAR)"
_KEY = "lpad(CAST({} AS VARCHAR), 10, '0')"
_ids = lambda names: "CASE cf " + " ".join(f"WHEN '{n}' THEN {k + 1}" for k, n in enumerate(names)) + " END"
_parts = lambda table, key, ts, rev, cq, values: " UNION ALL ".join(f"""SELECT {_KEY.format(key)} AS "row", '{f}' AS cf, {q or cq} AS cq, {ts} AS ts, {rev} AS rev, {v} AS value FROM {table}""" for f, q, v in values)
_E0 = f"""SELECT {_KEY.format("user_id")} AS "row", event_type AS cf, '' AS cq, epoch_ns(ts) AS ts, event_id AS rev, {_MONEY.format("value")} AS value FROM events"""
_O0 = _parts("orders", "o_orderkey", "epoch_ns(o_orderdate)", "o_orderkey", "''", [("status", "", "o_orderstatus"), ("total", "", _MONEY.format("o_totalprice")), ("date", "", "strftime(o_orderdate, '%Y-%m-%d')"), ("priority", "", "o_orderpriority"), ("cust", "", "CAST(o_custkey AS VARCHAR)")])
_LQ = f"concat_ws('-', l_linenumber, l_partkey, l_suppkey, {_MONEY.format('l_extendedprice')}, strftime(l_shipdate, '%Y-%m-%d'))"
_L0 = _parts("lineitem", "l_orderkey", "epoch_ns(l_shipdate)", "1", _LQ, [("quantity", "", _MONEY.format("l_quantity")), ("price", "", _MONEY.format("l_extendedprice")), ("discount", "", _MONEY.format("l_discount")), ("tax", "", _MONEY.format("l_tax")), ("flag", "", "l_returnflag"), ("status", "", "l_linestatus")])
_D0 = _parts("documents", "doc_id", "CAST(0 AS BIGINT)", "doc_id", "''", [("text", "", "text"), ("meta", "'lang'", "lang"), ("meta", "'source'", "source"), ("meta", "'n_chars'", "CAST(n_chars AS VARCHAR)")])
_C0 = _parts("conversations", "conv_id", "CAST(0 AS BIGINT)", "conv_id", "lpad(CAST(turn AS VARCHAR), 6, '0') || ':' || role", [("turn", "", "text")])
E, O, L, D, C = (f"(SELECT *, {_ids(names)} AS cf_id FROM ({sql}))" for names, sql in ((E_FAMILIES, _E0), (O_FAMILIES, _O0), (L_FAMILIES, _L0), (("text", "meta"), _D0), (("turn",), _C0)))
_SHOW = '"row", cf, cq, ts, value'

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql:
        ORACLES[name] = sql


def scan_query(name: str, view, spec: ScanSpec, base: str, where: str = "TRUE") -> None:
    query(name, lambda spark, d: shown(view(spark, d).scan(spec, has_versions=False)), f"SELECT {_SHOW} FROM {base} WHERE {where}")


def k(n: int) -> str:
    return f"{n:010d}"


# ---------------------------------------------------------------- projection, rows, cells, time

scan_query("scan_full", events, ScanSpec(), E)
scan_query("project_families", orders, ScanSpec(families=("total", "priority")), O, "cf IN ('total', 'priority')")
scan_query("access_group_prune", lineitems, ScanSpec(families=("flag",)), L, "cf = 'flag'")

ROWS = {
    "row_eq": (RowInterval(k(100), True, k(100), True), f"\"row\" = '{k(100)}'"),
    "row_lt": (RowInterval(end=k(50), end_inclusive=False), f"\"row\" < '{k(50)}'"),
    "row_le": (RowInterval(end=k(50)), f"\"row\" <= '{k(50)}'"),
    "row_gt": (RowInterval(k(1400), False), f"\"row\" > '{k(1400)}'"),
    "row_ge": (RowInterval(k(1400)), f"\"row\" >= '{k(1400)}'"),
    "row_range": (RowInterval(k(100), False, k(200), True), f"\"row\" > '{k(100)}' AND \"row\" <= '{k(200)}'"),
    "row_prefix": (RowInterval(prefix="00000001"), "starts_with(\"row\", '00000001')"),
}
for _name, (_interval, _where) in ROWS.items():
    scan_query(_name, orders, ScanSpec(rows=(_interval,)), O, _where)
scan_query("row_prefix_documents", documents, ScanSpec(families=("meta",), rows=(RowInterval(prefix="00000000"),)), D, "cf = 'meta' AND starts_with(\"row\", '00000000')")


def bag_query(name: str, view, base: str, intervals: list[tuple[RowInterval, str]], **more) -> None:
    """Intervals one after the other: a union that keeps duplicates."""
    spec = ScanSpec(rows=tuple(i for i, _ in intervals), **more)
    sql = " UNION ALL ".join(f"SELECT {n} AS ord, {_SHOW} FROM {base} WHERE {w}" for n, (_, w) in enumerate(intervals))
    query(name, lambda spark, d: shown(view(spark, d).scan(spec, has_versions=False), "ord"), sql)


bag_query("row_or_union", orders, O, [ROWS["row_lt"], ROWS["row_eq"], ROWS["row_gt"]])
bag_query("row_overlap_dups", orders, O, [ROWS["row_range"], (RowInterval(k(150), True, k(250), False), f"\"row\" >= '{k(150)}' AND \"row\" < '{k(250)}'"), (RowInterval(k(160), True, k(160), True), f"\"row\" = '{k(160)}'")])
# each predicate of AND adds an interval, so this is a union as well
bag_query("row_and_union", orders, O, [(RowInterval(k(1300), False), f"\"row\" > '{k(1300)}'"), (RowInterval(end=k(1350), end_inclusive=False), f"\"row\" < '{k(1350)}'")])
bag_query("row_many_intervals", orders, O, [(RowInterval(k(10 * n), True, k(10 * n + n % 15), True), f"\"row\" BETWEEN '{k(10 * n)}' AND '{k(10 * n + n % 15)}'") for n in range(80)])



def after(row: str, family: int, cq: str | None = None, strictly: bool = False) -> str:
    """SQL for cells from a key on; a row comparison, written out."""
    tail = f"cf_id {'>' if strictly and cq is None else '>='} {family}" if cq is None else f"(cf_id > {family} OR cf_id = {family} AND cq {'>' if strictly else '>='} '{cq}')"
    return f"(\"row\" > '{row}' OR \"row\" = '{row}' AND {tail})"


CELLS = {
    "cell_eq": (CellInterval((k(3), "purchase:"), True, (k(3), "purchase:"), True), f"\"row\" = '{k(3)}' AND cf = 'purchase' AND cq = ''"),
    "cell_family": (CellInterval((k(3), "purchase"), True, (k(3), "purchase"), True), f"\"row\" = '{k(3)}' AND cf = 'purchase'"),
    "cell_gt": (CellInterval((k(7), "error"), False), f"(\"row\", cf_id) > ('{k(7)}', 2)"),
    "cell_ge": (CellInterval((k(7), "error"), True), f"(\"row\", cf_id) >= ('{k(7)}', 2)"),
    "cell_range": (CellInterval((k(2), "purchase"), True, (k(9), "click"), True), f"{after(k(2), 3)} AND NOT {after(k(9), 1, strictly=True)}"),
}
for _name, (_cell, _where) in CELLS.items():
    scan_query(_name, events, ScanSpec(cells=(_cell,)), E, _where)
scan_query("cell_prefix", lineitems, ScanSpec(cells=(CellInterval(prefix=(k(20), "price:1")),)), L, f"\"row\" = '{k(20)}' AND cf = 'price' AND starts_with(cq, '1')")
scan_query("cell_qualifier_range", turns, ScanSpec(cells=(CellInterval((k(1), "turn:000002"), True, (k(4), "turn:000001:user"), False),)), C, f"{after(k(1), 1, '000002')} AND NOT {after(k(4), 1, '000001:user')}")

DAY = 86_400 * fn.NANOS
T0 = fn.parse_datetime("2024-01-10")
T1 = fn.parse_datetime("2024-01-20 12:00:00")
_one = "(SELECT min(epoch_ns(ts)) FROM events WHERE event_id = 5)"
scan_query("ts_lt", events, ScanSpec(time=(None, T0)), E, f"ts < {T0}")
scan_query("ts_le", events, ScanSpec(time=(None, T0 + 1)), E, f"ts <= {T0}")
scan_query("ts_gt", events, ScanSpec(time=(T1 + 1, None)), E, f"ts > {T1}")


def ts_eq(spark, d):
    at = _table(spark, d, "events").filter("event_id = 5").select(fn.nanos_of(F.col("ts"))).first()[0]
    return shown(events(spark, d).scan(ScanSpec(time=(at, at + 1)), has_versions=False))


query("ts_eq", ts_eq, f"SELECT {_SHOW} FROM {E} WHERE ts = {_one}")
scan_query("ts_window", events, ScanSpec(time=(T0, T1)), E, f"ts >= {T0} AND ts < {T1}")
scan_query("row_and_ts", events, ScanSpec(rows=(RowInterval(k(2), True, k(8), False),), time=(T0, T1)), E, f"\"row\" >= '{k(2)}' AND \"row\" < '{k(8)}' AND ts >= {T0} AND ts < {T1}")

# ---------------------------------------------------------------- versions and limits

_RANKED = "SELECT *, row_number() OVER (PARTITION BY \"row\", cf, cq ORDER BY ts DESC, rev DESC) AS age FROM {}"


def revs_query(name: str, revs: int, schema: Schema | None = None, where: str = "TRUE", limit: str = "", **more) -> None:
    spec = ScanSpec(revs=revs, **more)
    query(name, lambda spark, d: shown(events(spark, d, schema).scan(spec)), f"SELECT {_SHOW} FROM ({_RANKED.format(E)} WHERE {where}) WHERE {limit or f'age <= {revs}'}")


revs_query("revs_1", 1)
revs_query("revs_3", 3)
revs_query("maxver_schema", 0, _schema(*E_FAMILIES, max_versions=2), limit="age <= 2")
_mixed = Schema.define([Family("click", max_versions=1), Family("error", max_versions=4), Family("purchase"), Family("signup", max_versions=2), Family("view")])
revs_query("maxver_schema_vs_query", 3, _mixed, limit="age <= CASE cf WHEN 'click' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END")
revs_query("maxver_schema_mixed", 0, _mixed, limit="age <= CASE cf WHEN 'click' THEN 1 WHEN 'error' THEN 4 WHEN 'signup' THEN 2 ELSE 1000000000 END")
revs_query("revs_after_time", 2, where=f"ts < {T0}", time=(None, T0))

_FIRST = "SELECT *, dense_rank() OVER (ORDER BY ord, \"row\") AS place FROM ({})"
query("limit_rows", lambda spark, d: shown(orders(spark, d).scan(ScanSpec(limit=7, rows=(RowInterval(k(30)),)), has_versions=False)), f"SELECT {_SHOW} FROM ({_FIRST.format(f'''SELECT 0 AS ord, * FROM {O} WHERE "row" >= '{k(30)}' ''')}) WHERE place <= 7")
_multi = ScanSpec(limit=120, rows=(RowInterval(k(1400), True, k(1499), True), RowInterval(k(1450), True, k(1460), True), RowInterval(end=k(20))))
query(
    "limit_rows_multi_interval",
    lambda spark, d: shown(orders(spark, d).scan(_multi, has_versions=False), "ord"),
    f"SELECT ord, {_SHOW} FROM ({_FIRST.format(' UNION ALL '.join(f'SELECT {n} AS ord, * FROM {O} WHERE {w}' for n, w in enumerate((f'''"row" BETWEEN '{k(1400)}' AND '{k(1499)}' ''', f'''"row" BETWEEN '{k(1450)}' AND '{k(1460)}' ''', f'''"row" <= '{k(20)}' '''))))}) WHERE place <= 120",
)
query("limit_revs_time", lambda spark, d: shown(events(spark, d).scan(ScanSpec(limit=5, revs=1, time=(T0, None)))), f"SELECT {_SHOW} FROM ({_FIRST.format(f'SELECT 0 AS ord, * FROM ({_RANKED.format(E)} WHERE ts >= {T0}) WHERE age <= 1')}) WHERE place <= 5")

NOW = fn.parse_datetime("2024-01-31")
_aging = Schema.define([Family("click", ttl=5 * 86_400), Family("error", ttl=86_400), Family("purchase"), Family("signup", ttl=20 * 86_400), Family("view", ttl=5 * 86_400)])
query("ttl_family", lambda spark, d: shown(events(spark, d, _aging).scan(now_ns=NOW, has_versions=False)), f"SELECT {_SHOW} FROM {E} WHERE ts >= {NOW} - CASE cf WHEN 'click' THEN 5 WHEN 'error' THEN 1 WHEN 'signup' THEN 20 WHEN 'view' THEN 5 ELSE 10000 END * {DAY}")
SNAP = 600
query("snapshot_as_of", lambda spark, d: shown(events(spark, d).scan(ScanSpec(as_of=SNAP, revs=1))), f"SELECT {_SHOW} FROM ({_RANKED.format(E)} WHERE rev <= {SNAP}) WHERE age <= 1")

# ---------------------------------------------------------------- deletes

ROW_T, FAMILY_T, CELL_T = T0, fn.parse_datetime("2024-01-15"), fn.parse_datetime("2024-01-25")
#: A revision after all events.
MARK = 1 << 40


def markers(spark, sf_dir, scopes=("row", "family", "cell")) -> DataFrame:
    """Rows of users divisible by 5, ``click`` of those that leave 1 by 3, ``view`` of those that leave 2 by 4; each from its own time."""
    users = _table(spark, sf_dir, "events").select("user_id").distinct()
    key = PaddedKey("user_id").text()
    make = {
        "row": lambda: cells(users.filter("user_id % 5 = 0"), key, F.lit(""), F.lit(0), F.lit(ROW_T), F.lit(MARK), F.lit(None), flag=F.lit(DELETE_ROW)),
        "family": lambda: cells(users.filter("user_id % 3 = 1"), key, F.lit("click"), F.lit(1), F.lit(FAMILY_T), F.lit(MARK), F.lit(None), flag=F.lit(DELETE_FAMILY)),
        "cell": lambda: cells(users.filter("user_id % 4 = 2"), key, F.lit("view"), F.lit(5), F.lit(CELL_T), F.lit(MARK), F.lit(None), flag=F.lit(DELETE_CELL)),
    }
    out = spark.createDataFrame([], CELL_SCHEMA)
    for s in scopes:
        out = out.unionByName(make[s]())
    return out


_USER = 'CAST("row" AS BIGINT)'
SEEN = {
    "row": f"NOT ({_USER} % 5 = 0 AND ts < {ROW_T})",
    "family": f"NOT ({_USER} % 3 = 1 AND cf = 'click' AND ts < {FAMILY_T})",
    "cell": f"NOT ({_USER} % 4 = 2 AND cf = 'view' AND ts < {CELL_T})",
}
_ALL_SEEN = " AND ".join(SEEN.values())


def delete_query(name: str, spec: ScanSpec, sql: str, scopes=("row", "family", "cell"), more=None) -> None:
    def build(spark, d):
        marks = markers(spark, d, scopes)
        return shown(events(spark, d).scan(spec, markers=marks if more is None else marks.unionByName(more(spark, d)), has_versions=bool(spec.revs)))

    query(name, build, sql)


for _s, _where in SEEN.items():
    delete_query(f"delete_{_s}", ScanSpec(), f"SELECT {_SHOW} FROM {E} WHERE {_where}", (_s,))
delete_query("delete_all_scopes", ScanSpec(), f"SELECT {_SHOW} FROM {E} WHERE {_ALL_SEEN}")
delete_query("delete_newer_than_window", ScanSpec(time=(None, fn.parse_datetime("2024-01-05"))), f"SELECT {_SHOW} FROM {E} WHERE {_ALL_SEEN} AND ts < {fn.parse_datetime('2024-01-05')}")
delete_query("delete_then_versions", ScanSpec(revs=2, families=("click", "view")), f"SELECT {_SHOW} FROM ({_RANKED.format(E)} WHERE {_ALL_SEEN} AND cf IN ('click', 'view')) WHERE age <= 2")
delete_query("delete_in_cell_range", ScanSpec(cells=(CellInterval((k(5), "error"), True, (k(10), "view"), True),)), f"SELECT {_SHOW} FROM {E} WHERE {_ALL_SEEN} AND {after(k(5), 2)} AND NOT {after(k(10), 5, strictly=True)}")


def delete_ts_inclusive(spark, d):
    """The statement's time is hidden too: its marker is a nanosecond later.  Here, of the event 5 and older ones of its user."""
    e = _table(spark, d, "events")
    marks = cells(e.filter("event_id = 5"), PaddedKey("user_id").text(), F.lit(""), F.lit(0), fn.nanos_of(F.col("ts")) + 1, F.lit(MARK), F.lit(None), flag=F.lit(DELETE_ROW))
    return shown(events(spark, d).scan(markers=marks, has_versions=False))


query("delete_ts_inclusive", delete_ts_inclusive, f"SELECT {_SHOW} FROM {E} WHERE NOT (\"row\" = (SELECT {_KEY.format('user_id')} FROM events WHERE event_id = 5) AND ts <= {_one})")


def reinserted(spark, d):
    """Cells written again at the very time of the row marker are seen."""
    users = _table(spark, d, "events").select("user_id").distinct().filter("user_id % 10 = 0")
    return cells(users, PaddedKey("user_id").text(), F.lit("signup"), F.lit(4), F.lit(ROW_T), F.lit(MARK + 1), F.lit("again"))


delete_query("delete_then_reinsert", ScanSpec(), f"SELECT {_SHOW} FROM {E} WHERE {SEEN['row']} UNION ALL SELECT DISTINCT {_KEY.format('user_id')}, 'signup', '', {ROW_T}, 'again' FROM events WHERE user_id % 10 = 0", ("row",), reinserted)
query(
    "return_deletes",
    lambda spark, d: events(spark, d).scan(ScanSpec(return_deletes=True), markers=markers(spark, d)).select("row", "cf", "cq", "ts", F.col("flag").cast("int").alias("flag"), F.col("value").cast("string").alias("value")),
    f"""SELECT "row", cf, cq, ts, 255 AS flag, value FROM {E} WHERE {_ALL_SEEN}
    UNION ALL SELECT DISTINCT {_KEY.format("user_id")}, '', '', {ROW_T}, 0, NULL FROM events WHERE user_id % 5 = 0
    UNION ALL SELECT DISTINCT {_KEY.format("user_id")}, 'click', '', {FAMILY_T}, 1, NULL FROM events WHERE user_id % 3 = 1
    UNION ALL SELECT DISTINCT {_KEY.format("user_id")}, 'view', '', {CELL_T}, 2, NULL FROM events WHERE user_id % 4 = 2""",
)
_versioned = _schema(*E_FAMILIES, max_versions=2)
query(
    "major_compaction",
    lambda spark, d: shown(visibility.major(events(spark, d).cells().unionByName(markers(spark, d)), _versioned.live(), None)),
    f"SELECT {_SHOW} FROM ({_RANKED.format(E)} WHERE {_ALL_SEEN}) WHERE age <= 2",
)

# ---------------------------------------------------------------- output, access, other shapes

query("keys_only", lambda spark, d: orders(spark, d).scan(ScanSpec(keys_only=True, families=("total",)), has_versions=False).select("row"), f'SELECT "row" FROM {O} WHERE cf = \'total\'')
query(
    "display_timestamps",
    lambda spark, d: events(spark, d).scan(has_versions=False).select(fn.render_nanos(F.col("ts")).alias("time"), "row", sink.column_text().alias("col"), F.col("value").cast("string").alias("value")),
    f"SELECT strftime(make_timestamp(ts // 1000), '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST(ts % 1000000000 AS VARCHAR), 9, '0') AS \"time\", \"row\", cf AS col, value FROM {E}",
)
query("get_row", lambda spark, d: shown(events(spark, d).scan(ScanSpec(rows=(RowInterval(k(4), True, k(4), True),), revs=1))), f"SELECT {_SHOW} FROM ({_RANKED.format(E)} WHERE \"row\" = '{k(4)}') WHERE age = 1")
query("get_cell", lambda spark, d: shown(events(spark, d).scan(ScanSpec(cells=(CellInterval((k(4), "view:"), True, (k(4), "view:"), True),), revs=1))), f"SELECT {_SHOW} FROM ({_RANKED.format(E)} WHERE \"row\" = '{k(4)}' AND cf = 'view') WHERE age = 1")
query(
    "pivot_wide",
    lambda spark, d: pivot(orders(spark, d).scan(has_versions=False), list(O_FAMILIES)),
    f"""SELECT {_KEY.format("o_orderkey")} AS "row", o_orderstatus AS status, {_MONEY.format("o_totalprice")} AS total, strftime(o_orderdate, '%Y-%m-%d') AS "date", o_orderpriority AS priority, CAST(o_custkey AS VARCHAR) AS cust FROM orders""",
)
query("count_cells_per_family", lambda spark, d: lineitems(spark, d).scan(has_versions=False).groupBy("cf").agg(F.count("*").alias("cells")), f"SELECT cf, count(*) AS cells FROM {L} GROUP BY cf")
query(
    "rows_grouped",
    lambda spark, d: turns(spark, d).scan(has_versions=False).groupBy("row").agg(F.count("*").alias("cells"), F.min("cq").alias("first_cq"), F.max("cq").alias("last_cq")),
    f'SELECT "row", count(*) AS cells, min(cq) AS first_cq, max(cq) AS last_cq FROM {C} GROUP BY "row"',
)
query(
    "escape_lines",
    lambda spark, d: documents(spark, d).scan(ScanSpec(families=("text",)), has_versions=False).select("row", fn.escape(F.col("value").cast("string")).alias("value")),
    f"SELECT \"row\", replace(replace(value, chr(10), '\\n'), chr(9), '\\t') AS value FROM {D} WHERE cf = 'text'",
)

# ---------------------------------------------------------------- loading

_NAMES = ["key", "f:status", "f:total", "date", "g"]


def order_lines(spark, d) -> DataFrame:
    line = F.concat_ws("\t", "o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "NULL").when(F.col("o_orderkey") % 11 == 0, "\\N").otherwise(_money("o_totalprice")), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("o_orderkey") % 13 == 0, "").otherwise(F.col("o_orderpriority")))
    return _table(spark, d, "orders").select(line.alias("value"))


def loaded(options: LoadOptions, names=tuple(_NAMES), lines=order_lines):
    return lambda spark, d: tsv.cells_of(lines(spark, d), list(names), options)[0].select("row", "cf", "cq", "ts", "value")


def _load_sql(row: str, ts: str, *values: tuple[str, str, str], where: str = "TRUE") -> str:
    return " UNION ALL ".join(f"SELECT {row} AS \"row\", '{cf}' AS cf, '{cq}' AS cq, {ts} AS ts, {v} AS value FROM orders WHERE {where} AND ({v}) IS NOT NULL" for cf, cq, v in values)


_total = f"CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE {_MONEY.format('o_totalprice')} END"
_date, _prio = "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')", "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END"
query("load_multi_cell", loaded(LoadOptions()), _load_sql("CAST(o_orderkey AS VARCHAR)", "CAST(NULL AS BIGINT)", ("f", "status", "o_orderstatus"), ("f", "total", _total), ("date", "", _date), ("g", "", _prio)))
query("load_timestamp_column", loaded(LoadOptions(timestamp_column="date")), _load_sql("CAST(o_orderkey AS VARCHAR)", "epoch_ns(o_orderdate)", ("f", "status", "o_orderstatus"), ("f", "total", _total), ("g", "", _prio)))
query("load_rowkey_concat", loaded(LoadOptions(row_key=("%012key", "date"))), _load_sql(f"lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || ' ' || {_date}", "CAST(NULL AS BIGINT)", ("f", "status", "o_orderstatus"), ("f", "total", _total), ("g", "", _prio)))
query("load_dup_key_cols", loaded(LoadOptions(dup_key_cols=True, row_key=("g",))), _load_sql(_prio, "CAST(NULL AS BIGINT)", ("key", "", "CAST(o_orderkey AS VARCHAR)"), ("f", "status", "o_orderstatus"), ("f", "total", _total), ("date", "", _date), ("g", "", _prio), where=f"({_prio}) IS NOT NULL"))
query(
    "load_key_formats",
    lambda spark, d: _table(spark, d, "customer").select(*[fn.key_format(F.col("c_custkey").cast("string"), f).alias(n) for f, n in (("%03", "zeros"), ("%8", "front"), ("%-8", "behind"))], F.col("c_custkey")),
    "SELECT c_custkey, CASE WHEN length(k) < 3 THEN lpad(k, 3, '0') ELSE k END AS zeros, CASE WHEN length(k) < 8 THEN lpad(k, 8, ' ') ELSE k END AS front, CASE WHEN length(k) < 8 THEN rpad(k, 8, ' ') ELSE k END AS behind FROM (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k FROM customer)",
)


def single_lines(spark, d) -> DataFrame:
    """Text as single-cell lines, escaped, with a time; every ninth has a bad one."""
    stamp = F.when(F.col("doc_id") % 9 == 8, "soon").otherwise(F.col("doc_id").cast("string"))
    return _table(spark, d, "documents").select(F.concat_ws("\t", stamp, "source", F.concat(F.lit("text:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("lang")), fn.escape(F.col("text"))).alias("value"))


query(
    "load_single_cell",
    loaded(LoadOptions(), ("timestamp", "rowkey", "columnkey", "value"), single_lines),
    "SELECT source AS \"row\", 'text' AS cf, CAST(doc_id AS VARCHAR) || ':' || lang AS cq, doc_id AS ts, text AS value FROM documents WHERE doc_id % 9 <> 8",
)
query("load_escape", lambda spark, d: _table(spark, d, "documents").select("doc_id", fn.unescape(fn.escape(F.col("text"))).alias("text")), "SELECT doc_id, text FROM documents")


def log_lines(spark, d) -> DataFrame:
    e = _table(spark, d, "events")
    request = F.concat(F.lit('"GET /'), F.col("event_type"), F.lit("/"), F.col("user_id").cast("string"), F.lit('?x=1 HTTP/1.1"'))
    return e.select(F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string"), F.lit(" - "), F.when(F.col("user_id") % 3 == 0, "-").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))), F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000] "), request, F.lit(" 200 "), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.lit(' "http://r/" "agent 1"')).otherwise("")).alias("value"))


query(
    "parse_weblog",
    lambda spark, d: weblog.parse_log(log_lines(spark, d)),
    """SELECT '10.0.0.' || (user_id % 256) AS ip_address, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'u' || user_id END AS userid, epoch_ns(date_trunc('second', ts)) AS ts,
    'GET /' || event_type || '/' || user_id || '?x=1 HTTP/1.1' AS request, '200' AS response_code, CAST(event_id AS VARCHAR) AS object_size,
    CASE WHEN event_id % 2 = 0 THEN 'http://r/' END AS referer, CASE WHEN event_id % 2 = 0 THEN 'agent 1' END AS user_agent FROM events""",
)
_page = "'/' || event_type || '/' || user_id || '?x=1'"
query(
    "load_weblog",
    lambda spark, d: weblog.log_cells(weblog.parse_log(log_lines(spark, d))).select("row", "cf", "value"),
    f"""SELECT {_page} || ' ' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS "row", cf, v AS value FROM (SELECT *,
      unnest(['ClientIpAddress', 'UserId', 'Request', 'ResponseCode', 'ObjectSize', 'Referer', 'UserAgent']) AS cf,
      unnest(['10.0.0.' || (user_id % 256), CASE WHEN user_id % 3 <> 0 THEN 'u' || user_id END, 'GET ' || {_page} || ' HTTP/1.1', '200',
        CAST(event_id AS VARCHAR), CASE WHEN event_id % 2 = 0 THEN 'http://r/' END, CASE WHEN event_id % 2 = 0 THEN 'agent 1' END]) AS v FROM events)
    WHERE v IS NOT NULL""",
)

# ---------------------------------------------------------------- through the store


def stored(spark, d) -> DataFrame:
    """Create, load, delete, alter, compact and scan a table of the store, by statements where there is one."""
    from tessera.session import Session

    s = Session(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", clock=lambda: NOW)
    s.execute("CREATE TABLE MAX_VERSIONS=2 events (click, error, ACCESS GROUP slow BLOOMFILTER='rows' (purchase, signup), purchase, signup)")
    s.execute("ALTER TABLE events ADD (view MAX_VERSIONS=2) DROP (error)")
    found = events(spark, d).cells().filter("cf <> 'error'").select("row", "cf", "cq", "ts", "value")
    s.load("events", found)
    s.execute(f"DELETE * FROM events WHERE ROW = '{k(1)}' TIMESTAMP '2024-01-15 00:00:00'")
    s.execute(f"DELETE click, 'view:' FROM events WHERE ROW = '{k(2)}' TIMESTAMP '2024-01-20 00:00:00'")
    s.execute(f"INSERT INTO events VALUES ('2024-01-16 00:00:00', '{k(1)}', 'click:new', 'x'), ('2024-01-01 00:00:00', '{k(1)}', 'click:old', 'y')")
    s.store.table("events").compact()
    return shown(s.execute(f"SELECT click, purchase, view FROM events").cells)


_gone = f"(\"row\" = '{k(1)}' AND ts <= {fn.parse_datetime('2024-01-15')}) OR (\"row\" = '{k(2)}' AND cf IN ('click', 'view') AND ts <= {fn.parse_datetime('2024-01-20')})"
query("store_round_trip", stored, f"SELECT {_SHOW} FROM ({_RANKED.format(E)} WHERE cf IN ('click', 'purchase', 'view') AND NOT ({_gone})) WHERE age <= 2 UNION ALL SELECT '{k(1)}', 'click', 'new', {fn.parse_datetime('2024-01-16')}, 'x'")


# ---------------------------------------------------------------- entry points


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest two versions of each cell, deletes of all scopes applied."""
    return shown(events(spark, sf_dir).scan(ScanSpec(revs=2), markers=markers(spark, sf_dir)))


query("flagship", flagship, f"SELECT {_SHOW} FROM ({_RANKED.format(E)} WHERE {_ALL_SEEN}) WHERE age <= 2")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
