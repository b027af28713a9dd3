"""Statements and the programming interface over a store."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from itertools import groupby, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialect import parse, split_statements
from .dialect import statements as st
from .errors import BadKey, BadScan
from .model import DELETE_CELL, DELETE_FAMILY, DELETE_ROW, INSERT, Family, Group, Schema
from .operators import mutate
from .plans import CellInterval, RowInterval, ScanSpec
from .plans.planner import in_order
from .sources import sink, tsv
from .storage import Store, Table

HELP = {
    "select": "SELECT families|* FROM table [WHERE predicates] [REVS n] [LIMIT n] [INTO FILE 'f'] [DISPLAY_TIMESTAMPS] [RETURN_DELETES] [KEYS_ONLY] [NOESCAPE]",
    "insert": "INSERT INTO table VALUES (['time',] 'row', 'family[:qualifier]', 'value'), ...",
    "delete": "DELETE *|columns FROM table WHERE ROW = 'row' [TIMESTAMP 'time']",
    "load data infile": "LOAD DATA INFILE [ROW_KEY_COLUMN=..] [TIMESTAMP_COLUMN=..] [HEADER_FILE=..] [ROW_UNIQUIFY_CHARS=n] [DUP_KEY_COLS=..] [NOESCAPE] 'file' INTO TABLE table | INTO FILE file",
    "create table": "CREATE TABLE [options] table (family [MAX_VERSIONS=n] [TTL=duration], ..., ACCESS GROUP name [options] (families)) | CREATE TABLE table LIKE other",
    "alter table": "ALTER TABLE table ADD (definitions) DROP (families) ...",
    "drop table": "DROP TABLE [IF EXISTS] table",
    "describe table": "DESCRIBE TABLE [WITH IDS] table: its schema as XML",
    "show create table": "SHOW CREATE TABLE table: its schema as a statement",
    "show tables": "SHOW TABLES: the names of all tables",
    "update": "UPDATE table 'file': apply a script of mutations",
    "create scanner": "CREATE SCANNER ON table[start..end] [WHERE ..] [options], FETCH SCANBLOCK [id], DESTROY SCANNER [id]: a cursor",
}


@dataclass
class Result:
    """What a statement gives: ``lines`` of text, and for reads the cells as a DataFrame.

    ``rejected``: for loads, all lines that were left out, with the reason.
    """

    lines: list[str] = field(default_factory=list)
    cells: DataFrame | None = None
    rendered: DataFrame | None = None
    scanner: int | None = None
    mutator: int | None = None
    rejected: DataFrame | None = None

    def text(self) -> list[str]:
        """All lines; those of a read are brought to the driver, so ask for what fits there."""
        return self.lines + ([r[0] for r in self.rendered.toLocalIterator()] if self.rendered is not None else [])


class Session:
    """Runs statements against a store; also the calls that programs make."""

    #: Cells that a cursor gives at once.
    CHUNK = 100
    #: Lines left out by a load that its report shows.
    SHOWN = 100

    def __init__(self, spark: SparkSession, root: str, clock=None, raw_timestamps: bool = False):
        """``raw_timestamps``: reads display times as numbers of nanoseconds."""
        self.spark, self.raw_timestamps = spark, raw_timestamps
        self.store = Store(spark, root, clock) if clock else Store(spark, root)
        self._cursors: dict[int, Cursor] = {}
        self._mutators: dict[int, Mutator] = {}
        self._next_cursor = self._next_mutator = 0

    # -- statements

    def execute(self, text: str, noflush: bool = False, unbuffered: bool = False) -> Result:
        """``noflush``: what an INSERT or DELETE writes stays with a mutator, whose number comes back.

        ``unbuffered``: a SELECT gives a scanner's number instead of its cells.  Other statements
        don't heed them: loads commit whole frames, and reads INTO FILE hold nothing.
        """
        statement = parse(text)
        if noflush and isinstance(statement, st.Insert | st.Delete):
            number = self.open_mutator(statement.table)
            self._mutator(number).hold(self._rows(statement))
            return Result(mutator=number)
        if unbuffered and isinstance(statement, st.Select) and not statement.into:
            return Result(scanner=self.open_scanner(self.scan(statement.table, statement.spec)))
        kind = type(statement).__name__
        return getattr(self, f"_{kind}")(statement)

    def run(self, script: str) -> list[Result]:
        return [self.execute(s) for s in split_statements(script)]

    def _Select(self, s: st.Select) -> Result:
        cells = self.scan(s.table, s.spec)
        lines = sink.rendered(cells, s.display_timestamps, s.spec.keys_only, s.escape, self.raw_timestamps)
        if s.into:
            sink.write_lines(lines, s.into, sink.header(s.display_timestamps, s.spec.keys_only))
            return Result(cells=cells)
        return Result(cells=cells, rendered=lines)

    def _rows(self, s: st.Insert | st.Delete) -> list[tuple]:
        schema = self.store.table(s.table).schema
        if isinstance(s, st.Insert):
            return [mutate.insert(schema, row, column, value, ts) for ts, row, column, value in s.values]
        # a marker hides what is older than it; one more nanosecond takes the given time in
        ts = None if s.ts is None else s.ts + 1
        return [mutate.marker(schema, s.row, c, ts) for c in s.columns or (None,)]

    def _Insert(self, s: st.Insert) -> Result:
        self.put(s.table, self._rows(s))
        return Result()

    def _Delete(self, s: st.Delete) -> Result:
        self.put(s.table, self._rows(s))
        return Result()

    def _CreateTable(self, s: st.CreateTable) -> Result:
        if s.like:
            old = self.store.table(s.like).schema
            families = [replace(f, id=0, generation=1) for f in old.live()]
            live = {f.name for f in families}
            groups = [replace(g, families=tuple(n for n in g.families if n in live)) for g in old.groups]
            schema = Schema.define(families, groups, old.compressor)
        else:
            schema = Schema.define(list(s.families), list(s.groups), s.compressor, s.in_memory, s.blocksize, s.ttl, s.max_versions)
        self.store.create(s.table, schema)
        return Result()

    def _AlterTable(self, s: st.AlterTable) -> Result:
        self.store.alter(s.table, self.store.table(s.table).schema.alter(list(s.steps)))
        return Result()

    def _DropTable(self, s: st.DropTable) -> Result:
        self.store.drop(s.table, s.if_exists)
        return Result()

    def _Describe(self, s: st.Describe) -> Result:
        return Result(self.get_schema(s.table, s.with_ids).splitlines())

    def _ShowCreate(self, s: st.ShowCreate) -> Result:
        return Result(self.store.table(s.table).schema.to_ddl(s.table).splitlines())

    def _ShowTables(self, s: st.ShowTables) -> Result:
        return Result(self.store.tables())

    def _Help(self, s: st.Help) -> Result:
        topic = s.topic.lower().strip()
        return Result([v for k, v in HELP.items() if not topic or k.startswith(topic)] or [f"no help for '{s.topic}'"])

    def _LoadData(self, s: st.LoadData) -> Result:
        source = self._stdin(s.source) if s.source == "-" else s.source
        lines, names = source if isinstance(source, tuple) else tsv.read_lines(self.spark, source, s.options.header_file)
        cells, bad = tsv.cells_of(lines, names, s.options)
        if s.into:
            timed = F.col("ts").isNotNull()
            line = F.concat_ws("\t", F.when(timed, F.col("ts").cast("string")), "row", sink.column_text(), sink.escape(F.col("value")))
            given = bool(s.options.timestamp_column) or names[0] == "timestamp"
            sink.write_lines(cells.select(line.alias("line")), s.into, sink.header(given))
        else:
            self.load(s.table, cells)
        return self._report(bad)

    def _report(self, bad: DataFrame) -> Result:
        """How many lines were left out, the first of them, and all as a DataFrame."""
        first = bad.limit(self.SHOWN + 1).collect()
        report = [f"{r.reason}: {r.line}" for r in first[: self.SHOWN]]
        if len(first) > self.SHOWN:
            report.append(f"{bad.count()} lines were left out")
        return Result(report, rejected=bad)

    def _stdin(self, _) -> tuple[DataFrame, list[str]]:
        """Standard input goes to a file of the store a piece at a time, for executors to read."""
        first, path = sys.stdin.readline(), f"{self.store.root}/stdin/{uuid.uuid4().hex}"
        self.store.files.write(path, iter(lambda: sys.stdin.read(1 << 20), ""))
        return self.spark.read.text(path), tsv.header_of(first)

    def _Update(self, s: st.Update) -> Result:
        good, bad = tsv.read_script(self.spark.read.text(s.source))
        self.load(s.table, good)
        return self._report(bad)

    def _CreateScanner(self, s: st.CreateScanner) -> Result:
        cells = self.scan(s.table, s.spec if s.spec.rows or s.spec.cells else replace(s.spec, rows=(s.range,)))
        if s.spec.rows or s.spec.cells:
            low, high = s.range.start, s.range.end
            cells = cells.filter(F.lit(low is None) | (F.col("row") > F.lit(low or ""))).filter(F.lit(high is None) | (F.col("row") <= F.lit(high or "")))
        return Result(scanner=self.open_scanner(cells))

    def _FetchScanblock(self, s: st.FetchScanblock) -> Result:
        block = self.next_cells(s.scanner)
        return Result(["\t".join(map(str, (c.ts, c.row, c.cf + (":" + c.cq if c.cq else ""), (c.value or b"").decode() if c.flag == 255 else sink.MARKER))) for c in block])

    def _DestroyScanner(self, s: st.DestroyScanner) -> Result:
        self.close_scanner(s.scanner)
        return Result()

    def _Dump(self, s: st.Dump) -> Result:
        listing = []
        for name in self.store.tables():
            for segment in self.store.table(name).manifest().segments:
                listing.append(f"{name}\t{segment.path}\t{segment.cells}" + (f"\t{segment.min_row}\t{segment.max_row}" if s.keys else ""))
        sink.write_lines(self.spark.createDataFrame([(x,) for x in listing], "line string"), s.path, "#table\tsegment\tcells" + "\tfirst\tlast" * s.keys)
        return Result(listing)

    def _Administrative(self, s: st.Administrative) -> Result:
        return Result([f"{s.what}: nothing to do, Spark runs no servers of ours"])

    # -- tables

    def create_table(self, name: str, schema: Schema | str) -> Table:
        """``schema``: a Schema, or its XML form."""
        return self.store.create(name, Schema.from_xml(schema) if isinstance(schema, str) else schema)

    def open_table(self, name: str) -> Table:
        """The table with its schema of now; opening it again refreshes that."""
        return self.store.table(name)

    def alter_table(self, name: str, schema: Schema | str) -> Table:
        """Follow the schema by ``schema``, of the next generation: a Schema that ``alter`` made, or its XML form."""
        return self.store.alter(name, Schema.from_xml(schema) if isinstance(schema, str) else schema)

    def drop_table(self, name: str, if_exists: bool = False) -> bool:
        return self.store.drop(name, if_exists)

    def get_tables(self) -> list[str]:
        return self.store.tables()

    def get_table_id(self, name: str) -> int:
        return self.store.table(name).id

    def get_schema(self, name: str, with_ids: bool = False) -> str:
        return self.store.table(name).schema.to_xml(with_ids)

    # -- reading

    def scan(self, name: str, spec: ScanSpec = ScanSpec(), now_ns: int | None = None) -> DataFrame:
        return self.store.table(name).scan(spec, now_ns)

    def get_row(self, name: str, row: str) -> list:
        """The newest version of each of a row's cells."""
        return in_order(self.scan(name, ScanSpec(rows=(RowInterval(row, True, row, True),), revs=1))).collect()

    def get_cell(self, name: str, row: str, column: str) -> bytes | None:
        if ":" not in column:
            column += ":"
        found = self.scan(name, ScanSpec(cells=(CellInterval((row, column), True, (row, column), True),), revs=1)).collect()
        return bytes(found[0].value) if found else None

    def get_cells(self, name: str, spec: ScanSpec = ScanSpec()) -> list:
        """All cells of a scan, on the driver; for small ones."""
        return in_order(self.scan(name, spec)).collect()

    def iter_cells(self, cells: DataFrame, n: int = CHUNK) -> Iterator[list]:
        """Blocks of cells in order; one partition at a time is on the driver."""
        source = iter(in_order(cells).toLocalIterator())
        while block := list(islice(source, n)):
            yield block

    def rows(self, cells: DataFrame) -> Iterator[tuple[str, list]]:
        """Each row's cells together."""
        for row, group in groupby(in_order(cells).toLocalIterator(), key=lambda c: c.row):
            yield row, list(group)

    def next_row(self, scanner: int | None = None) -> list:
        """The cells of the scanner's next row, or of what blocks left of it; empty at the end."""
        return self._cursor(scanner).row()

    def as_arrays(self, cells: list) -> list[tuple[str, ...]]:
        """Cells as five strings: row, family, qualifier, value, time."""
        return [(c.row, c.cf, c.cq, (c.value or b"").decode(), str(c.ts)) for c in cells]

    def open_scanner(self, cells: DataFrame, n: int = CHUNK) -> int:
        self._next_cursor += 1
        self._cursors[self._next_cursor] = Cursor(in_order(cells).toLocalIterator(), n)
        return self._next_cursor

    def next_cells(self, scanner: int | None = None) -> list:
        """The next block, empty at the end; of the scanner opened last by default."""
        return self._cursor(scanner).block()

    def close_scanner(self, scanner: int | None = None) -> None:
        self._cursor(scanner)
        del self._cursors[self._next_cursor if scanner is None else scanner]

    def _cursor(self, scanner: int | None) -> Cursor:
        key = self._next_cursor if scanner is None else scanner
        if key not in self._cursors:
            raise BadScan(f"no scanner {key}")
        return self._cursors[key]

    # -- writing

    def put(self, name: str, rows: list[tuple]) -> None:
        """Commit cells made by ``mutate.insert`` and ``mutate.marker``, in their order."""
        self.store.table(name).put(rows)

    def load(self, name: str, cells: DataFrame) -> None:
        """Commit a frame ``(row, cf, value[, cq, ts, flag])`` of any size."""
        table = self.store.table(name)
        table.append(mutate.checked(cells, table.schema), stamp=True)

    def delete(self, name: str, row: str, columns: tuple[str, ...] = (), ts: int | None = None) -> None:
        schema = self.store.table(name).schema
        self.put(name, [mutate.marker(schema, row, c, ts) for c in columns or (None,)])

    @contextmanager
    def mutator(self, name: str, flush_cells: int = 10_000):
        """Buffers ``set(row, column, value[, ts])``, ``set_delete(row[, column][, ts])``; commits when full and at the end."""
        m = Mutator(self, name, flush_cells)
        yield m
        m.flush()

    def open_mutator(self, name: str, flush_cells: int = 10_000) -> int:
        """A mutator that is named by a number, for callers that can't hold one; close it."""
        self._next_mutator += 1
        self._mutators[self._next_mutator] = Mutator(self, name, flush_cells)
        return self._next_mutator

    def set_cell(self, mutator: int, cell: tuple) -> None:
        self.set_cells(mutator, [cell])

    def set_cells(self, mutator: int, cells: list[tuple]) -> None:
        """Cells in array form; see :meth:`Mutator.set_cells`."""
        self._mutator(mutator).set_cells(cells)

    def flush_mutator(self, mutator: int) -> None:
        self._mutator(mutator).flush()

    def close_mutator(self, mutator: int, flush: bool = True) -> None:
        """Forget the mutator; without ``flush`` what it holds is lost."""
        held = self._mutator(mutator)
        del self._mutators[mutator]
        if flush:
            held.flush()

    def _mutator(self, mutator: int) -> Mutator:
        if mutator not in self._mutators:
            raise BadKey(f"no mutator {mutator}")
        return self._mutators[mutator]


class Cursor:
    """A place in an ordered scan; one partition at a time is on the driver."""

    def __init__(self, cells: Iterator, n: int):
        self.cells, self.n, self.ahead = iter(cells), n, []

    def block(self) -> list:
        held, self.ahead = self.ahead, []
        return held + list(islice(self.cells, self.n - len(held)))

    def row(self) -> list:
        found = self.ahead or list(islice(self.cells, 1))
        self.ahead = []
        for c in self.cells if found else ():
            if c.row != found[0].row:
                self.ahead = [c]  # the next row's first
                break
            found.append(c)
        return found


class Mutator:
    """Buffered cells of a table.  ``failed``: those of flushes that gave up, with the error; ``retry`` takes them up again."""

    def __init__(self, session: Session, name: str, flush_cells: int):
        self.session, self.name, self.size = session, name, flush_cells
        self.schema, self.held = session.store.table(name).schema, []
        self.failed: list[tuple[tuple, str]] = []

    def set(self, row: str, column: str, value: str | bytes, ts: int | None = None) -> None:
        self.hold([mutate.insert(self.schema, row, column, value, ts)])

    def set_delete(self, row: str, column: str | None = None, ts: int | None = None) -> None:
        self.hold([mutate.marker(self.schema, row, column, ts)])

    def set_cells(self, cells: list[tuple]) -> None:
        """Array form: ``(row[, family[, qualifier[, value[, time[, revision[, flag]]]]]])`` as strings.

        No family makes a row marker.  Revisions are given at the commit, so one that
        is named is passed over; a flag other than that of inserts makes a marker.
        """
        for cell in cells:
            if not 1 <= len(cell) <= 7:
                raise BadKey(f"a cell has 1 to 7 parts, not {len(cell)}")
            row, family, qualifier, value, ts, _, flag = (*cell, *[None] * (7 - len(cell)))
            at = None if ts in (None, "") else int(ts)
            kind = INSERT if flag in (None, "") else int(flag)
            if not family or kind == DELETE_ROW:
                self.set_delete(row, None, at)
            elif kind == DELETE_FAMILY:
                self.set_delete(row, family, at)
            elif kind == DELETE_CELL:
                self.set_delete(row, f"{family}:{qualifier or ''}", at)
            elif kind == INSERT:
                self.set(row, family + (f":{qualifier}" if qualifier else ""), value or "", at)
            else:
                raise BadKey(f"no such flag: {kind}")

    def hold(self, cells: list[tuple]) -> None:
        """Buffer cells made by ``mutate.insert`` and ``mutate.marker``; commits when full."""
        self.held += cells
        if len(self.held) >= self.size:
            self.flush()

    def flush(self) -> None:
        """Commit what is held, in one piece.  Where that fails for good it is in ``failed``, and the error is raised."""
        held, self.held = self.held, []
        try:
            self.session.put(self.name, held)
        except Exception as e:
            self.failed += [(cell, str(e)) for cell in held]
            raise

    def retry(self) -> None:
        """Commit ``failed`` before what is held."""
        again, self.failed = [cell for cell, _ in self.failed], []
        self.held = again + self.held
        self.flush()


__all__ = ["Family", "Group", "Result", "Session"]
