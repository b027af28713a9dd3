import gzip
import io
from pathlib import Path

import pytest

from tessera import errors as e
from tessera.functions import parse_datetime
from tessera.model import Family, Group, Schema
from tessera.operators import mutate
from tessera.plans import RowInterval, ScanSpec
from tessera.session import Session
from tessera.shell import Shell
from tessera.sources import tsv

NOW = parse_datetime("2024-02-01")


class Clock:
    def __init__(self):
        self.now = NOW

    def __call__(self):
        self.now += 1000
        return self.now


@pytest.fixture
def s(spark, tmp_path):
    return Session(spark, f"file://{tmp_path}/store", Clock())


def lines(s, text):
    return s.execute(text).text()


def test_deletes_of_each_scope(s):
    """A sensor's readings: one is taken back at its exact time, then a family, then the whole row."""
    s.execute("CREATE TABLE sensors (humidity, temp)")
    put = "INSERT INTO sensors VALUES ('2024-01-05 10:00:0{}', '{}', '{}', '{}')"
    for second, row, column, value in ((0, "attic", "humidity:north", "41"), (1, "attic", "humidity:south", "44"), (2, "attic", "humidity:roof", "47"), (3, "attic", "temp:north", "18"), (4, "attic", "temp:south", "21"), (5, "cellar", "temp:floor", "9")):
        s.execute(put.format(second, row, column, value))
    attic = ["attic\thumidity:north\t41", "attic\thumidity:roof\t47", "attic\thumidity:south\t44", "attic\ttemp:north\t18", "attic\ttemp:south\t21"]
    assert lines(s, "SELECT * FROM sensors") == [*attic, "cellar\ttemp:floor\t9"]
    s.execute("DELETE 'humidity:south' FROM sensors WHERE ROW = 'attic' TIMESTAMP '2024-01-05 10:00:01'")
    shown = lines(s, "select humidity from sensors where row = 'attic' display_timestamps")
    assert shown == ["2024-01-05 10:00:00.000000000\tattic\thumidity:north\t41", "2024-01-05 10:00:02.000000000\tattic\thumidity:roof\t47"]
    s.execute("delete temp from sensors where row = 'attic'")
    assert lines(s, "select temp from sensors") == ["cellar\ttemp:floor\t9"]
    assert lines(s, "select * from sensors where cell = 'attic','temp:south'") == []
    assert lines(s, "select * from sensors where row = 'attic' return_deletes") == ["attic\thumidity:north\t41", "attic\thumidity:roof\t47", "attic\thumidity:south\t\tDELETE", "attic\ttemp\t\tDELETE"]
    s.execute("delete * from sensors where row = 'attic'")
    assert lines(s, "select * from sensors keys_only") == ["cellar"]
    s.store.table("sensors").compact()
    assert lines(s, "select * from sensors return_deletes") == ["cellar\ttemp:floor\t9"]


def test_intervals_and_times(s):
    s.execute("CREATE TABLE stops (line, zone)")
    rows = ["k10", "k12", "k2", "k25", "k3", "m1", "m11", "p"]
    s.execute("INSERT INTO stops VALUES " + ", ".join(f"('2024-01-08 06:3{n}:00', '{r}', 'zone', 'z{n}')" for n, r in enumerate(rows)))
    got = lambda where: [x.split("\t")[0] for x in lines(s, f"SELECT * FROM stops WHERE {where}")]
    assert got("('k10' < ROW <= 'k2')") == ["k12", "k2"] and got("ROW =^ 'k2'") == ["k2", "k25"]
    assert got("('k12' < ROW <= 'k3' or ROW = 'm1' or ROW = 'k3')") == ["k2", "k25", "k3", "m1", "k3"]
    assert got("ROW > 'm1' AND ROW < 'k2'") == ["m11", "p", "k10", "k12"]  # a union, in the order of the statement
    window = "'2024-01-08 06:31:00' {} TIMESTAMP {} '2024-01-08 06:35:00'"
    for low, high, want in (("<=", "<=", 5), ("<=", "<", 4), ("<", "<=", 4), ("<", "<", 3)):
        assert len(got(f"('k' <= ROW <= 'z') and {window.format(low, high)}")) == want
        assert len(got(f"{window.format(low, high)} and ('k' <= ROW <= 'z')")) == want
    assert got("TIMESTAMP = '2024-01-08 06:34:00'") == got("'2024-01-08 06:34:00' = TIMESTAMP") == ["k3"]
    s.execute("DELETE * FROM stops WHERE ROW = 'k10'")
    assert got("TIMESTAMP < '2024-01-08 06:32:00'") == ["k12"]  # a newer delete hides too
    assert lines(s, "SELECT * FROM stops LIMIT 2 KEYS_ONLY") == ["k12", "k2"]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM t WHERE ('z' < ROW < 'a')", "SELECT x FROM t", "SELECT * FROM t WHERE ROW = 'a' AND CELL = 'a','c'", "SELECT * FROM t LIMIT 1 LIMIT 2", "SELECT * FROM t REVS 1 REVS 2",
        "SELECT * FROM t WHERE TIMESTAMP =^ '2008-01-01'", "SELECT * FROM t WHERE TIMESTAMP < '12:00:00'", "SELECT * FROM nowhere", "INSERT INTO t VALUES ('r', 'x', 'v')", "INSERT INTO 't' VALUES ('r', 'c', 'v')", "INSERT INTO t VALUES ('r', 'c', '')",
        "DELETE c FROM t WHERE ROW > 'r'", "DELETE x FROM t WHERE ROW = 'r'", "CREATE TABLE t (c)", "CREATE TABLE u (c, c)", "CREATE TABLE u (c, ACCESS GROUP g (d))", "ALTER TABLE t DROP (x)", "ALTER TABLE t ADD (c)", "DROP TABLE nowhere", "SELECT group FROM t", "EXPLAIN t",
    ],
)
def test_errors(s, text):
    s.execute("CREATE TABLE t (c, b)")
    with pytest.raises(e.TableError):
        s.execute(text)


def test_versions_survive_deletes(s):
    s.execute("CREATE TABLE t (f MAX_VERSIONS=1)")
    for n in range(4):
        s.execute(f"INSERT INTO t VALUES ('r', 'f', 'v{n}')")
        assert lines(s, "SELECT * FROM t") == [f"r\tf\tv{n}"]
        s.execute("DELETE f FROM t WHERE ROW = 'r'")
        assert lines(s, "SELECT * FROM t") == []
    s.execute("INSERT INTO t VALUES ('r', 'f', 'x'), ('r', 'f', 'y')")
    assert lines(s, "SELECT * FROM t REVS 5") == ["r\tf\ty"]
    s.execute("CREATE TABLE u (f MAX_VERSIONS=2)")
    s.execute("INSERT INTO u VALUES ('r', 'f', 'x'), ('r', 'f', 'y'), ('r', 'f', 'z')")
    assert lines(s, "SELECT * FROM u") == ["r\tf\tz", "r\tf\ty"] and lines(s, "SELECT * FROM u MAX_VERSIONS = 1") == ["r\tf\tz"]


def test_ttl_by_the_clock(s):
    s.execute("CREATE TABLE t (short TTL=3 SECONDS, long TTL=1 MINUTE, ever)")
    s.execute("INSERT INTO t VALUES ('r', 'short', '1'), ('r', 'long', '2'), ('r', 'ever', '3')")
    assert len(lines(s, "SELECT * FROM t")) == 3
    s.store.clock.now += 5 * 10**9
    assert lines(s, "SELECT * FROM t") == ["r\tlong\t2", "r\tever\t3"]
    s.store.clock.now += 60 * 10**9
    s.store.table("t").compact()
    assert lines(s, "SELECT * FROM t") == ["r\tever\t3"]


def test_alter(s):
    s.execute("CREATE TABLE Planets ('mean-radius', 'moons', ACCESS GROUP size ('mean-radius'), ACCESS GROUP around ('moons'))")
    s.execute('INSERT INTO Planets VALUES ("mars", "mean-radius", "3390"), ("mars", "moons", "2")')
    s.execute("ALTER TABLE Planets ADD ('Orbit', ACCESS GROUP path ('Orbit')) DROP ('moons')")
    s.execute('INSERT INTO Planets VALUES ("mars", "Orbit", "687 d")')
    assert lines(s, "SELECT * FROM Planets") == ["mars\tmean-radius\t3390", "mars\tOrbit\t687 d"]
    s.execute("ALTER TABLE Planets ADD ('Rings') DROP ('Orbit') ADD ('Mass', ACCESS GROUP weight ('Mass'))")
    with pytest.raises(e.SchemaError):  # a dropped name stays taken
        s.execute("ALTER TABLE Planets ADD ('Orbit')")
    more = lambda a, b: "(" + ", ".join(f"'probe{k}'" for k in range(a, b)) + ")"
    s.execute(f"ALTER TABLE Planets ADD {more(0, 250)}")
    s.execute(f"ALTER TABLE Planets DROP {more(0, 250)}")
    with pytest.raises(e.SchemaError):  # dropped ones count
        s.execute("ALTER TABLE Planets ADD ('last')")
    schema = s.store.table("Planets").schema
    assert schema.generation == 5 and [f.id for f in schema.families] == list(range(1, 256))
    xml = s.get_schema("Planets", True)
    assert '<Schema generation="5">' in xml and "<deleted>true</deleted>" in xml and Schema.from_xml(xml).to_xml(True) == xml
    assert lines(s, "DESCRIBE TABLE WITH IDS Planets") == xml.splitlines() and "Generation" not in s.get_schema("Planets")


def test_ddl(s):
    s.execute("CREATE TABLE IN_MEMORY BLOCKSIZE=4096 TTL=2 WEEKS MAX_VERSIONS=5 Books (title TTL=3 HOURS, author MAX_VERSIONS=1, year, ACCESS GROUP people BLOCKSIZE=8192 (author))")
    want = ["", "CREATE TABLE Books (", "  author MAX_VERSIONS=1 TTL=1209600,", "  title MAX_VERSIONS=5 TTL=10800,", "  year MAX_VERSIONS=5 TTL=1209600,", "  ACCESS GROUP people IN_MEMORY BLOCKSIZE=8192 (author),", "  ACCESS GROUP default IN_MEMORY BLOCKSIZE=4096 (title, year)", ")"]
    assert lines(s, "SHOW CREATE TABLE Books") == want
    s.execute("CREATE TABLE shelf LIKE Books")
    assert lines(s, "SHOW CREATE TABLE shelf")[2:] == want[2:] and lines(s, "SHOW TABLES") == ["Books", "shelf"]
    s.execute("DROP TABLE IF EXISTS shelf")
    s.execute("DROP TABLE IF EXISTS shelf")
    assert s.get_tables() == ["Books"] and s.get_table_id("Books") == 1
    assert lines(s, "HELP select") and len(lines(s, "?")) > 5


def test_into_file(s, tmp_path):
    s.execute("CREATE TABLE t (c)")
    s.execute("INSERT INTO t VALUES ('r', 'c:q', 'a\tb'), ('q', 'c', 'x')")
    s.execute(f"SELECT * FROM t INTO FILE '{tmp_path}/out.gz'")
    assert sorted(x.name for x in tmp_path.iterdir() if "out" in x.name) == [".out.gz.crc", "out.gz"]
    assert gzip.decompress(Path(f"{tmp_path}/out.gz").read_bytes()).decode() == "#row\tcolumn\tvalue\nq\tc\tx\nr\tc:q\ta\\tb\n"


def test_load_and_update(s, tmp_path):
    Path(f"{tmp_path}/a.tsv").write_text("# rowkey\tc\td:x\nk1\tv1\t\nk2\tNULL\tw\\ny\nk3\n")
    s.execute("CREATE TABLE t (c, d)")
    assert s.execute(f"LOAD DATA INFILE ROW_KEY_COLUMN=rowkey '{tmp_path}/a.tsv' INTO TABLE t").lines == []
    assert lines(s, "SELECT * FROM t") == ["k1\tc\tv1", "k2\td:x\tw\\ny"]
    s.execute(f"LOAD DATA INFILE 'file://{tmp_path}/a.tsv' INTO FILE '{tmp_path}/b'")
    assert Path(f"{tmp_path}/b").read_text() == "#row\tcolumn\tvalue\nk1\tc\tv1\nk2\td:x\tw\\ny\n"
    Path(f"{tmp_path}/script").write_text("AUTO\tk9\tc:q\tnew\nAUTO\tk1\tDELETE\nAUTO\tk2\td:x\tDELETE\nbad line\nx\tk\tc\tv\n")
    report = s.execute(f"UPDATE t '{tmp_path}/script'")
    assert sorted(report.lines) == ["bad timestamp: x\tk\tc\tv", "too few fields: bad line"] and report.rejected.count() == 2
    assert lines(s, "SELECT * FROM t") == ["k9\tc:q\tnew"]


def test_cursors_and_calls(s):
    s.create_table("t", Schema.define([Family("c"), Family("d")], [Group("g", ("d",))]).to_xml())
    with s.mutator("t", flush_cells=3) as m:
        for n in range(7):
            m.set(f"r{n}", "c:q", f"v{n}")
        m.set_cells([("r1", "d", "", "array", "5"), ("r0",)])
        m.set_delete("r2", "c:q")
    assert s.get_cell("t", "r1", "c:q") == b"v1" and s.get_cell("t", "r2", "c:q") is None and s.get_row("t", "r0") == []
    assert s.as_arrays(s.get_row("t", "r1"))[0] == ("r1", "d", "", "array", "5")
    assert [(row, len(cells)) for row, cells in s.rows(s.scan("t"))] == [("r1", 2), ("r3", 1), ("r4", 1), ("r5", 1), ("r6", 1)]
    assert [len(b) for b in s.iter_cells(s.scan("t"), 4)] == [4, 2]
    scanner = s.execute("CREATE SCANNER ON t[r1..r4] REVS 1").scanner
    block = s.execute(f"FETCH SCANBLOCK {scanner}").lines
    assert [x.split("\t")[1] for x in block] == ["r3", "r4"] and s.execute("FETCH SCANBLOCK").lines == []
    s.execute("DESTROY SCANNER")
    with pytest.raises(e.BadScan):
        s.execute("FETCH SCANBLOCK")
    assert [c.row for c in s.get_cells("t", ScanSpec(rows=(RowInterval("r5"),)))] == ["r5", "r6"]
    with pytest.raises(e.BadKey):
        mutate.insert(s.store.table("t").schema, "", "c", "v")
    with pytest.raises(Exception, match="bad key"):
        s.load("t", s.spark.createDataFrame([("r", "nofamily", "v")], "row string, cf string, value string"))


def test_snapshots_conflicts_and_vacuum(s):
    s.execute("CREATE TABLE t (c)")
    s.execute("INSERT INTO t VALUES ('r', 'c', 'old')")
    table = s.store.table("t")
    rev = table.manifest().next_rev - 1
    s.execute("INSERT INTO t VALUES ('r', 'c', 'new')")
    assert bytes(s.scan("t", ScanSpec(as_of=rev, revs=1)).first().value) == b"old"
    seen, data = table._versions.load()
    table._versions.commit(seen, data)
    with pytest.raises(e.Conflict):
        table._versions.commit(seen, data)
    old = s.store.table("t").schema
    s.store.alter("t", old.alter([("add", (Family("d"),), ())]))
    with pytest.raises(e.Conflict):
        s.store.alter("t", old.alter([("add", (Family("e"),), ())]))
    table = s.store.table("t")
    table.compact(major=False)
    assert len(table.manifest().segments) == 1 and len(table.vacuum()) == 2
    assert lines(s, "SELECT * FROM t") == ["r\tc\tnew", "r\tc\told"]
    assert not table.maintain()


def test_groups_and_segments_are_skipped(s):
    s.execute("CREATE TABLE t (c, d, ACCESS GROUP g COMPRESSOR='zlib' BLOOMFILTER='rows --false-positive 0.01' (d))")
    s.execute("INSERT INTO t VALUES ('a', 'c', '1'), ('a', 'd', '2')")
    s.execute("INSERT INTO t VALUES ('x', 'c', '3')")
    table = s.store.table("t")
    files = lambda spec: table.scan(spec).inputFiles()
    assert all("ag=g/" in f for f in files(ScanSpec(families=("d",)))) and len(files(ScanSpec(rows=(RowInterval("w"),)))) == 1
    assert len(files(ScanSpec())) == 3 and any(f.endswith(".gz.parquet") for f in files(ScanSpec()))


def test_shell(s, tmp_path):
    Path(f"{tmp_path}/more").write_text("print from a file;")
    out = io.StringIO()
    shell = Shell(s, out, test_mode=True)
    assert not shell.run(f"# comment; no\ncreate table t (c);\ninsert into t values ('r', 'c', 'a;b');\nselect * from t;\nselect * from u;\nsource {tmp_path}/more;\nstatus;\nquit;\nprint never;")
    text = out.getvalue()
    assert "r\tc\ta;b" in text and "Error: table 'u' does not exist" in text and "from a file" in text and "1 tables" in text and "never" not in text


def test_stamps_follow_the_order_of_lines(s, tmp_path):
    """Lines of several files and partitions: a marker hides what stands before it only, and revisions have no gaps."""
    (tmp_path / "in").mkdir()
    first = [f"AUTO\ta{n}\tc\told" for n in range(10)] + [f"AUTO\ta{n}\tDELETE" for n in range(0, 10, 2)]
    second = [f"AUTO\ta{n}\tc\tnew" for n in range(0, 10, 4)]
    for name, text in (("1", first), ("2", second)):
        Path(f"{tmp_path}/in/{name}").write_text("\n".join(text) + "\n")
    s.execute("CREATE TABLE t (c)")
    good, _ = tsv.read_script(s.spark.read.text(f"{tmp_path}/in/1").union(s.spark.read.text(f"{tmp_path}/in/2")))
    assert good.rdd.getNumPartitions() == 2
    s.load("t", good)
    assert lines(s, "SELECT * FROM t") == sorted([f"a{n}\tc\told" for n in range(1, 10, 2)] + [f"a{n}\tc\tnew" for n in range(0, 10, 4)])
    stored = s.store.table("t").cells().select("rev", "ts").collect()
    assert sorted(r.rev for r in stored) == list(range(1, 19)) and len({r.ts for r in stored}) == 18
    assert s.store.table("t").manifest().next_rev == 19
    s.execute("INSERT INTO t VALUES ('z', 'c', 'later')")
    assert s.store.table("t").manifest().next_rev == 20 and s.store.files.names(f"{s.store.table('t').folder}/aside") == []


def test_two_writers(s, monkeypatch):
    """Of two commits after the same version one is made again; a writer that is always late gives up and says what it holds."""
    s.execute("CREATE TABLE t (c)")
    table = s.store.table("t")
    real, other = type(table._versions).commit, {"left": 1}

    def late(versions, seen, value):
        if other["left"] and "manifest" in versions.folder:
            other["left"] -= 1
            real(versions, seen, versions.load()[1])  # somebody else is first
        real(versions, seen, value)

    monkeypatch.setattr(type(table._versions), "commit", late)
    s.load("t", s.spark.createDataFrame([("r", "c", "v")], "row string, cf string, value string"))
    assert lines(s, "SELECT * FROM t") == ["r\tc\tv"]
    with s.mutator("t") as m:
        m.set("q", "c", "w")
        other["left"] = 99
        with pytest.raises(e.Conflict):
            m.flush()
        assert [cell[0] for cell, _ in m.failed] == ["q"] and len(lines(s, "SELECT * FROM t")) == 1
        other["left"] = 0
        m.retry()
        assert not m.failed
    assert lines(s, "SELECT * FROM t") == ["q\tc\tw", "r\tc\tv"]
    assert len(s.store.files.names(f"{table.folder}/segments")) == 2


def test_many_writers_of_one_number(s):
    """Of threads that write the same numbered file one succeeds."""
    from concurrent.futures import ThreadPoolExecutor

    def write(n):
        try:
            s.store.files.create(f"{s.store.root}/race/1.json", str(n))
            return n
        except e.Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [n for n in pool.map(write, range(16)) if n is not None]
    assert len(won) == 1 and s.store.files.read(f"{s.store.root}/race/1.json") == str(won[0])
    assert s.store.files.names(f"{s.store.root}/race") == ["1.json"]


def test_compaction_goes_by_the_manifest(s, monkeypatch):
    from tessera import storage
    from tessera.operators import visibility

    s.execute("CREATE TABLE t (c)")
    monkeypatch.setattr(storage, "MAX_SEGMENTS", 3)
    for n in range(5):
        s.execute(f"INSERT INTO t VALUES ('r{n}', 'c', 'v')")
    table = s.store.table("t")
    assert len(table.manifest().segments) <= 3 and len(lines(s, "SELECT * FROM t")) == 5
    plan = visibility.major(table.cells(), table.schema.live(), 0, has_deletes=False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_standard_input(s, monkeypatch):
    s.execute("CREATE TABLE t (c)")
    monkeypatch.setattr("sys.stdin", io.StringIO("row\tc\nr1\tx\nr2\ty\n"))
    s.execute("LOAD DATA INFILE '-' INTO TABLE t")
    assert lines(s, "SELECT * FROM t") == ["r1\tc\tx", "r2\tc\ty"]


def test_long_reports_say_how_many(s, tmp_path):
    Path(f"{tmp_path}/bad").write_text("row\tc\n" + "NULL\tx\n" * 130)
    s.execute("CREATE TABLE t (c)")
    report = s.execute(f"LOAD DATA INFILE '{tmp_path}/bad' INTO TABLE t")
    assert len(report.lines) == 101 and report.lines[-1] == "130 lines were left out" and report.rejected.count() == 130


def test_statements_left_to_mutators_and_scanners(s):
    s.execute("CREATE TABLE t (f)")
    m = s.execute("INSERT INTO t VALUES ('r1', 'f', 'x'), ('r2', 'f:q', 'y')", noflush=True).mutator
    assert s.execute("SELECT * FROM t").text() == []
    s.flush_mutator(m)
    scanner = s.execute("SELECT * FROM t", unbuffered=True).scanner
    assert [c.row for c in s.next_cells(scanner)] == ["r1", "r2"] and s.next_cells(scanner) == []
    gone = s.execute("DELETE f FROM t WHERE ROW = 'r1'", noflush=True).mutator
    s.close_mutator(gone, flush=False)  # what it held is lost
    assert len(s.execute("SELECT * FROM t").text()) == 2
    s.close_mutator(s.execute("DELETE f FROM t WHERE ROW = 'r1'", noflush=True).mutator)
    assert [x.split("\t")[0] for x in s.execute("SELECT * FROM t").text()] == ["r2"]
