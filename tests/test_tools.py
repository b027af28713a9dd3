import io

import pytest

from tessera import errors as e
from tessera import tools
from tessera.model import Family, Schema
from tessera.plans import CellInterval, RowInterval, ScanBuilder, ScanSpec
from tessera.session import Session
from tessera.shell import Shell
from tessera.sources import generator

ROW = [generator.Part(form="%05d", low=0, high=999)]


@pytest.fixture
def s(spark, tmp_path):
    return Session(spark, f"file://{tmp_path}/store")


def test_builder_makes_the_same_scans():
    b = ScanBuilder().add_column("a").add_column("b").add_row("r").add_row_interval("x", False, "z", True)
    b.set_start_time(5).set_end_time(9).set_max_versions(2).set_row_limit(3).set_keys_only().set_return_deletes()
    assert b.get() == ScanSpec(("a", "b"), (RowInterval("r", True, "r", True), RowInterval("x", False, "z", True)), (), (5, 9), 2, 3, True, True)
    assert ScanBuilder().add_cell("r", "a:q").set_time_interval(None, 4).get() == ScanSpec(cells=(CellInterval(("r", "a:q"), True, ("r", "a:q"), True),), time=(None, 4))
    for bad in (ScanBuilder().add_row("r").add_cell("r", "a"), ScanBuilder().add_row_interval("b", True, "a"), ScanBuilder().set_row_limit(-1)):
        with pytest.raises(e.BadScan):
            bad.get()


def test_mutators_by_number_and_array_forms(s):
    s.create_table("t", Schema.define([Family("a"), Family("b")]))
    m = s.open_mutator("t")
    s.set_cells(m, [("r1", "a", "q", "v1", "10"), ("r1", "a", "", "v2", "10"), ("r1", "b", "q", "v3", "10", "77", "255"), ("r2", "b", "", "v4", "10")])
    assert s.get_cells("t") == []
    s.flush_mutator(m)
    assert s.as_arrays(s.get_cells("t")) == [("r1", "a", "", "v2", "10"), ("r1", "a", "q", "v1", "10"), ("r1", "b", "q", "v3", "10"), ("r2", "b", "", "v4", "10")]
    s.set_cell(m, ("r1", "a", "", "", "20", "", "2"))
    s.set_cell(m, ("r1", "b", "", "", "20", "", "1"))
    s.set_cell(m, ("r2", "", "", "", "20"))
    s.close_mutator(m)
    assert s.as_arrays(s.get_cells("t")) == [("r1", "a", "q", "v1", "10")]
    for wrong in ((), ("r",) * 8, ("r", "a", "", "", "", "", "9")):
        with pytest.raises(e.BadKey):
            s.set_cell(s.open_mutator("t"), wrong)
    with pytest.raises(e.BadKey):
        s.flush_mutator(m)
    lost = s.open_mutator("t")
    s.set_cell(lost, ("r9", "a", "", "x"))
    s.close_mutator(lost, flush=False)
    assert [c.row for c in s.get_cells("t")] == ["r1"]


def test_rows_and_blocks_of_a_cursor(s):
    t = s.create_table("t", Schema.define([Family("a")]))
    with s.mutator("t") as m:
        for k in range(7):
            m.set(f"r{k // 3}", f"a:{k}", str(k))
    k = s.open_scanner(t.scan(), 2)
    read = lambda cells: [bytes(c.value).decode() for c in cells]
    assert read(s.next_row(k)) == ["0", "1", "2"] and read(s.next_cells(k)) == ["3", "4"] and read(s.next_row(k)) == ["5"]
    assert read(s.next_row(k)) == ["6"] and s.next_row(k) == [] and s.next_cells(k) == []
    s.close_scanner(k)
    with pytest.raises(e.BadScan):
        s.next_row(k)


def test_alter_by_schema(s):
    t = s.create_table("t", Schema.define([Family("a")]))
    s.alter_table("t", t.schema.alter([("add", [Family("b")], [])]))
    assert [f.name for f in s.open_table("t").schema.live()] == ["a", "b"]
    with pytest.raises(e.Conflict):
        s.alter_table("t", t.schema.alter([("add", [Family("c")], [])]))


def test_raw_times(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/store", raw_timestamps=True)
    s.run("CREATE TABLE t (a); INSERT INTO t VALUES ('1970-01-01 00:00:02', 'r', 'a', 'v')")
    assert s.execute("SELECT * FROM t DISPLAY_TIMESTAMPS").text() == ["2000000000\tr\ta\tv"]


def test_load_and_query_drivers(s):
    s.create_table("t", Schema.define([Family("f"), Family("g")]))
    wrote = tools.update(s, "t", ROW, [generator.ColumnSpec("f", value_size=20), generator.ColumnSpec("g", value_size=5)], 4_000, commits=2)
    assert wrote.requests == 2 and wrote.cells == s.scan("t").count() > 50 and wrote.least <= wrote.mean <= wrote.most
    read = tools.query(s, "t", ["00000", "00001", "nowhere"])
    assert (read.requests, read.cells) == (3, 4) and "stddev" in str(read)
    assert len(tools.generated_keys(s.spark, ROW, 12)) == 12
    assert tools.query(s, "t", []).requests == 0


def test_listings(s, capsys):
    s.run("CREATE TABLE t (a); CREATE TABLE empty (a); INSERT INTO t VALUES ('r1', 'a', 'v'), ('r2', 'a', 'w'); DELETE * FROM t WHERE ROW = 'r1'")
    assert sorted(map(tuple, tools.counts(s.store).collect())) == [("empty", 0, 0), ("t", 3, 1)]
    assert sorted((r.table, r.cells, r.first, r.last) for r in tools.segments(s.store).collect()) == [("t", 1, "r1", "r1"), ("t", 2, "r1", "r2")]
    assert tools.stored(s.open_table("t")).count() == 3 and [c.row for c in tools.stored(s.open_table("t"), "r1", "r2").collect()] == ["r2"]
    assert tools.main(["dump", s.store.root, "t", "r1"]) == 0 and capsys.readouterr().out.split("\t")[1:] == ["r2", "a", "w\n"]
    assert tools.main(["nothing", s.store.root]) == 1


def test_values_of_a_file(spark, tmp_path):
    (tmp_path / "text").write_text("the quick brown fox\njumps over the lazy dog\n")
    make = lambda size: generator.generate(spark, ROW, [generator.ColumnSpec("f", value_size=size, source=f"file://{tmp_path}/text")], 3_000)
    text = (tmp_path / "text").read_text()
    got = [r["value"] for r in make(9).collect()]
    assert len(set(got)) > 2 and all(len(v) == 9 and v in text * 2 for v in got)
    assert {len(r["value"]) for r in make(100).collect()} == {100}
    (tmp_path / "none").write_text("")
    with pytest.raises(ValueError):
        generator.generate(spark, ROW, [generator.ColumnSpec("f", source=f"file://{tmp_path}/none")], 100)


def test_shell_runs_a_script(s, tmp_path):
    out = io.StringIO()
    (tmp_path / "script").write_text("CREATE TABLE t (a); SHOW TABLES;")
    assert Shell(s, out, test_mode=True).run(f"source {tmp_path}/script; status; print done; quit; print never") is False
    assert out.getvalue() == "CREATE TABLE t (a);\nSHOW TABLES;\nt\n1 tables\ndone\n"
