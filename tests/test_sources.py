from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera import functions as fn
from tessera.dialect.statements import LoadOptions
from tessera.errors import ParseError
from tessera.model import Family, Schema
from tessera.operators import mutate
from tessera.sources import facts, generator, sink, tsv, weblog
from tessera.storage import Store


def table(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def cells(spark, lines, header, **options):
    good, bad = tsv.cells_of(table(spark, lines), tsv.header_of(header), LoadOptions(**options))
    return sorted(tuple(r) for r in good.select("row", "cf", "cq", "value", "ts").collect()), sorted(tuple(r) for r in bad.collect())


def test_single_cells(spark):
    lines = [
        "12\tparis\tweather:noon:utc\tlight rain", "0\toslo\tmayor\tE. Lae", "-3\trome\tweather:\tdry", "4", "today\tbern\tmayor\tv",
        "9\tkiev\tmayor\t", "1\triga\tweather:q\ta\\tb\tc", "2024-01-01 00:00:01\tzug\tmayor\tv",
    ]
    good, bad = cells(spark, lines, "timestamp\trowkey\tcolumnkey\tvalue")
    assert good == [
        ("oslo", "mayor", "", "E. Lae", 0), ("paris", "weather", "noon:utc", "light rain", 12), ("riga", "weather", "q", "a\tb\tc", 1),
        ("rome", "weather", "", "dry", -3), ("zug", "mayor", "", "v", fn.parse_datetime("2024-01-01 00:00:01")),
    ]
    assert bad == [("4", "too few fields"), ("today\tbern\tmayor\tv", "bad timestamp")]
    assert cells(spark, ["r\tf:q:p\tv\\n"], "row\tcolumn\tvalue", escape=False)[0] == [("r", "f", "q:p", "v\\n", None)]


def test_multi_cells(spark):
    header = "# page\tdate\turl:ref\tcode"
    rows = ["p1\t2008-01-01 00:00:01\tu\t200\textra", "p2\tnever\tu\t200", "NULL\t2008-01-01 00:00:01\tu\t200", "p3\t2008-01-01 00:00:02\t\\N"]
    good, bad = cells(spark, rows, header, timestamp_column="date")
    t = fn.parse_datetime("2008-01-01 00:00:01")
    assert good == [("p1", "code", "", "200", t), ("p1", "url", "ref", "u", t)]
    assert [r for _, r in bad] == ["no row key", "bad timestamp"]
    good, _ = cells(spark, rows[:1], header, row_key=("%04code", "%-4page", "%3url:ref"), dup_key_cols=True)
    assert {x[0] for x in good} == {"0200 p1     u"} and [x[1] for x in good] == ["code", "date", "page", "url"]
    unique, _ = cells(spark, ["k\tv"] * 4000, "row\tf", uniquify=9)
    assert len({x[0] for x in unique}) == 4000 and all(x[0].startswith("k ") and len(x[0]) == 11 for x in unique)
    seen = [Counter(x[0][2 + k] for x in unique) for k in range(9)]
    assert all(len(c) == 64 and max(c.values()) < 130 for c in seen)  # each character takes all of 64 values, about alike
    assert {len(x[0]) for x in cells(spark, ["k\tv"] * 3, "row\tf", uniquify=100)[0]} == {102}
    with pytest.raises(ParseError):
        cells(spark, ["a"], "x", row_key=("y",))
    with pytest.raises(ParseError):
        cells(spark, ["a"], "x", timestamp_column="y")


def test_files(spark, tmp_path):
    import gzip

    (tmp_path / "a.tsv.gz").write_bytes(gzip.compress(b"#row\tf\nr\tv\n"))
    lines, names = tsv.read_lines(spark, f"{tmp_path}/a.tsv.gz")
    assert names == ["row", "f"] and [r.value for r in lines.collect()] == ["r\tv"]
    # one line of each file is the header; equal lines further down are data, and so are quotes
    (tmp_path / "two").mkdir()
    for name in "ab":
        (tmp_path / "two" / name).write_text('row\tf\n"x\t\'1\n' + "row\tf\n" * 3)
    lines, names = tsv.read_lines(spark, f"{tmp_path}/two")
    assert Counter(r.value for r in lines.collect()) == {"row\tf": 6, '"x\t\'1': 2}
    (tmp_path / "empty").write_text("")
    with pytest.raises(ParseError):
        tsv.read_lines(spark, f"{tmp_path}/empty")
    (tmp_path / "b").write_text("r\tv\n")
    (tmp_path / "head").write_text("row\tf\n")
    assert tsv.read_lines(spark, f"{tmp_path}/b", f"file://{tmp_path}/head")[0].count() == 1


def test_escapes_survive(spark):
    texts = ["\n\n\n", "\t\t", "\n\t" * 9, "plain", "mixed \\ back\nslash\t", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(fn.unescape(fn.escape(F.col("t")))).collect()] == texts


def test_times(spark):
    times = [0, 1, 999_999_999, -1, 1_700_000_000_123_456_789, -86_400 * 10**9 - 5, 9_223_372_036 * 10**9]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t long").select(fn.render_nanos(F.col("t"))).collect()]
    assert got == ["1970-01-01 00:00:00.000000000", "1970-01-01 00:00:00.000000001", "1970-01-01 00:00:00.999999999", "1969-12-31 23:59:59.999999999", "2023-11-14 22:13:20.123456789", "1969-12-30 23:59:59.999999995", "2262-04-11 23:47:16.000000000"]


def test_weblog(spark):
    lines = ['1.2.3.4 - bob [28/Jan/2008:22:00:03 +0000] "GET /a b HTTP/1.1" 200 12', '5.6.7.8 - - [1/feb/2008:00:00:00 -0800] "POST /x HTTP/1.0" 404 - "http://r" "A \\"q\\" B"', "nonsense", '1.1.1.1 - - [32/Jan/2008:22:00:03 +0000] "GET / HTTP/1.1" 200 1']
    got = sorted(map(tuple, weblog.parse_log(table(spark, lines)).collect()))
    assert got == [("1.2.3.4", "bob", fn.parse_datetime("2008-01-28 22:00:03"), "GET /a b HTTP/1.1", "200", "12", None, None), ("5.6.7.8", None, fn.parse_datetime("2008-02-01 00:00:00"), "POST /x HTTP/1.0", "404", None, "http://r", 'A \\"q\\" B')]
    rows = weblog.log_cells(weblog.parse_log(table(spark, lines)), time_order=True).collect()
    assert Counter(r.row for r in rows) == {"2008-01-28 22:00:03 /a": 5, "2008-02-01 00:00:00 -": 5}


def test_facts(spark):
    topics = spark.createDataFrame([("t1", "One", "a,b", None), ("t2", "", "c", "d")], "id string, name string, genre string, place string")
    got = sorted(tuple(r)[:3] + (r.value,) for r in facts.fact_cells(topics, "film").collect())
    assert got == [("t1", "category", "", "film"), ("t1", "name", "", "One"), ("t1", "property", "genre", "a,b"), ("t2", "category", "", "film"), ("t2", "property", "genre", "c"), ("t2", "property", "place", "d")]


def test_generator(spark):
    row = [generator.Part(form="%05d", low=10, high=29), generator.Part(form=".%03d", low=5, high=9, order="random"), generator.Part(kind="timestamp", low=0, high=10**12, order="random", distribution="zipf")]
    make = lambda n: generator.generate(spark, row, [generator.ColumnSpec("f", 32, 300), generator.ColumnSpec("g", 0, 10, "xyz")], 60_000, seed=3, partitions=n)
    got = make(3).collect()
    assert sorted(got) == sorted(make(5).collect()) and 0.3 < sum(len(r.row) + len(r.cf) + len(r.cq) + len(r.value) for r in got) / 60_000 < 1.2
    assert {len(r.value) for r in got if r.cf == "f"} == {300} and {len(r.cq) for r in got if r.cf == "f"} == {32} and set("".join(r.value for r in got if r.cf == "g")) == set("xyz")
    assert all("00010" <= r.row[:5] <= "00029" and "005" <= r.row[6:9] <= "009" for r in got)


def test_differences(spark):
    a, b = (spark.createDataFrame([(x,) for x in t], "x string") for t in ("aabc", "abbd"))
    assert sorted(map(tuple, sink.differences(a, b).collect())) == [("a", "<"), ("b", ">"), ("c", "<"), ("d", ">")]


def test_streaming(spark, tmp_path):
    from tessera.streaming import ingest

    t = Store(spark, f"file://{tmp_path}/store").create("t", Schema.define([Family("c")]))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("row string, cf string, value string").json(f"{tmp_path}/in")
    for n in range(2):
        spark.createDataFrame([(f"r{n}", "c", f"v{n}"), ("both", "c", f"v{n}")], "row string, cf string, value string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        q = ingest(stream, t, f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert len(t.manifest().segments) == 2 and list(t.manifest().batches.values()) == [1]
    again = spark.createDataFrame([("r9", "c", "v")], "row string, cf string, value string")
    assert t.append(mutate.checked(again, t.schema), stamp=True, batch=(f"{tmp_path}/check", 1)) is None
    assert sorted((c.row, bytes(c.value).decode()) for c in t.scan().collect()) == [("both", "v0"), ("both", "v1"), ("r0", "v0"), ("r1", "v1")]
