import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.errors import BadScan
from tessera.model import CELL_SCHEMA, Family, Schema
from tessera.operators import visibility
from tessera.plans import CellInterval, RowInterval, ScanSpec, planner, scan
from tests.model import Cell
from tests.model import scan as plain

FAMILIES = ("apple", "banana", "carrot")
SCHEMA = Schema.define([Family("apple", max_versions=2), Family("banana", ttl=40), Family("carrot")])
NOW = 100 * 10**9


def some_cells(seed, n=120):
    r = random.Random(seed)
    rows = ["a", "Ab", "aa", "b", "b~", "bé", "c", "d"]
    out = []
    for rev in range(n):
        flag = r.choice([255] * 8 + [0, 1, 2])
        cf = "" if flag == 0 else r.choice(FAMILIES)
        cq = r.choice(["", "x", "xy", "y"]) if flag in (2, 255) else ""
        out.append(Cell(r.choice(rows), cf, FAMILIES.index(cf) + 1 if cf else 0, cq, r.randint(1, 100) * 10**9, rev + 1, flag, f"v{rev}" if flag == 255 else None))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    held = {}

    def get(seed):
        if seed not in held:
            cells = some_cells(seed)
            rows = [(c.row, c.cf, c.cf_id, c.cq, c.ts, c.rev, c.flag, c.value and bytearray(c.value.encode())) for c in cells]
            held[seed] = (cells, spark.createDataFrame(rows, CELL_SCHEMA).cache())
        return held[seed]

    return get


def rows_of(df):
    return [(c.ord, c.row, c.cf, c.cq, c.ts, c.rev, c.flag, c.value and bytes(c.value).decode()) for c in planner.in_order(df).collect()]


def expected(found):
    return [(n, c.row, c.cf, c.cq, c.ts, c.rev, c.flag, c.value) for n, c in found]


keys = st.sampled_from(["A", "a", "aa", "ab", "b", "b~", "c", "cc", "d", "z"])
columns = st.sampled_from([*FAMILIES, "apple:", "apple:x", "banana:xy", "carrot:y"])
row_intervals = st.one_of(
    st.builds(lambda p: RowInterval(prefix=p), keys),
    st.builds(lambda a, b, i, j: RowInterval(min(a, b), i or a == b, max(a, b), j or a == b), keys, keys, st.booleans(), st.booleans()),
    st.builds(lambda a, i: RowInterval(a, i), keys, st.booleans()),
    st.builds(lambda a, i: RowInterval(end=a, end_inclusive=i), keys, st.booleans()),
)
bounds = st.tuples(keys, columns)
cell_intervals = st.one_of(
    st.builds(lambda a, i: CellInterval(a, i), bounds, st.booleans()),
    st.builds(lambda a, i: CellInterval(end=a, end_inclusive=i), bounds, st.booleans()),
    st.builds(lambda a: CellInterval(a, True, a, True), bounds),
    st.builds(lambda r, c: CellInterval(prefix=(r, c)), keys, st.sampled_from(["apple:", "apple:x", "carrot:"])),
    st.builds(lambda a, b, c, d, i, j: CellInterval((min(a, b), c), i, (max(a, b), d), j), keys, keys, columns, columns, st.booleans(), st.booleans()).filter(lambda x: x.start[0] < x.end[0]),
)
where = st.one_of(st.fixed_dictionaries({}), st.fixed_dictionaries({"rows": st.lists(row_intervals, min_size=1, max_size=3).map(tuple)}), st.fixed_dictionaries({"cells": st.lists(cell_intervals, min_size=1, max_size=3).map(tuple)}))
times = st.one_of(st.none(), st.integers(0, 101).map(lambda n: n * 10**9))
specs = st.builds(
    lambda w, f, t, u, revs, limit, as_of: ScanSpec(families=f, time=(t, u), revs=revs, limit=limit, as_of=as_of, **w),
    where, st.sampled_from([(), ("apple",), ("carrot", "banana")]), times, times, st.sampled_from([0, 0, 1, 2]), st.sampled_from([0, 0, 1, 3]), st.sampled_from([None, None, 50]),
)


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
@given(spec=specs, seed=st.integers(0, 3), how=st.sampled_from(["few_markers", "wide_rows", "has_deletes"]))
def test_any_scan_against_the_plain_version(tables, spec, seed, how):
    cells, df = tables(seed)
    assert rows_of(scan(df, SCHEMA, spec, NOW, **{how: True})) == expected(plain(cells, SCHEMA, spec, NOW))


@pytest.mark.parametrize("few", [True, False])
def test_return_deletes(tables, few):
    cells, df = tables(1)
    for spec in (ScanSpec(return_deletes=True), ScanSpec(return_deletes=True, rows=(RowInterval("a", True, "b", True),), time=(5, 6))):
        assert sorted(rows_of(scan(df, SCHEMA, spec, NOW, few_markers=few)), key=str) == sorted(expected(plain(cells, SCHEMA, spec, NOW)), key=str)


def test_many_intervals_join_instead(tables):
    cells, df = tables(2)
    spec = ScanSpec(rows=tuple(RowInterval(c, True, c, True) for c in "abcdefg" * 10) + (RowInterval(prefix="b"),))
    assert rows_of(scan(df, SCHEMA, spec, NOW)) == expected(plain(cells, SCHEMA, spec, NOW))


def test_major_compaction_changes_nothing_that_is_seen(tables):
    cells, df = tables(3)
    kept = visibility.major(df, SCHEMA.live(), NOW)
    assert kept.filter("flag <> 255").count() == 0
    assert rows_of(scan(kept, SCHEMA, ScanSpec(), NOW, has_deletes=False)) == expected(plain(cells, SCHEMA, ScanSpec(), NOW))


def test_bad_scans(tables):
    _, df = tables(0)
    for spec in (
        ScanSpec(families=("fig",)),
        ScanSpec(rows=(RowInterval("z", False, "a", False),)),
        ScanSpec(rows=(RowInterval("a", True, "a", False),)),
        ScanSpec(rows=(RowInterval("a"),), cells=(CellInterval(("a", "apple")),)),
        ScanSpec(cells=(CellInterval(("b", "apple"), True, ("a", "apple"), True),)),
        ScanSpec(cells=(CellInterval(("a", "banana:x"), True, ("a", "apple"), True),)),
        ScanSpec(cells=(CellInterval(prefix=("a", "apple")),)),
        ScanSpec(revs=-1),
    ):
        with pytest.raises(BadScan):
            scan(df, SCHEMA, spec, NOW)
    with pytest.raises(ValueError):
        scan(df, SCHEMA)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, tmp_path, tables):
    """Rows reach the files, one shuffle serves three windows, limits on versions stop early."""
    _, df = tables(0)
    df.write.parquet(f"{tmp_path}/t")
    stored = spark.read.schema(CELL_SCHEMA).parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        schema = Schema.define([Family(f) for f in FAMILIES])
        one = physical(scan(stored, schema, ScanSpec(rows=(RowInterval("b", True, "c", False),))))
        assert "GreaterThanOrEqual(row,b)" in one and "LessThan(row,c)" in one and one.count("Exchange") == 1
        plan = physical(scan(stored, schema, ScanSpec(rows=(RowInterval(prefix="b"),), revs=1), has_deletes=False))
        assert "StringStartsWith(row,b)" in plan and "WindowGroupLimit" in plan
        bare = physical(scan(stored, schema, ScanSpec(rows=(RowInterval("a", True, "b", True), RowInterval("b", True, "c", True))), has_deletes=False, has_versions=False))
        assert "Join" not in bare and "Exchange" not in bare
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_equal_lower_bounds_overlap():
    assert planner.overlap([RowInterval("a"), RowInterval("a", True, "b", True)]) and planner.overlap([RowInterval(), RowInterval()])
    assert not planner.overlap([RowInterval("c"), RowInterval("a", True, "b", True), RowInterval(prefix="bb")])


def test_many_intervals_need_no_join(spark):
    """More intervals than a predicate takes, overlapping, open, empty and prefixes: a bag union, found by comparisons alone."""
    r = random.Random(4)
    rows = ["".join(r.choice("abé\U0001f600z") for _ in range(r.randint(1, 4))) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in rows], "row string")
    pick = lambda: r.choice([None, r.choice(rows), r.choice("abz")])
    intervals = [RowInterval(pick(), r.random() < 0.5, pick(), r.random() < 0.5) for _ in range(80)]
    intervals += [RowInterval(prefix=r.choice(rows)[: r.randint(1, 2)]) for _ in range(20)]

    def holds(i, x):
        x = x.encode()
        if i.prefix is not None:
            return x.startswith(i.prefix.encode())
        low = i.start is None or x > i.start.encode() or i.start_inclusive and x == i.start.encode()
        return low and (i.end is None or x < i.end.encode() or i.end_inclusive and x == i.end.encode())

    found = planner._many_rows(df, tuple(intervals))
    assert sorted((x.row, x.ord) for x in found.collect()) == sorted((x, k) for x in rows for k, i in enumerate(intervals) if holds(i, x))
    assert "Join" not in physical(found)
