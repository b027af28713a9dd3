"""Compiles a :class:`ScanSpec` to a DataFrame over a table of cells.

Order of work: row hull (pushed to the files) -> snapshot -> TTL -> deletes ->
families and intervals -> time window -> versions -> row limit.  Row bounds go
below the delete stage, as every marker is in the row that it hides; the upper
time bound stays above it, since a marker newer than the window still hides.  One
interval, or several that can't overlap, become a plain predicate; otherwise each
interval is an entry of an array that is exploded next to each cell that lies in
several, so no join is planned and nothing is shuffled for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadScan
from ..model import Schema, split_column
from ..operators import visibility
from .spec import CellInterval, RowInterval, ScanSpec

#: So many intervals become a predicate; more become a tree of comparisons.
INLINE = 64


def row_predicate(r: RowInterval) -> Column:
    if r.prefix is not None:
        return F.col("row").startswith(r.prefix)
    if r.start is not None and r.start == r.end:
        return F.col("row") == r.start
    parts = []
    if r.start is not None:
        parts.append(F.col("row") >= r.start if r.start_inclusive else F.col("row") > r.start)
    if r.end is not None:
        parts.append(F.col("row") <= r.end if r.end_inclusive else F.col("row") < r.end)
    return reduce(Column.__and__, parts, F.lit(True))


def cell_predicate(c: CellInterval, family_id) -> Column:
    row, cf, cq = F.col("row"), F.col("cf_id"), F.col("cq")
    if c.prefix is not None:
        family, qualifier = split_column(c.prefix[1])
        return (row == c.prefix[0]) & (cf == family_id(family)) & cq.startswith(qualifier)

    def beyond(bound, inclusive: bool, less: bool) -> Column:
        family, qualifier = split_column(bound[1])
        fid = family_id(family)
        before = (lambda a, b: a < b) if less else (lambda a, b: a > b)
        if qualifier is None:  # the whole family is in or out
            at = (cf == fid) if inclusive else F.lit(False)
        else:
            at = (cf == fid) & (before(cq, F.lit(qualifier)) | (cq == qualifier if inclusive else F.lit(False)))
        # the plain bound on the row is what files can be skipped by
        on_row = row <= bound[0] if less else row >= bound[0]
        return on_row & (before(row, F.lit(bound[0])) | before(cf, F.lit(fid)) | at)

    if c.start is not None and c.start == c.end:
        family, qualifier = split_column(c.start[1])
        whole = (row == c.start[0]) & (cf == family_id(family))
        return whole if qualifier is None else whole & (cq == qualifier)
    parts = []
    if c.start is not None:
        parts.append(beyond(c.start, c.start_inclusive, False))
    if c.end is not None:
        parts.append(beyond(c.end, c.end_inclusive, True))
    return reduce(Column.__and__, parts, F.lit(True))


def _cell_rows(c: CellInterval) -> RowInterval:
    """The rows that a cell interval touches."""
    if c.prefix is not None:
        return RowInterval(c.prefix[0], True, c.prefix[0], True)
    return RowInterval(c.start and c.start[0], True, c.end and c.end[0], True)


def overlap(intervals: list[RowInterval]) -> bool:
    """Whether a row may lie in two of them (a shared bound counts, even if exclusive)."""
    hulls = sorted((i.hull() for i in intervals), key=lambda h: h[0])
    for (_, high), (low, _) in zip(hulls, hulls[1:]):
        if high is None or low <= high:
            return True
    return False


def hull_predicate(intervals: list[RowInterval]) -> Column | None:
    """A superset of all intervals that Parquet's statistics understand."""
    if not intervals:
        return None
    if len(intervals) <= INLINE:
        return reduce(Column.__or__, map(row_predicate, intervals))
    lows = [i.prefix if i.prefix is not None else i.start for i in intervals]
    highs = [None if i.prefix is not None else i.end for i in intervals]
    parts = []
    if all(x is not None for x in lows):
        parts.append(F.col("row") >= min(lows, key=str.encode))
    if all(x is not None for x in highs):
        parts.append(F.col("row") <= max(highs, key=str.encode))
    return reduce(Column.__and__, parts) if parts else None


def _after(text: str) -> str | None:
    """The least text above all that begin with ``text``; None if there is none."""
    while text:
        last, text = ord(text[-1]) + 1, text[:-1]
        if last <= 0x10FFFF:
            return text + chr(0xE000 if 0xD800 <= last <= 0xDFFF else last)
    return None


def _cuts(r: RowInterval) -> tuple[tuple, tuple]:
    """Where an interval begins and ends: below a text (0) or right behind it (1); beyond all texts is (None, 2)."""
    if r.prefix is not None:
        high = _after(r.prefix)
        return (r.prefix.encode(), 0), (None, 2) if high is None else (high.encode(), 0)
    low = (b"", 0) if r.start is None else (r.start.encode(), 0 if r.start_inclusive else 1)
    return low, (None, 2) if r.end is None else (r.end.encode(), 1 if r.end_inclusive else 0)


def _many_rows(cells: DataFrame, intervals: tuple[RowInterval, ...]) -> DataFrame:
    """The bounds cut all keys into stretches that lie in the same intervals; a tree of comparisons finds a key's stretch.

    As many comparisons a cell as the number of bounds has binary digits, and no join.
    """
    order = lambda cut: (cut[1] == 2, cut[0] or b"", cut[1])
    spans = [tuple(map(order, _cuts(r))) for r in intervals]
    cuts = sorted({c for span in spans for c in span})
    inside = [[k for k, (low, high) in enumerate(spans) if low <= c < high] for c in cuts]
    none = F.lit(None).cast("array<int>")
    leaf = lambda ks: F.lit(ks).cast("array<int>") if ks else none

    def tree(lo: int, hi: int) -> Column:
        """For keys from the cut before ``lo`` on and below the cut ``hi``."""
        if lo == hi:
            return leaf(inside[lo - 1]) if lo else none
        mid = (lo + hi) // 2
        beyond, text, behind = cuts[mid]
        if beyond:
            return tree(lo, mid)
        key = F.lit(text.decode())
        below = F.col("row") <= key if behind else F.col("row") < key
        return F.when(below, tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return cells.withColumn("__in", tree(0, len(cuts))).filter(F.col("__in").isNotNull()).withColumn("ord", F.explode("__in")).drop("__in")


def with_intervals(cells: DataFrame, spec: ScanSpec, family_id) -> DataFrame:
    """The cells of each interval with the interval's number ``ord``."""
    if len(spec.rows) > INLINE:
        return _many_rows(cells, spec.rows)
    predicates = [row_predicate(r) for r in spec.rows] or [cell_predicate(c, family_id) for c in spec.cells]
    if not predicates:
        return cells.withColumn("ord", F.lit(0))
    if len(predicates) == 1:
        return cells.filter(predicates[0]).withColumn("ord", F.lit(0))
    if spec.rows and not overlap(list(spec.rows)):
        number = reduce(lambda rest, kp: F.when(kp[1], F.lit(kp[0])).otherwise(rest), reversed(list(enumerate(predicates))), F.lit(-1))
        return cells.filter(reduce(Column.__or__, predicates)).withColumn("ord", number)
    # a cell once for each interval that it lies in
    hits = F.array_compact(F.array(*[F.when(p, F.lit(k)) for k, p in enumerate(predicates)]))
    return cells.filter(reduce(Column.__or__, predicates)).withColumn("ord", F.explode(hits))


def scan(cells: DataFrame, schema: Schema, spec: ScanSpec = ScanSpec(), now_ns: int | None = None, has_deletes: bool = True, has_versions: bool = True, few_markers: bool = False, wide_rows: bool = False) -> DataFrame:
    """What ``spec`` sees of ``cells``: the columns of cells and ``ord``.

    ``now_ns`` is the clock for TTLs, needed if a family has one.  Without deletes
    or further versions among ``cells`` their stages may be left out by the flags;
    ``few_markers`` says that all markers may be broadcast (callers know their
    number from the manifest), ``wide_rows`` that one row may be too much for a task.
    """

    def family_id(name: str) -> int:
        f = schema.family(name)
        if f is None:
            raise BadScan(f"unknown column family '{name}'")
        return f.id

    spec.check(family_id)
    wanted = [schema.family(n) for n in spec.families] if spec.families else schema.live()
    touched = list(spec.rows) or [_cell_rows(c) for c in spec.cells]
    hull = hull_predicate(touched)
    out = cells.filter(hull) if hull is not None else cells
    if spec.as_of is not None:
        out = out.filter(F.col("rev") <= spec.as_of)
    # markers of whole rows have no family; P3
    out = out.filter(F.col("cf_id").isin([f.id for f in wanted]) | (F.col("flag") == 0) if has_deletes else F.col("cf_id").isin([f.id for f in wanted]))
    out = visibility.unexpired(out, wanted, now_ns)
    if has_deletes:
        out = visibility.undeleted(out, few_markers, spec.return_deletes, wide_rows)
    if spec.rows or spec.cells:
        if spec.return_deletes and spec.cells:
            # row and family markers belong to every cell interval of their row
            markers = F.col("flag") < 2
            out = with_intervals(out.filter(~markers), spec, family_id).unionByName(with_intervals(out.filter(markers), ScanSpec(rows=tuple(touched)), family_id))
        else:
            out = with_intervals(out, spec, family_id)
    else:
        out = out.withColumn("ord", F.lit(0))
    start, end = (None, None) if spec.return_deletes else spec.time  # markers come whatever their time, and so do cells then
    if start is not None:
        out = out.filter(F.col("ts") >= start)
    if end is not None:
        out = out.filter(F.col("ts") < end)
    if has_versions and not spec.return_deletes:
        out = visibility.newest(out, wanted, spec.revs)
    if spec.limit:
        out = first_rows(out, spec.limit)
    return out


def first_rows(cells: DataFrame, limit: int) -> DataFrame:
    """The cells of the first ``limit`` rows by interval and key: a top-k of keys, and a semi join with it."""
    keys = cells.select(F.col("ord").alias("__ord"), F.col("row").alias("__row")).distinct().orderBy("__ord", "__row").limit(limit)
    return cells.join(keys, (F.col("ord") == F.col("__ord")) & (F.col("row") == F.col("__row")), "left_semi")


def in_order(cells: DataFrame) -> DataFrame:
    """Interval by interval, in key order, newer versions first."""
    return cells.orderBy("ord", "row", "cf_id", "cq", "flag", F.desc("ts"), F.desc("rev"))


__all__ = ["first_rows", "in_order", "overlap", "scan"]
