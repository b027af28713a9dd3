"""The logical form of a scan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..errors import BadScan
from ..model import split_column


@dataclass(frozen=True)
class RowInterval:
    """Row keys between two bounds; None is unbounded.  ``prefix`` stands alone."""

    start: str | None = None
    start_inclusive: bool = True
    end: str | None = None
    end_inclusive: bool = True
    prefix: str | None = None

    def check(self) -> None:
        if self.prefix is not None or self.start is None or self.end is None:
            return
        if self.start.encode() > self.end.encode():
            raise BadScan("start_row > end_row")
        if self.start == self.end and not (self.start_inclusive and self.end_inclusive):
            raise BadScan("empty row interval")

    def hull(self) -> tuple[bytes, bytes | None]:
        """Bytes at or after the lower bound, and at or before the upper one."""
        if self.prefix is not None:
            return self.prefix.encode(), self.prefix.encode() + b"\xff" * 8
        return (self.start or "").encode(), None if self.end is None else self.end.encode()


@dataclass(frozen=True)
class CellInterval:
    """Cells between two ``(row, column)`` bounds, in the order row, family id, qualifier.

    Columns are ``family`` or ``family:qualifier``; a bound without a qualifier
    stands for the whole family.
    """

    start: tuple[str, str] | None = None
    start_inclusive: bool = True
    end: tuple[str, str] | None = None
    end_inclusive: bool = True
    prefix: tuple[str, str] | None = None

    def check(self, family_id) -> None:
        """``family_id``: name to id, failing for unknown ones."""
        if self.prefix is not None:
            if ":" not in self.prefix[1]:
                raise BadScan(f"unknown column family '{self.prefix[1]}' with a prefix match")
            family_id(split_column(self.prefix[1])[0])
        low = self.start and self._key(self.start, family_id, False)
        high = self.end and self._key(self.end, family_id, True)
        if not low or not high:
            return
        if low > high:
            raise BadScan("start_cell > end_cell")
        if self.start == self.end and not (self.start_inclusive and self.end_inclusive):
            raise BadScan("empty cell interval")

    @staticmethod
    def _key(bound, family_id, last: bool):
        family, qualifier = split_column(bound[1])
        q = qualifier.encode() if qualifier is not None else b"\xff\xff" if last else b""
        return bound[0].encode(), family_id(family), q


@dataclass(frozen=True)
class ScanSpec:
    """What to read.

    ``families`` empty means all.  Several intervals are read one after the other
    and give a bag: what lies in two of them comes twice.  ``time`` is half-open, in
    nanoseconds.  ``revs`` and ``limit`` 0 mean all; ``limit`` counts rows over all
    intervals.
    """

    families: tuple[str, ...] = ()
    rows: tuple[RowInterval, ...] = ()
    cells: tuple[CellInterval, ...] = ()
    time: tuple[int | None, int | None] = (None, None)
    revs: int = 0
    limit: int = 0
    keys_only: bool = False
    return_deletes: bool = False
    as_of: int | None = None  # a revision: what was written later doesn't show

    def check(self, family_id=lambda name: 0) -> None:
        if self.rows and self.cells:
            raise BadScan("row and cell predicates can't be mixed")
        if self.revs < 0 or self.limit < 0:
            raise BadScan("a limit can't be negative")
        for r in self.rows:
            r.check()
        for c in self.cells:
            c.check(family_id)
        for name in self.families:
            family_id(name)


class ScanBuilder:
    """Puts a :class:`ScanSpec` together call by call; each call returns the builder."""

    def __init__(self, spec: ScanSpec = ScanSpec()):
        self._spec = spec

    def _with(self, **changes) -> ScanBuilder:
        self._spec = replace(self._spec, **changes)
        return self

    def add_column(self, family: str) -> ScanBuilder:
        return self._with(families=(*self._spec.families, family))

    def add_row(self, row: str) -> ScanBuilder:
        return self.add_row_interval(row, True, row, True)

    def add_row_interval(self, start: str | None = None, start_inclusive: bool = True, end: str | None = None, end_inclusive: bool = True) -> ScanBuilder:
        return self._with(rows=(*self._spec.rows, RowInterval(start, start_inclusive, end, end_inclusive)))

    def add_cell(self, row: str, column: str) -> ScanBuilder:
        return self.add_cell_interval((row, column), True, (row, column), True)

    def add_cell_interval(self, start: tuple[str, str] | None = None, start_inclusive: bool = True, end: tuple[str, str] | None = None, end_inclusive: bool = True) -> ScanBuilder:
        return self._with(cells=(*self._spec.cells, CellInterval(start, start_inclusive, end, end_inclusive)))

    def set_time_interval(self, start: int | None, end: int | None) -> ScanBuilder:
        return self._with(time=(start, end))

    def set_start_time(self, start: int | None) -> ScanBuilder:
        return self._with(time=(start, self._spec.time[1]))

    def set_end_time(self, end: int | None) -> ScanBuilder:
        return self._with(time=(self._spec.time[0], end))

    def set_max_versions(self, n: int) -> ScanBuilder:
        return self._with(revs=n)

    def set_row_limit(self, n: int) -> ScanBuilder:
        return self._with(limit=n)

    def set_keys_only(self, on: bool = True) -> ScanBuilder:
        return self._with(keys_only=on)

    def set_return_deletes(self, on: bool = True) -> ScanBuilder:
        return self._with(return_deletes=on)

    def get(self) -> ScanSpec:
        """The specification; fails if row and cell predicates are mixed or an interval is empty."""
        self._spec.check()
        return self._spec


def _bounds(op: str, value, mirrored: bool, low, high):
    """``(start, inclusive)`` or ``(end, inclusive)`` that ``op value`` sets; mirrored: ``value op``."""
    if mirrored:
        op = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
    if op in (">", ">="):
        if low[0] is not None:
            raise BadScan("two lower bounds")
        return (value, op == ">="), high
    if op in ("<", "<="):
        if high[0] is not None:
            raise BadScan("two upper bounds")
        return low, (value, op == "<=")
    if op == "=":
        if low[0] is not None or high[0] is not None:
            raise BadScan("equality with another bound")
        return (value, True), (value, True)
    raise BadScan(f"'{op}' can't be part of a range")


def _interval(kind, first, second):
    """``first``: (value, op) before the keyword or None; ``second``: (op, value) after it."""
    op, value = second
    if op == "=^":
        if first:
            raise BadScan("a prefix match with another bound")
        return kind(prefix=value)
    low, high = (None, True), (None, True)
    if first:
        if first[1] == "=^":
            raise BadScan("a prefix match can't be mirrored")
        low, high = _bounds(first[1], first[0], True, low, high)
    low, high = _bounds(op, value, False, low, high)
    return kind(low[0], low[1], high[0], high[1])


def rows_where(second, first=None) -> RowInterval:
    return _interval(RowInterval, first, second)


def cells_where(second, first=None) -> CellInterval:
    return _interval(CellInterval, first, second)


def times_where(second, first=None) -> tuple[int | None, int | None]:
    """The half-open window of ``TIMESTAMP op value``."""
    if second[0] == "=^" or first and first[1] == "=^":
        raise BadScan("times have no prefixes")
    low, high = (None, True), (None, True)
    if first:
        low, high = _bounds(first[1], first[0], True, low, high)
    low, high = _bounds(second[0], second[1], False, low, high)
    start = None if low[0] is None else low[0] + (not low[1])
    end = None if high[0] is None else high[0] + high[1]
    return start, end
