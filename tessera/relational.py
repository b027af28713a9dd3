"""Between relational tables and cells."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import CELL_SCHEMA, INSERT, Schema
from .plans import RowInterval, ScanSpec, planner


def cells(rows: DataFrame, row: Column, cf: Column, cf_id: Column, ts: Column, rev: Column, value: Column, cq: Column | None = None, flag: Column | None = None) -> DataFrame:
    """One cell for each row."""
    columns = {"row": row, "cf": cf, "cf_id": cf_id, "cq": F.lit("") if cq is None else cq, "ts": ts, "rev": rev, "flag": F.lit(INSERT) if flag is None else flag, "value": value}
    return rows.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in CELL_SCHEMA])


def melt(rows: DataFrame, schema: Schema, row: Column, ts: Column, rev: Column, values: dict[str, Column], cq: Column | None = None) -> DataFrame:
    """A cell for each row and family of ``values`` (``family`` or ``family:qualifier``) that isn't null.

    One pass: the values of a row are exploded next to it, and the columns that no
    family takes are not read.
    """
    parts = []
    for name, value in values.items():
        family, _, qualifier = name.partition(":")
        f = schema.family(family)
        own = [F.lit(qualifier).alias("cq")] if cq is None else []
        parts.append(F.struct(F.lit(family).alias("cf"), F.lit(f.id).alias("cf_id"), *own, value.cast("string").alias("value")))
    # what all cells of a row share stands beside the array, so that it is made once, and not at all if nobody asks for it
    shared = {"row": row, "ts": ts, "rev": rev} | ({} if cq is None else {"cq": cq})
    wide = rows.select(*[v.alias(k) for k, v in shared.items()], F.explode(F.array(*parts)).alias("c"))
    full = wide.filter(F.col("c.value").isNotNull())
    of = F.col("c.cq") if cq is None else F.col("cq")
    return cells(full, F.col("row"), F.col("c.cf"), F.col("c.cf_id"), F.col("ts"), F.col("rev"), F.col("c.value"), of)


def pivot(scanned: DataFrame, columns: list[str]) -> DataFrame:
    """``row`` and a string column for each of ``columns``: a row's value in that family or column.

    Of several versions the newest counts.  One grouping; the names are given, so no
    pass is needed to find them.
    """
    out = []
    for name in columns:
        family, colon, qualifier = name.partition(":")
        own = (F.col("cf") == family) & (F.col("cq") == qualifier if colon else F.lit(True))
        out.append(F.max_by(F.when(own, F.col("value").cast("string")), F.when(own, F.struct("ts", "rev"))).alias(name))
    return scanned.groupBy("row").agg(*out)


@dataclass(frozen=True)
class PaddedKey:
    """Row keys that are a number, left-padded with zeros to ``width`` digits: their order is the number's.

    Bounds on such keys become bounds on the number, which files can be skipped by;
    a bound on the text made from it could not be.
    """

    column: str
    width: int = 10

    def text(self) -> Column:
        return F.lpad(F.col(self.column).cast("string"), self.width, "0")

    def predicate(self, r: RowInterval) -> Column | None:
        """A superset of ``r`` by the native column; None if ``r`` isn't made of whole keys."""
        if r.prefix is not None:
            if not r.prefix.isdigit() or len(r.prefix) > self.width:
                return None
            low, high = r.prefix.ljust(self.width, "0"), r.prefix.ljust(self.width, "9")
            return F.col(self.column).between(int(low), int(high))
        parts = []
        for bound, compare in ((r.start, Column.__ge__), (r.end, Column.__le__)):
            if bound is not None:
                if not (bound.isdigit() and len(bound) == self.width):
                    return None
                parts.append(compare(F.col(self.column), int(bound)))
        return reduce(Column.__and__, parts) if parts else None


@dataclass(frozen=True)
class View:
    """A relational table seen as cells.

    ``values`` maps columns ``family[:qualifier]`` to expressions.  A scan melts only
    the families that it asks for and pushes its rows down to the native key.  With
    ``by_family`` a row is one cell, in the family that the expression names.
    """

    rows: DataFrame
    schema: Schema
    key: PaddedKey
    ts: Column
    rev: Column
    values: dict[str, Column] | None = None
    by_family: tuple[Column, Column] | None = None  # (family, value)
    cq: Column | None = None

    def cells(self, spec: ScanSpec = ScanSpec()) -> DataFrame:
        touched = list(spec.rows) or [planner._cell_rows(c) for c in spec.cells]
        bounds = [self.key.predicate(r) for r in touched]
        rows = self.rows
        if bounds and all(b is not None for b in bounds):
            rows = rows.filter(reduce(Column.__or__, bounds))
        if self.by_family is not None:
            family, value = self.by_family
            number = F.lit(None).cast("smallint")
            for f in self.schema.families:
                number = F.when(family == f.name, F.lit(f.id)).otherwise(number)
            if spec.families:
                rows = rows.filter(family.isin(*spec.families))
            return cells(rows, self.key.text(), family, number, self.ts, self.rev, value, self.cq)
        wanted = {k: v for k, v in self.values.items() if not spec.families or k.partition(":")[0] in spec.families}
        return melt(rows, self.schema, self.key.text(), self.ts, self.rev, wanted, self.cq)

    def scan(self, spec: ScanSpec = ScanSpec(), now_ns: int | None = None, markers: DataFrame | None = None, has_versions: bool = True) -> DataFrame:
        """What ``spec`` sees, with ``markers`` among the cells."""
        found = self.cells(spec)
        if markers is not None:
            found = found.unionByName(markers)
        return planner.scan(found, self.schema, spec, now_ns, has_deletes=markers is not None, has_versions=has_versions)
