"""Cells to write: inserts and markers, checked and ready to be stamped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadKey
from ..model import CELL_SCHEMA, DELETE_CELL, DELETE_FAMILY, DELETE_ROW, INSERT, Schema, check_row, split_column

#: Before stamping: a null ``ts`` is given at the commit.
_LOOSE = "row string, cf string, cf_id smallint, cq string, ts long, rev long, flag smallint, value binary"


def _family(schema: Schema, name: str):
    f = schema.family(name)
    if f is None:
        raise BadKey(f"unknown column family '{name}'")
    return f


def insert(schema: Schema, row: str, column: str, value: str | bytes, ts: int | None = None) -> tuple:
    family, qualifier = split_column(column)
    f = _family(schema, family)
    if "\0" in (qualifier or ""):
        raise BadKey("a qualifier can't hold NUL")
    data = value.encode() if isinstance(value, str) else value
    return check_row(row), f.name, f.id, qualifier or "", ts, None, INSERT, bytearray(data)


def marker(schema: Schema, row: str, column: str | None = None, ts: int | None = None) -> tuple:
    """A delete of a row, of a family, or with a qualifier (it may be empty) of a cell."""
    if not column:
        return check_row(row), "", 0, "", ts, None, DELETE_ROW, None
    family, qualifier = split_column(column)
    f = _family(schema, family)
    return check_row(row), f.name, f.id, qualifier or "", ts, None, DELETE_FAMILY if qualifier is None else DELETE_CELL, None


def stamped(rows: list[tuple], rev: int, ts: int) -> list[tuple]:
    """``rows`` in their order with revisions from ``rev``, and from ``ts`` the times that are null."""
    return [(*r[:4], ts + k if r[4] is None else r[4], rev + k, *r[6:]) for k, r in enumerate(rows)]


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Statement-sized lists."""
    return spark.createDataFrame(rows, _LOOSE)


def checked(cells: DataFrame, schema: Schema) -> DataFrame:
    """A frame of cells for a table: family ids filled in, bad keys refused.

    Needs ``row, cf, value``; ``cq``, ``ts`` and ``flag`` may be missing.  A null or empty
    ``cf`` makes a marker of the row.
    """
    have = set(cells.columns)
    get = lambda name, default: F.coalesce(F.col(name), default) if name in have else default
    flag = get("flag", F.lit(INSERT))
    cf = F.coalesce(F.col("cf"), F.lit(""))
    fid = F.when(cf == "", F.when(flag == DELETE_ROW, F.lit(0)))
    for f in schema.live():
        fid = fid.when(cf == f.name, F.lit(f.id))
    row = F.col("row")
    sound = row.isNotNull() & (row != "") & ~F.contains(row, F.lit("\0")) & fid.isNotNull()
    value = F.col("value").cast("binary")
    refused = F.raise_error(F.concat(F.lit("bad key: "), F.coalesce(row, F.lit("null")), F.lit(" "), cf))
    columns = {"row": row, "cf": cf, "cf_id": F.when(sound, fid).otherwise(refused.cast("int")), "cq": get("cq", F.lit("")), "ts": F.col("ts") if "ts" in have else F.lit(None), "rev": F.lit(None), "flag": flag, "value": F.when(flag == INSERT, value)}
    return cells.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in CELL_SCHEMA])
