"""Tab-separated text as cells.

A header names the columns.  ``row column value``, with a leading ``timestamp``
or without, has a cell a line; any other header has a row a line, each column
``family[:qualifier]``.  Lines are split and exploded by Spark; only the first line
is read on the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dialect.statements import LoadOptions
from ..errors import ParseError
from ..functions import datetime_nanos, family_of, key_format, qualifier_of, unescape

# Fields that stand for no value, and names of the single-cell form.
NULLS = ("", "NULL", "\\N")
ROW_NAMES, COLUMN_NAMES = ("row", "rowkey"), ("column", "columnkey")

KIND = "row string, cf string, cq string, ts long, value string"


def header_of(line: str) -> list[str]:
    return re.sub(r"^#?\s*", "", line.rstrip("\r\n")).split("\t")


def is_single_cell(names: list[str]) -> bool:
    rest = names[1:] if names[0] == "timestamp" else names
    return len(rest) == 3 and rest[0] in ROW_NAMES and rest[1] in COLUMN_NAMES and rest[2] == "value"


def read_lines(spark: SparkSession, path: str, header_file: str | None = None) -> tuple[DataFrame, list[str]]:
    """``(value)`` lines after the header, and the header's names; ``.gz`` is unpacked by Spark."""
    where = lambda p: re.sub(r"^file://(?!/)", "file:///", p)
    if header_file:
        return spark.read.text(where(path)), header_of(spark.read.text(where(header_file)).first()[0])
    first = spark.read.text(where(path)).first()
    if first is None:
        raise ParseError(f"{path} has no header")
    # the reader of separated values leaves out the first line of each file, at whatever place it splits them;
    # separator and quote are no characters, so each line comes whole
    whole = {"header": True, "sep": "\uffff", "quote": "\ufffe", "escape": "\ufffe"}
    return spark.read.schema("value string").options(**whole).csv(where(path)), header_of(first[0])


def single_cells(lines: DataFrame, names: list[str], escape: bool = True) -> tuple[DataFrame, DataFrame]:
    """Cells, and the lines that aren't any with the reason.  Times are whole nanoseconds or datetimes."""
    timed = names[0] == "timestamp"
    n = 4 if timed else 3
    parts = F.split("value", "\t", n)
    get = lambda k: F.get(parts, F.lit(k + timed))
    stamp = F.get(parts, F.lit(0))
    ts = F.coalesce(F.when(stamp.rlike(r"^-?\d+$"), stamp.try_cast("long")), datetime_nanos(stamp)) if timed else F.lit(None).cast("long")
    wide = lines.select(F.col("value").alias("line"), get(0).alias("row"), get(1).alias("column"), get(2).alias("value"), ts.alias("ts"), F.size(parts).alias("n"))
    reason = F.when(F.col("n") < n, "too few fields").when(F.col("row").isin(*NULLS), "no row key").when(F.col("column").isin(*NULLS), "no column")
    if timed:
        reason = reason.when(F.col("ts").isNull(), "bad timestamp")
    judged = wide.withColumn("reason", reason)
    good = judged.filter(F.col("reason").isNull() & ~F.col("value").isin(*NULLS))
    value = unescape(F.col("value")) if escape else F.col("value")
    cells = good.select("row", family_of(F.col("column")).alias("cf"), qualifier_of(F.col("column")).alias("cq"), "ts", value.alias("value"))
    return cells, judged.filter(F.col("reason").isNotNull()).select("line", "reason")


_KEY = re.compile(r"(%-?[0-9]+)(.+)")


def row_key(names: list[str], fields, parts: tuple[str, ...]) -> tuple[Column, set[int]]:
    """The key of ``ROW_KEY_COLUMN`` parts, and which columns it takes; the first column by default."""
    out, used = [], set()
    for part in parts or (names[0],):
        m = _KEY.fullmatch(part)
        form, name = (m[1], m[2]) if m else (None, part)
        name = name.replace("\\%", "%")
        if name not in names:
            raise ParseError(f"row key column '{name}' is not in the header")
        k = names.index(name)
        used.add(k)
        out.append(key_format(fields(k), form) if form else fields(k))
    return F.concat_ws(" ", *out), used


def random_text(n: int) -> Column:
    """``n`` random characters of base64, six bits each."""
    # a digest's 43 characters hold 256 bits; its 44th is padding
    digests = [F.substring(F.base64(F.unhex(F.sha2(F.uuid(), 256))), 1, min(43, n - k)) for k in range(0, n, 43)]
    return F.concat(*digests)


def multi_cells(lines: DataFrame, names: list[str], options: LoadOptions = LoadOptions()) -> tuple[DataFrame, DataFrame]:
    """A cell for each field of a line but those of the key and the time; and the lines that give none, with the reason."""
    parts = F.split("value", "\t")
    fields = lambda k: F.get(F.col("parts"), F.lit(k))
    if options.timestamp_column is not None and options.timestamp_column not in names:
        raise ParseError(f"timestamp column '{options.timestamp_column}' is not in the header")
    at = names.index(options.timestamp_column) if options.timestamp_column else None
    key, used = row_key(names, fields, options.row_key)
    null = lambda c: c.isNull() | c.isin(*NULLS)
    split = lines.select(F.col("value").alias("line"), parts.alias("parts"))
    reason = F.lit(None).cast("string")
    for k in sorted(used):
        reason = F.when(null(fields(k)), "no row key").otherwise(reason)
    ts = datetime_nanos(fields(at)) if at is not None else F.lit(None).cast("long")
    if at is not None:
        reason = F.when(null(fields(at)) | ts.isNull(), "bad timestamp").otherwise(reason)
    if options.uniquify:
        key = F.concat(key, F.lit(" "), random_text(options.uniquify))
    shown = [k for k in range(len(names)) if k != at and (options.dup_key_cols or k not in used)]
    cells = F.array(*[F.struct(F.lit(names[k].partition(":")[0]).alias("cf"), F.lit(names[k].partition(":")[2]).alias("cq"), fields(k).alias("value")) for k in shown])
    judged = split.withColumns({"reason": reason, "ts": ts, "row": key, "cells": cells})
    long = judged.filter(F.col("reason").isNull()).select("row", "ts", F.explode("cells").alias("c"))
    value = unescape(F.col("c.value")) if options.escape else F.col("c.value")
    out = long.filter(~null(F.col("c.value"))).select("row", "c.cf", "c.cq", "ts", value.alias("value"))
    return out, judged.filter(F.col("reason").isNotNull()).select("line", "reason")


def cells_of(lines: DataFrame, names: list[str], options: LoadOptions = LoadOptions()) -> tuple[DataFrame, DataFrame]:
    """Cells ``(row, cf, cq, ts, value)`` in either form, and the lines left out."""
    if is_single_cell(names) and not options.row_key and not options.timestamp_column:
        return single_cells(lines, names, options.escape)
    return multi_cells(lines, names, options)


def read_script(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mutations ``(row, cf, cq, ts, flag, value)`` of a script, and the lines that are none with the reason.

    A line is ``time|AUTO``, row, ``family[:qualifier]``, value; ``DELETE`` for the column
    deletes the row, for the value the family or, with a qualifier, the cell.
    """
    parts = F.split(F.trim("value"), "\t+")
    get = lambda k: F.get(parts, F.lit(k))
    auto = F.upper(get(0)) == "AUTO"
    ts = F.when(~auto, get(0).try_cast("long"))
    reason = F.when(F.size(parts) < 3, "too few fields").when(get(1) == "", "no row key").when(~auto & ts.isNull(), "bad timestamp")
    judged = lines.filter(F.trim("value") != "").withColumn("reason", reason)
    whole_row, delete = get(2) == "DELETE", F.coalesce(get(3), F.lit("")) == "DELETE"
    flag = F.when(whole_row, 0).when(delete & F.contains(get(2), F.lit(":")), 2).when(delete, 1).otherwise(255)
    good = judged.filter(F.col("reason").isNull()).select(
        get(1).alias("row"),
        F.when(whole_row, "").otherwise(family_of(get(2))).alias("cf"),
        F.when(whole_row, "").otherwise(qualifier_of(get(2))).alias("cq"),
        ts.alias("ts"),
        flag.cast("smallint").alias("flag"),
        F.when(flag == 255, F.coalesce(get(3), F.lit(""))).alias("value"),
    )
    return good, judged.filter(F.col("reason").isNotNull()).select(F.col("value").alias("line"), "reason")
