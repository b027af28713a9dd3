"""Scans as lines of text."""

from __future__ import annotations

import gzip
import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import escape, render_nanos
from ..model import INSERT
from ..plans.planner import in_order

#: Fixed value: what ends the line of a marker.
MARKER = "DELETE"


def column_text() -> Column:
    return F.when(F.col("cq") == "", F.col("cf")).otherwise(F.concat_ws(":", "cf", "cq"))


def rendered(scanned: DataFrame, display_timestamps: bool = False, keys_only: bool = False, escaped: bool = True, raw_timestamps: bool = False) -> DataFrame:
    """``line`` for each cell, in order: ``[time] row column value``, or the row alone."""
    value = F.coalesce(F.col("value").cast("string"), F.lit(""))
    value = escape(value) if escaped else value
    ends = F.when(F.col("flag") != INSERT, F.lit(MARKER))  # null for cells, and so left out
    time = F.col("ts").cast("string") if raw_timestamps else render_nanos(F.col("ts"))
    parts = [time] * display_timestamps + ([F.col("row")] if keys_only else [F.col("row"), column_text(), value, ends])
    return in_order(scanned).select(F.concat_ws("\t", *parts).alias("line"))


def header(display_timestamps: bool = False, keys_only: bool = False) -> str:
    return "#" + "timestamp\t" * display_timestamps + ("row" if keys_only else "row\tcolumn\tvalue")


def write_lines(lines: DataFrame, path: str, first: str) -> None:
    """One text file at ``path``, the line ``first`` on top; packed if the name ends in ``.gz``.

    Executors write the parts, in the order of ``lines``, next to it; the driver copies
    their bytes one after the other, which for packed parts is a packed file as well.
    """
    spark, packed = lines.sparkSession, path.endswith(".gz")
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    target = hadoop.fs.Path(re.sub(r"^file://(?!/)", "file:///", path))
    parts = hadoop.fs.Path(f"{target.toString()}-parts-{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    lines.write.option("compression", "gzip" if packed else "none").text(parts.toString())
    try:
        out = fs.create(target, True)
        head = f"{first}\n".encode()
        out.write(bytearray(gzip.compress(head) if packed else head))
        files = [x.getPath() for x in fs.listStatus(parts) if x.getPath().getName().startswith("part-")]
        for file in sorted(files, key=lambda x: (len(x.getName()), x.getName())):  # numbers grow longer beyond 99,999
            part = fs.open(file)
            hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
        out.close()
    finally:
        fs.delete(parts, True)


def write_folder(scanned: DataFrame, path: str, **how) -> None:
    """As many sorted part files as the sort makes, without a header: for results that one file is too small for."""
    rendered(scanned, **how).write.mode("overwrite").option("compression", "gzip" if path.endswith(".gz") else "none").text(path)


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of only one side, with the side; repeated rows count."""
    return left.exceptAll(right).withColumn("side", F.lit("<")).union(right.exceptAll(left).withColumn("side", F.lit(">")))
