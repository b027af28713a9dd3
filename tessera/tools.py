"""Tools for whoever runs a store: load and query drivers, listings, counts, comparison.

``python -m tessera.tools COMMAND ROOT ...`` with the commands ``segments ROOT``,
``count ROOT``, ``dump ROOT TABLE [START [END]]``, ``diff ROOT TABLE TABLE``,
``update ROOT TABLE BYTES`` and ``query ROOT TABLE REQUESTS``.
"""

from __future__ import annotations

import math
import sys
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import Session
from .sources import generator, sink
from .storage import Store, Table


@dataclass(frozen=True)
class Latency:
    """Seconds that requests took: extremes, mean, deviation; and what they moved."""

    requests: int
    cells: int
    seconds: float
    least: float
    most: float
    mean: float
    deviation: float

    @staticmethod
    def of(seconds: list[float], cells: int) -> Latency:
        if not seconds:
            return Latency(0, cells, 0.0, 0.0, 0.0, 0.0, 0.0)
        mean = sum(seconds) / len(seconds)
        return Latency(len(seconds), cells, sum(seconds), min(seconds), max(seconds), mean, math.sqrt(sum((s - mean) ** 2 for s in seconds) / len(seconds)))

    def __str__(self) -> str:
        return f"{self.requests} requests, {self.cells} cells in {self.seconds:.3f} s; latency min {self.least:.3f}, max {self.most:.3f}, avg {self.mean:.3f}, stddev {self.deviation:.3f} s"


def update(session: Session, name: str, row: list[generator.Part], columns: list[generator.ColumnSpec], max_bytes: int, commits: int = 1, seed: int = 1) -> Latency:
    """Write generated cells of about ``max_bytes`` in ``commits`` commits, each made in parallel and from a seed of its own."""
    table, took = session.open_table(name), []
    before = sum(s.cells for s in table.manifest().segments)
    for k in range(commits):
        cells = generator.generate(session.spark, row, columns, max(1, max_bytes // commits), seed + k)
        began = time.perf_counter()
        session.load(name, cells)
        took.append(time.perf_counter() - began)
    return Latency.of(took, sum(s.cells for s in table.manifest().segments) - before)


def query(session: Session, name: str, keys: list[str]) -> Latency:
    """Read each of the rows ``keys`` on its own, one after the other."""
    took, cells = [], 0
    for key in keys:
        began = time.perf_counter()
        cells += len(session.get_row(name, key))
        took.append(time.perf_counter() - began)
    return Latency.of(took, cells)


def generated_keys(spark: SparkSession, row: list[generator.Part], requests: int, seed: int = 1) -> list[str]:
    """``requests`` row keys of a specification, for :func:`query`."""
    cells = generator.generate(spark, row, [generator.ColumnSpec("", value_size=0)], 16 * len(row) * requests, seed)
    return [r["row"] for r in cells.select("row").collect()]


def stored(table: Table, start: str | None = None, end: str | None = None) -> DataFrame:
    """What lies in a table's segments, hidden cells and markers too, from ``start`` (not itself) to ``end``."""
    cells = table.cells()
    if start is not None:
        cells = cells.filter(F.col("row") > start)
    return cells if end is None else cells.filter(F.col("row") <= end)


def counts(store: Store) -> DataFrame:
    """``(table, cells, markers)`` as the manifests know them; no segment is opened."""
    rows = []
    for name in store.tables():
        segments = store.table(name).manifest().segments
        rows.append((name, sum(s.cells for s in segments), sum(s.markers for s in segments)))
    return store.spark.createDataFrame(rows, "table string, cells long, markers long")


def segments(store: Store) -> DataFrame:
    """A row a segment: where it lies, what it holds, its bounds."""
    rows = [(name, s.path, s.cells, s.markers, s.min_row, s.max_row, s.min_rev, s.max_rev) for name in store.tables() for s in store.table(name).manifest().segments]
    return store.spark.createDataFrame(rows, "table string, path string, cells long, markers long, first string, last string, first_rev long, last_rev long")


def main(args: list[str]) -> int:
    spark = SparkSession.builder.getOrCreate()
    command, root, *rest = args
    session = Session(spark, root)
    row = [generator.Part(form="%010d", order="random")]

    def say(lines: DataFrame) -> None:
        for r in lines.toLocalIterator():
            print(*r, sep="\t")

    match command:
        case "segments":
            say(segments(session.store))
        case "count":
            say(counts(session.store))
        case "dump":
            cells = stored(session.open_table(rest[0]), *rest[1:3]).withColumn("ord", F.lit(0))
            say(sink.rendered(cells, display_timestamps=True, raw_timestamps=True))
        case "diff":
            say(sink.differences(*[session.scan(name).select("row", "cf", "cq", "ts", "value") for name in rest]))
        case "update":
            schema = session.open_table(rest[0]).schema
            print(update(session, rest[0], row, [generator.ColumnSpec(f.name) for f in schema.live()], int(rest[1])))
        case "query":
            print(query(session, rest[0], generated_keys(spark, row, int(rest[1]))))
        case _:
            print(__doc__)
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
