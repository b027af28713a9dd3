"""Which cells can be seen: age, deletes of three scopes, number of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import NANOS
from ..model import DELETE_CELL, DELETE_FAMILY, DELETE_ROW, INSERT, Family

_SCOPES = ((DELETE_ROW, ("row",)), (DELETE_FAMILY, ("row", "cf_id")), (DELETE_CELL, ("row", "cf_id", "cq")))


def _by_family(families: list[Family], value) -> Column | None:
    """``value(family)`` by the cell's family; None if it is 0 for all of them."""
    of: dict[int, list[int]] = {}
    for f in families:
        if value(f):
            of.setdefault(value(f), []).append(f.id)
    out = None
    for v, ids in of.items():
        out = F.when(F.col("cf_id").isin(ids), F.lit(v)) if out is None else out.when(F.col("cf_id").isin(ids), F.lit(v))
    return out


def unexpired(cells: DataFrame, families: list[Family], now_ns: int | None) -> DataFrame:
    """Without cells older than their family's TTL; the clock is the caller's."""
    ttl = _by_family(families, lambda f: f.ttl)
    if ttl is None:
        return cells
    if now_ns is None:
        raise ValueError("a family has a TTL: now_ns is needed")
    floor = F.lit(now_ns) - ttl.cast("long") * F.lit(NANOS)
    return cells.filter(F.coalesce(F.col("ts") >= floor, F.lit(True)))


def undeleted(cells: DataFrame, few_markers: bool = False, keep_markers: bool = False, wide_rows: bool = False) -> DataFrame:
    """Without cells that a marker hides, and without markers unless they are kept.

    A marker at T hides what is older than T in its row, family or cell; of several
    in a scope the newest counts.  Few markers are grouped into three tables of
    thresholds and broadcast.  Otherwise one shuffle by row serves all three windows,
    or, where rows may be too wide for a task, three joins with the thresholds, whose
    cell side adaptive execution can split.
    """
    if few_markers or wide_rows:
        return _by_joins(cells, keep_markers, F.broadcast if few_markers else lambda limits: limits)
    return _by_windows(cells, keep_markers)


def _by_windows(cells: DataFrame, keep_markers: bool) -> DataFrame:
    out = cells.repartition("row")
    limits = []
    for flag, keys in _SCOPES:
        name = f"__t{flag}"
        out = out.withColumn(name, F.max(F.when(F.col("flag") == flag, F.col("ts"))).over(Window.partitionBy(*keys)))
        limits.append(name)
    newest = F.greatest(*limits)  # the newest of all three scopes
    seen = newest.isNull() | (F.col("ts") >= newest)
    kept = (F.col("flag") == INSERT) & seen
    if keep_markers:
        kept = kept | (F.col("flag") != INSERT)
    return out.filter(kept).drop(*limits)


def _by_joins(cells: DataFrame, keep_markers: bool, hint) -> DataFrame:
    markers = cells.filter(F.col("flag") != INSERT)
    out = cells if keep_markers else cells.filter(F.col("flag") == INSERT)
    hidden = F.lit(False)
    for flag, keys in _SCOPES:
        t = f"__t{flag}"
        limits = markers.filter(F.col("flag") == flag).groupBy(*[F.col(k).alias(f"{t}_{k}") for k in keys]).agg(F.max("ts").alias(t))
        same = [F.col(k) == F.col(f"{t}_{k}") for k in keys]
        on = same[0]
        for s in same[1:]:
            on = on & s
        out = out.join(hint(limits), on, "left").drop(*[f"{t}_{k}" for k in keys])
        hidden = hidden | F.coalesce(F.col("ts") < F.col(t), F.lit(False))
    if keep_markers:
        hidden = hidden & (F.col("flag") == INSERT)
    return out.filter(~hidden).drop(*[f"__t{flag}" for flag, _ in _SCOPES])


def newest(cells: DataFrame, families: list[Family], revs: int) -> DataFrame:
    """At most so many versions of each cell as both the family and the query allow; 0: all.

    Clustered by cell, not by row, so that a wide row is spread.
    """
    limit = _by_family(families, lambda f: min(x for x in (f.max_versions, revs) if x) if f.max_versions or revs else 0)
    if limit is None:
        return cells
    limits = {min(x for x in (f.max_versions, revs) if x) for f in families if f.max_versions or revs}
    age = F.row_number().over(Window.partitionBy("ord", "row", "cf_id", "cq").orderBy(F.desc("ts"), F.desc("rev")))
    aged = cells.withColumn("__age", age)
    if len(limits) == 1 and all(f.max_versions or revs for f in families):
        return aged.filter(F.col("__age") <= limits.pop()).drop("__age")  # a plain number: Spark stops each group early
    return aged.filter(F.coalesce(F.col("__age") <= limit, F.lit(True))).drop("__age")


def major(cells: DataFrame, families: list[Family], now_ns: int | None, has_deletes: bool = True, few_markers: bool = False, wide_rows: bool = False) -> DataFrame:
    """What a compaction of everything keeps: live families, unexpired, undeleted, newest versions; no markers.

    Without markers their stage, and its shuffle, is left out; the other flags are those of :func:`undeleted`.
    """
    live = cells.filter(F.col("cf_id").isin([f.id for f in families]) | (F.col("flag") == DELETE_ROW))
    seen = unexpired(live, families, now_ns)
    if has_deletes:
        seen = undeleted(seen, few_markers, wide_rows=wide_rows)
    return newest(seen.withColumn("ord", F.lit(0)), families, 0).drop("ord")
