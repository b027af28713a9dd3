"""Sharding by sampled splitters, with DataFrame functions only.

Keys are drawn with probability proportional to size (exponential priorities),
their quantiles cut the key space into ranges of about equal bytes, exact totals
a range are summed, ranges that came out overfull are subdivided, and the
measured ranges are dealt to shards, largest first.  The key is a hash of the
text, so copies fall into one range and stay together.
"""

from __future__ import annotations

import heapq
import math
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

LAW = "bytes"
#: Ranges a shard before subdivision, and sampled keys a range.  Both bound what the driver sees.
RANGES, SAMPLES = 64, 8
#: A range over so many times the mean is subdivided.
OVERFULL = 2
#: Most rows numbered by one task.
SLOT_ROWS = 1_000_000


def _longs(values) -> F.Column:
    return F.lit([int(v) for v in values]).cast("array<long>")


def _range_of(key: F.Column, splits: list[int]) -> F.Column:
    """How many of the sorted ``splits`` are at most ``key``, by binary search."""
    if not splits:
        return F.lit(0)
    table = _longs(splits)
    steps = F.lit([1 << b for b in reversed(range(len(splits).bit_length()))]).cast("array<int>")

    def step(found, width):
        probe = found + width
        fits = (probe <= len(splits)) & (F.element_at(table, F.least(probe, F.lit(len(splits)))) <= key)
        return F.when(fits, probe).otherwise(found)

    return F.aggregate(steps, F.lit(0), step)


def _splitters(base: DataFrame, ranges: int, samples: int) -> list[int]:
    """Size-weighted quantiles of a sample of ``ranges * samples`` keys.

    A key drawn for several ranges gets a range of its own, ``[key, key + 1)``.
    """
    u = (F.pmod(F.xxhash64("id", "key", F.lit(1)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    drawn = base.select("key", (-F.log(u) / F.col("size")).alias("priority")).orderBy("priority", "key").limit(ranges * samples)
    keys = sorted(r["key"] for r in drawn.collect())  # at most ranges * samples longs
    cuts = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    heavy = {a for a, b in zip(cuts, cuts[1:]) if a == b}
    return sorted({*cuts, *(k + 1 for k in heavy if k < (1 << 63) - 1)})


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES, samples: int = SAMPLES) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, a row for each row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 1 (1 for null).  Law ``bytes``: the
    shards' total sizes are near equal.  Rows with equal texts, null being one
    more text, share a shard unless they alone exceed ``1 / shards`` of all
    bytes; then they are spread by id.  ``slot`` numbers a shard's rows without
    gaps, by range and within it by text hash and id; the order among repeated
    rows is arbitrary.  ``text_crc32`` is null for null.  Ids may be null or
    repeat, an empty table gives an empty result, and other columns are not
    looked at.
    """
    raw = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    base = written(raw.select("id", size.alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc"), F.xxhash64("text").alias("key")), "sizes")

    wanted = shards * ranges
    splits = _splitters(base, wanted, samples)
    lows, highs = [-(1 << 63), *splits], [*splits, (1 << 63) - 1]
    ranged = base.withColumn("range", _range_of(F.col("key"), splits))
    full = {r["range"]: r["bytes"] for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes")).collect()}  # one row a range
    total = sum(full.values())
    mean = max(1, total / wanted)

    def parts(k: int) -> int:
        held = full.get(k, 0)
        if highs[k] - lows[k] <= 1:  # one text: whole while a shard can hold it
            return math.ceil(held / mean) if held > total / shards else 1
        return math.ceil(held / mean) if held > OVERFULL * mean else 1

    cut = [parts(k) for k in range(len(lows))]
    first = [0, *accumulate(cut)]
    row = F.col("range") + 1
    n, lo, hi = (F.element_at(_longs(x), row) for x in (cut, lows, highs))
    along = F.floor((F.col("key").cast("double") - lo.cast("double")) / (hi.cast("double") - lo.cast("double")) * n)
    part = F.when(n == 1, F.lit(0)).when(hi - 1 == lo, F.pmod(F.xxhash64("id", F.lit(2)), n)).otherwise(F.least(F.greatest(along, F.lit(0)), n - 1))
    units = ranged.withColumn("unit", (F.element_at(_longs(first[:-1]), row) + part).cast("int"))
    held = {r["unit"]: (r["bytes"], r["n"]) for r in units.groupBy("unit").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}  # one row a unit

    shard_of, load = [0] * first[-1], [(0, s) for s in range(shards)]
    for unit in sorted(held, key=lambda u: (-held[u][0], u)):
        bytes_, s = heapq.heappop(load)
        shard_of[unit] = s
        heapq.heappush(load, (bytes_ + held[unit][0], s))

    rows = sum(n for _, n in held.values())
    group = max(1, min(SLOT_ROWS, math.ceil(rows / max(1, first[-1]))))
    subs = [math.ceil(held[u][1] / group) if u in held else 1 for u in range(first[-1])]
    at = F.col("unit") + 1
    dealt = units.withColumn("shard", F.element_at(_longs(shard_of), at).cast("int"))
    dealt = dealt.withColumn("sub", F.pmod(F.xxhash64("id", "key", F.lit(3)), F.element_at(_longs(subs), at)).cast("int"))
    groups = dealt.groupBy("shard", "unit", "sub").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("unit", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(groups.select(F.col("unit").alias("u"), F.col("sub").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "starts")
    within = F.row_number().over(Window.partitionBy("unit", "sub").orderBy("key", "id"))
    placed = dealt.withColumn("place", within).join(starts, (F.col("unit") == F.col("u")) & (F.col("sub") == F.col("s")))
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("start") + F.col("place") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
