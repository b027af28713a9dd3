"""Synthetic cells by a specification: ``spark.range`` and expressions, so any size is made in parallel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import render_nanos

#: The text that values are taken from is part of the plan, so its size is checked.
SOURCE_BYTES = 1 << 20
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


@dataclass(frozen=True)
class Part:
    """A component of the row key: ``integer`` within [low, high] or ``timestamp`` in nanoseconds."""

    kind: str = "integer"
    low: int = 0
    high: int = (1 << 31) - 1
    form: str = "%d"
    order: str = "ascending"  # or random
    distribution: str = "uniform"  # or zipf
    skew: float = 1.2


@dataclass(frozen=True)
class ColumnSpec:
    family: str
    qualifier_size: int = 0
    value_size: int = 15
    charset: str = LETTERS
    source: str | None = None  # a text file that values are taken from, of at most SOURCE_BYTES


def _uniform(seed: int, *salt) -> Column:
    """Equally spread over (0, 1) by a hash of the cell's number, so retries make the same cells."""
    return (F.pmod(F.xxhash64("id", F.lit(seed), *[F.lit(s) for s in salt]), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def _text(size: int, charset: str, seed: int, salt: int) -> Column:
    """``size`` characters; each 40 of them come from one digest."""
    if not size:
        return F.lit("")
    digests = F.concat(*[F.sha2(F.concat_ws("/", F.col("id").cast("string"), F.lit(f"{seed}/{salt}/{k}")), 256) for k in range(-(-size // 32))])
    pairs = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.substring(F.lit(charset), (F.conv(F.substring(digests, k * 2 + 1, F.lit(2)), 16, 10).cast("int") % len(charset)) + 1, F.lit(1)))
    return F.array_join(pairs, "")


def _source(spark: SparkSession, path: str, size: int) -> list[str]:
    """The file's text in runs of ``size`` characters, round its end."""
    found = spark.read.format("binaryFile").load(path).select("length", "path")
    if (held := found.agg(F.sum("length")).first()[0] or 0) > SOURCE_BYTES or not held:
        raise ValueError(f"a source of values has 1 to {SOURCE_BYTES} bytes, this one {held}")
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    text += text * -(-size // len(text))
    return [text[k : k + size] for k in range(0, len(text) - size, max(1, size))]


def _part(p: Part, k: int, seed: int) -> Column:
    span = p.high - p.low + 1
    if p.order == "ascending":
        number = F.lit(p.low) + F.col("id") % span
    elif p.distribution == "zipf":
        # inverse of the continuous law's distribution function
        u, s = _uniform(seed, k), 1 - p.skew
        number = F.lit(p.low) + F.least(F.floor(F.pow(1 + u * (float(span + 1) ** s - 1), 1 / s)) - 1, F.lit(span - 1))
    else:
        number = F.lit(p.low) + F.floor(_uniform(seed, k) * span)
    return render_nanos(number.cast("long")) if p.kind == "timestamp" else F.format_string(p.form, number.cast("long"))


def generate(spark: SparkSession, row: list[Part], columns: list[ColumnSpec], max_bytes: int, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """Cells ``(row, cf, cq, value)`` of about ``max_bytes`` keys and values, the same for a seed.

    A value is ``value_size`` random characters, or as many of the column's ``source``.
    """

    def value(c: ColumnSpec, k: int) -> Column:
        if c.source is None or not c.value_size:
            return _text(c.value_size, c.charset, seed, 2 * k + 1)
        runs = _source(spark, c.source, c.value_size)
        return F.element_at(F.lit(runs), (F.floor(_uniform(seed, 2 * k + 1) * len(runs)) + 1).cast("int"))

    per_row = sum(c.value_size + c.qualifier_size + len(c.family) for c in columns) + 16 * len(row)
    rows = spark.range(max(1, max_bytes // per_row)) if partitions is None else spark.range(0, max(1, max_bytes // per_row), 1, partitions)
    key = F.concat_ws("", *[_part(p, k, seed) for k, p in enumerate(row)])
    parts = F.array(*[F.struct(F.lit(c.family).alias("cf"), _text(c.qualifier_size, "0123456789abcdef", seed, 2 * k).alias("cq"), value(c, k).alias("value")) for k, c in enumerate(columns)])
    return rows.select(key.alias("row"), F.explode(parts).alias("c")).select("row", "c.cf", "c.cq", "c.value")
