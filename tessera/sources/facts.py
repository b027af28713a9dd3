"""Topic dumps: a tab-separated file with a topic a line, into name, category and property."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fact_cells(topics: DataFrame, category: str, key: str = "id", name: str = "name") -> DataFrame:
    """Cells ``(row, cf, cq, ts, value)`` of topics.

    Each topic has its name, the dump's category, and a property, qualified by the
    column, for each other field; empty and null fields make no cell.  Topics without
    a key are left out.
    """
    cell = lambda cf, cq, value: F.struct(F.lit(cf).alias("cf"), F.lit(cq).alias("cq"), value.cast("string").alias("value"))
    properties = [cell("property", c, F.col(c)) for c in topics.columns if c not in (key, name)]
    parts = F.array(cell("name", "", F.col(name)), cell("category", "", F.lit(category)), *properties)
    long = topics.select(F.col(key).cast("string").alias("row"), F.explode(parts).alias("c"))
    return long.filter((F.col("row") != "") & (F.col("c.value") != "")).select("row", "c.cf", "c.cq", F.lit(None).cast("long").alias("ts"), "c.value")
