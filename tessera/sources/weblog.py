"""Web-server logs in the common and combined formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import render_nanos

# The line's form, and the families that a log table has.
LINE = r'^(\S+)\s+(\S+)\s+(\S+)\s+\[(\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2})[^\]]*\]\s+"((?:[^"\\]|\\.)*)"\s+(\S+)\s+(\S+)(?:\s+"((?:[^"\\]|\\.)*)"\s+"((?:[^"\\]|\\.)*)")?.*$'
#: Between groups of a matched line; no line of text has it.
MARK = "\uffff"
SEPARATED = MARK + MARK.join(f"${k}" for k in range(1, 10))
FAMILIES = {"ClientIpAddress": "ip_address", "UserId": "userid", "Request": "request", "ResponseCode": "response_code", "ObjectSize": "object_size", "Referer": "referer", "UserAgent": "user_agent"}


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row a well-formed line: ip_address, userid, ts (nanoseconds), request, response_code, object_size, referer, user_agent.

    A dash or a missing field is null; lines of another form are left out.
    """
    # one match a line: its groups with a mark between them, or null
    matched = lines.select(F.regexp_replace(F.col(column), LINE, SEPARATED).alias("m")).filter(F.col("m").startswith(MARK))
    matched = matched.select(F.split("m", MARK).alias("p"))
    part = lambda k: F.get(F.col("p"), F.lit(k))
    known = lambda c: F.when((c != "-") & (c != ""), c)
    stamp = F.try_to_timestamp(F.concat(F.initcap(F.lpad(part(4), 20, "0")), F.lit(" UTC")), F.lit("dd/MMM/yyyy:HH:mm:ss z"))
    rows = matched.select(
        part(1).alias("ip_address"),
        known(part(3)).alias("userid"),
        (F.unix_micros(stamp) * 1000).alias("ts"),
        part(5).alias("request"),
        known(part(6)).alias("response_code"),
        known(part(7)).alias("object_size"),
        known(part(8)).alias("referer"),
        known(part(9)).alias("user_agent"),
    )
    return rows.filter(F.col("ts").isNotNull())


def page_of(request: Column) -> Column:
    """What a GET asks for, up to the next space; ``-`` for other requests."""
    return F.when(request.startswith("GET "), F.substring_index(F.substring(request, F.lit(5), F.length(request)), " ", 1)).otherwise(F.lit("-"))


def log_cells(entries: DataFrame, time_order: bool = False) -> DataFrame:
    """Cells ``(row, cf, cq, ts, value)``; the key is page and time, or with ``time_order`` time and page."""
    when, page = F.substring(render_nanos(F.col("ts")), 1, 19), page_of(F.col("request"))
    key = F.concat_ws(" ", when, page) if time_order else F.concat_ws(" ", page, when)
    parts = F.array(*[F.struct(F.lit(f).alias("cf"), F.col(c).alias("value")) for f, c in FAMILIES.items()])
    long = entries.select(key.alias("row"), F.explode(parts).alias("c"))
    return long.filter(F.col("c.value").isNotNull()).select("row", "c.cf", F.lit("").alias("cq"), F.lit(None).cast("long").alias("ts"), "c.value")
