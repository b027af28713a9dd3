"""Line dedup by site-relative frequency, with DataFrame functions only.

A line is boilerplate of a host if it stands on more than ``RATIO`` of the host's
pages.  Only hashes of lines are grouped, with partial sums before the shuffle;
each host's boilerplate comes back as one array (a host has at most its mean
number of lines a page divided by the ratio), so texts are not shuffled where
that table is small enough for Spark to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, fresh, written

#: A line on more than this part of its host's pages goes, whatever the host's size.
RATIO = 0.02
#: A line that stands on one page repeats nothing, whatever part of a small host that page is.
REPEATED = 2


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """``(site, gone)``: of each host, the hashes of its boilerplate lines."""
    rows = docs.select(F.col(host_col).alias("site"), F.col(text_col).alias("text"))
    pages = rows.groupBy("site").agg(F.count("*").alias("pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key))
    seen = rows.select("site", F.explode(keys).alias("line")).groupBy("site", "line").agg(F.count("*").alias("n"))
    often = written(seen.filter(F.col("n") >= REPEATED), "often")
    sites = written(pages.withColumnRenamed("site", "of"), "sites")
    found = often.join(sites, F.col("site").eqNullSafe(F.col("of"))).filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    out = written(found.groupBy("site").agg(F.sort_array(F.collect_list("line")).alias("gone")), "boilerplate")
    discard(often, sites)
    return out


def _kept(text: Column, gone: Column) -> Column:
    """The lines of ``text`` that aren't boilerplate, as an array."""
    # a host's boilerplate is a short array (see above); intersecting it with the page's lines first costs more
    return F.filter(_lines(text), lambda x: (F.trim(x) == "") | ~F.array_contains(gone, _key(x)))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """``docs`` without the boilerplate lines of each document's host.

    Lines end at ``\\n``, are compared without spaces around them, and count once a
    page; blank lines always stay.  What stays is joined again by ``\\n``.  All
    documents and columns stay: a text of nothing but boilerplate becomes empty,
    null stays null, ``n_chars``, where there is such a column, follows the text.
    A line goes if it stands on more than ``ratio`` of its host's pages and on two of
    them at least; nothing depends on how many pages the host has, so on one of fewer than
    ``1 / ratio`` pages every line that repeats goes.
    A null host is a host of its own.  Repeated rows count as pages.  Lines are
    told apart by 64-bit hashes within a host.
    """
    site_, gone_ = fresh(docs, "site", "gone")
    gone = boilerplate(docs, host_col, text_col, ratio).select(F.col("site").alias(site_), F.col("gone").alias(gone_))
    both = docs.join(gone, docs[host_col].eqNullSafe(gone[site_]), "left")
    none = F.col(gone_).isNull()
    clean = F.when(none, F.col(text_col)).otherwise(F.array_join(_kept(F.col(text_col), F.col(gone_)), "\n"))
    out = both.withColumn(text_col, clean)
    if "n_chars" in docs.columns:
        counted = F.length(text_col).cast(dict(docs.dtypes)["n_chars"])
        out = out.withColumn("n_chars", F.when(none | F.col(text_col).isNull(), F.col("n_chars")).otherwise(counted))
    return out.select(*[F.col(c) for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", ratio: float = RATIO) -> DataFrame:
    """``(doc_id, text, n_lines, n_dropped)`` after :func:`drop_boilerplate`, a row for each document."""
    gone = boilerplate(docs, host_col, text_col, ratio)
    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("of"), F.col(text_col).alias("text"))
    both = raw.join(gone, F.col("of").eqNullSafe(F.col("site")), "left")
    lines = _lines(F.col("text"))
    kept = F.when(F.col("gone").isNull(), lines).otherwise(_kept(F.col("text"), F.col("gone")))
    done = both.withColumn("kept", kept)
    n = F.coalesce(F.size(lines), F.lit(0))
    return done.select("doc_id", F.array_join("kept", "\n").alias("text"), F.when(F.col("text").isNull(), 0).otherwise(n).alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(n - F.size("kept")).alias("n_dropped"))
