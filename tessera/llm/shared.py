"""Tables in the cluster's shared folder, and other plumbing of the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_dir

def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again.

    It cuts the lineage: what follows neither computes ``df`` twice nor loses it
    with an executor.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path  # for discard()
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more; other frames are passed over."""
    for df in frames:
        path = getattr(df, "_tessera_path", None)
        if path:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until ``docs`` has no such column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n in taken:
            n += "_"
        out.append(n)
    return out


def text_bytes(col) -> F.Column:
    """UTF-8 bytes of a text column, empty for null."""
    return F.coalesce(col, F.lit("")).cast("binary")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
