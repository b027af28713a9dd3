"""From raw documents to token ids, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``; all but the last
return the columns of ``documents``.  Each stage docstring says what it does with
its rows; nulls, empty texts, repeated rows and empty tables are defined with the
operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, linededup, quality, sentencepiece, simhash
from tessera.llm.shared import discard, read_table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, trained on ``labels``, rejects.

    Null and empty texts are judged as texts of no characters, repeated rows alike; without labels
    everything stays, and an empty table stays empty.
    """
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that are boilerplate of their source, however few its pages; all documents stay.

    Null texts stay null, a text of boilerplate alone becomes empty, repeated rows count as pages, and
    an empty table stays empty.
    """
    return linededup.drop_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each component of near duplicates.

    Five-word shingles and a Jaccard similarity of 0.8 or more, which exact sets decide; 256-bit
    fingerprints give the candidates.  Null, empty and blank texts are copies of each other; rows
    without an id all stay; of repeated rows one stays, of unlike texts under one id each that nothing
    with a smaller id is similar to; an empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which an item of ``benchmark`` stands.

    Nothing stands in null and empty texts, repeated rows are judged alike, empty items match nothing,
    and an empty table stays empty.
    """
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left; none for null and empty texts, repeated rows a row each."""
    return sentencepiece.encode_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: SQL has neither XXH64 fingerprints nor the segmentation; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        then, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(then)
    return STAGES[-1][1](spark, docs, sf_dir)
