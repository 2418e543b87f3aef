"""A corpus through five stages: language ID, near-duplicate join, decontamination, PII, packing.

Each stage takes all that the one before it kept, and its decisions take effect: documents go, or their text
changes; the last returns the packed pieces. Between stages the documents are a Parquet table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontam, jaccard, langid, packing, pii
from corpusloom.llm.common import Scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in a language that the classifier doesn't know.

    These are null and empty texts, texts without a letter, and texts of 40 letters or more that none of the
    one-versus-rest classifiers claims. Shorter texts stay. Where no document is labelled there is nothing to
    learn from, and only letters decide. A text of any length is read whole; null and repeated ids and repeated
    rows are judged row by row, equal texts alike. An empty table gives an empty table.
    """
    return langid.accept(docs, langid.fit(langid.learnable(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component: that with the smallest doc_id, of rows that repeat it that with the smallest text.

    Rows with a null id, and texts without words, resemble nothing and stay. Very long texts count whole. An
    empty table gives an empty table.
    """
    return jaccard.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item.

    Rows are judged by their texts, so equal rows go or stay together, whatever their ids. Null and empty texts
    hold nothing and stay; a long text counts whole. An empty table, or benchmark, rejects nothing.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; every document stays.

    Null texts stay null, empty ones empty; ids play no part; long texts are read whole.
    """
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in sequences, as op1 reports them.

    A null or empty text is one piece that holds the end id; rows that repeat an id are packed each; a long text
    is cut into windows. An empty table gives no pieces.
    """
    return packing.digest(packing.pack(docs))


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("pii", without_pii), ("packing", packed)]

#: A learned classifier and a tokeniser are no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
