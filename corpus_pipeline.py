"""A corpus pipeline of five stages over ``documents``; counted as part of the ``llm`` subpackage.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import decontaminate, pii, sentencepiece_fst, simhash, toxicity
from causeway.llm.common import remainder_of_id, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; learnt from labels outside the held-out fold. Null and empty texts stay; repeated
    rows stay or go together; extra columns stay; an empty table stays empty; without labels nothing goes."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.keep_clean(docs, labels.where(remainder_of_id("doc_id", 5) != 0))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates. Null and empty texts are one group; of repeated
    rows one stays; a null id stays only where its group has no other; extra columns stay; an empty table stays empty."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage. Null and empty texts stay; repeated rows stay or go together; extra columns
    stay; with an empty benchmark, or on an empty table, nothing goes."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in square brackets and ``n_chars`` brought up to date. Null texts
    stay null and empty ones empty; repeated rows are each redacted; extra columns of any name stay as they were."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as piece ids, with id, language and source. Null and empty texts have no ids; repeated rows are each
    encoded; other columns are left behind; an empty table gives an empty result."""
    out = sentencepiece_fst.encode(docs, ["doc_id", "lang", "source"])
    names = [F.col(f"c{i}").alias(c) for i, c in enumerate(("doc_id", "lang", "source"))]
    return out.select(*names, "n_tokens", "n_byte_tokens", "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pii", redact_personal_data),
    ("sentencepiece", encode),
]

#: SQL has no 64-bit xxHash and no shortest path through a transducer; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
