"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; every stage but the
last returns the columns of documents. Between stages the rows are written as Parquet to the shared
folder and read again, so a lost executor repeats part of one stage only.

In every stage: null and empty texts, very long texts (never cut), ties, repeated rows, an empty table
and extra columns of any name are handled as the operator's docstring says; whole rows pass on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetrisk.llm import decontaminate, langid, neardup, packing, secrets
from fleetrisk.llm.common import prepare, stored, table

#: five stages share executors and their Python workers, so texts go to them in batches of so many bytes, smaller than a single operator's
BATCH_BYTES = 2 << 20
#: the near-dedup stage links texts whose shingle sets have this Jaccard similarity, in percent, or more
NEAR_PERCENT = 80


def _ready(spark: SparkSession) -> None:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; null texts, those without letters and those far from every centroid go."""
    _ready(spark)
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near duplicates of NEAR_PERCENT or more.

    A repeated row stays once; texts without words are alone, and rows without a doc_id stay.
    """
    _ready(spark)
    return neardup.keep_one(docs, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; texts without words are clean."""
    benchmark = table(spark, sf_dir, "benchmark")
    _ready(spark)
    return decontaminate.drop_contaminated(docs, benchmark)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with reported secrets masked in their texts; null texts stay null."""
    _ready(spark)
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of a power of two tokens, with their ids; a null or empty text is its end id alone."""
    _ready(spark)
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("packing", pack_sequences)]

#: clustering, banded hashing and tokenizing can't be written in SQL; tests/llm/test_pipeline.py compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
