"""Registered queries of this subpackage: each applies its operator to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetrisk.llm import (conversations, decontaminate, langid, neardup, packing, quality, secrets, spotsigs, substrings, token_counts,
                           token_files, warc, whitening)
from fleetrisk.llm.common import table


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=decontaminate.SLOP)
    return found.drop("text_hash")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"))


#: op9_quality draws this share of the kept texts; with all of them the draw would decide nothing
DRAWN_SHARE = 0.5


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), DRAWN_SHARE)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return whitening.digest(whitening.transform(embeddings, whitening.fit(embeddings)))


QUERIES = {f.__name__: f for f in (op1_neardup, op2_warc, op3_packing, op4_langid, op5_spotsigs, op6_secrets, op7_decontaminate, op8_substrings,
                                   op9_quality, op10_token_counts, op11_token_files, op12_conversations, op13_whitening)}
ORACLE = {"op1_neardup": neardup.ORACLE, "op2_warc": warc.ORACLE, "op8_substrings": substrings.ORACLE, "op6_secrets": secrets.ORACLE, "op7_decontaminate": decontaminate.ORACLE}
