"""Flatten KB entries to (kb, cve, month) rows, runtime restriction, dedupe, counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetrisk.functions.ids import CVE_PATTERN, is_cve_id, normalise_id, strip_ws
from fleetrisk.operators.joins import saved
from fleetrisk.operators.policy import long_metrics

TRAINING_KEYS = ("kb_id", "cve_id", "month")
RUNTIME_KEYS = ("scan_id", "kb_id", "cve_id", "month")


def _complete(kb="kb_id"):
    """Entry has a KB id, at least one month and at least one CVE."""
    return ((F.coalesce(F.col(kb), F.lit("")) != "")
            & (F.coalesce(F.size("months"), F.lit(0)) > 0)
            & (F.coalesce(F.size("cves"), F.lit(0)) > 0))


def restrict_to_missing(kb_entry: DataFrame, missing: DataFrame, scan_col: str = "scan_id") -> DataFrame:
    """Runtime restriction: keep entries whose KB is in the scan's missing set (semi join)."""
    m = missing.select(scan_col, normalise_id("kb_id").alias("kb_id")).where(F.col("kb_id") != "")
    return kb_entry.withColumn("kb_id", normalise_id("kb_id")).join(m, [scan_col, "kb_id"], "left_semi")


def flatten(kb_entry: DataFrame, missing: DataFrame | None = None, scan_col: str = "scan_id") -> DataFrame:
    """Per complete entry, every valid CVE x every month -> (scan_id, kb_id, cve_id, month).

    Entries are restricted (runtime) before the explode so the filter runs on
    the narrow table. Invalid CVE ids are dropped; ``explode`` drops empty arrays.
    """
    e = kb_entry.withColumn("kb_id", normalise_id("kb_id"))
    if missing is not None:
        e = restrict_to_missing(e, missing, scan_col)
    e = e.where(_complete())
    cves = e.select(scan_col, "kb_id", "months", F.explode("cves").alias("cve_raw"))
    cves = (cves.select(scan_col, "kb_id", "months", normalise_id("cve_raw").alias("cve_id"))
            .where(F.col("cve_id").rlike(CVE_PATTERN)))  # already normalised: one regex per CVE
    rows = cves.select(scan_col, "kb_id", "cve_id", F.explode("months").alias("month"))
    return rows.withColumn("month", strip_ws("month"))


def dedupe(flat: DataFrame, keys=TRAINING_KEYS) -> DataFrame:
    """Distinct on the key columns (partial + final aggregate)."""
    return flat.select(*keys).dropDuplicates(list(keys))


def flatten_counters(kb_entry: DataFrame, deduped: DataFrame, missing: DataFrame | None = None,
                     scan_col: str = "scan_id") -> DataFrame:
    """Long table of flatten counters.

    raw_rows_created, skipped_kb_entries (= not missing + incomplete),
    skipped_not_missing, skipped_incomplete, skipped_non_cve_ids, missing_kbs_total,
    rows_created, duplicate_rows_removed. Raw rows are counted from array sizes,
    without exploding.
    """
    e = kb_entry.withColumn("kb_id", normalise_id("kb_id"))
    if missing is not None:
        m = (missing.select(scan_col, normalise_id("kb_id").alias("kb_id")).where(F.col("kb_id") != "")
             .distinct().withColumn("_missing", F.lit(True)))
        e = e.join(m, [scan_col, "kb_id"], "left").withColumn("_keep", F.coalesce("_missing", F.lit(False)))
    else:
        e = e.withColumn("_keep", F.lit(True))
    valid = F.col("_keep") & _complete()
    good = F.size(F.filter("cves", lambda x: is_cve_id(x)))
    bad = F.size(F.filter("cves", lambda x: ~is_cve_id(x)))
    frames = [e.agg(
        F.coalesce(F.sum(F.when(valid, good * F.size("months"))), F.lit(0)).alias("raw_rows_created"),
        F.count_if(~F.col("_keep")).alias("skipped_not_missing"),
        F.count_if(F.col("_keep") & ~_complete()).alias("skipped_incomplete"),
        F.count_if(~valid).alias("skipped_kb_entries"),
        F.coalesce(F.sum(F.when(valid, bad)), F.lit(0)).alias("skipped_non_cve_ids"),
    ), deduped.agg(F.count(F.lit(1)).alias("rows_created"))]
    if missing is not None:
        frames.append(missing.select(scan_col, normalise_id("kb_id").alias("kb_id")).where(F.col("kb_id") != "")
                      .distinct().agg(F.count(F.lit(1)).alias("missing_kbs_total")))
    return long_metrics(*frames, derived={"duplicate_rows_removed": "raw_rows_created - rows_created"})


def scope_counts(flat: DataFrame) -> DataFrame:
    """Distinct KBs, CVEs, months and row count (one row): three narrow distincts side by side.

    The rows are saved first, or each of the four counts would build them again."""
    flat = saved(flat.select("kb_id", "cve_id", "month"))
    parts = [flat.select(c).distinct().agg(F.count(c).alias("n")).select(F.lit(name).alias("name"), "n")
             for c, name in (("kb_id", "unique_kbs"), ("cve_id", "unique_cves"), ("month", "unique_months"))]
    parts.append(flat.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("name"), "n"))
    out = reduce(DataFrame.unionByName, parts)
    return out.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in ("unique_kbs", "unique_cves", "unique_months", "rows")])


def source_summary(kb_entry: DataFrame, missing: DataFrame, scan_col: str = "scan_id") -> DataFrame:
    """Per scan: number of KB entries and of distinct missing KBs."""
    entries = kb_entry.groupBy(scan_col).agg(F.count(F.lit(1)).alias("kb_entries"))
    miss = (missing.select(scan_col, normalise_id("kb_id").alias("kb_id")).where(F.col("kb_id") != "")
            .groupBy(scan_col).agg(F.countDistinct("kb_id").alias("missing_kbs")))
    return (entries.join(miss, scan_col, "left")
            .select(scan_col, F.coalesce("kb_entries", F.lit(0)).alias("kb_entries"),
                    F.coalesce("missing_kbs", F.lit(0)).alias("missing_kbs")))
