"""Enrichment of flattened rows with CVE metadata (dimension-first scoring)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetrisk.functions.cvss import parse_cvss, patch_age_days
from fleetrisk.functions.ids import is_cve_id, normalise_id
from fleetrisk.operators.joins import join_dimension
from fleetrisk.operators.policy import Thresholds, apply_policy, long_metrics, policy_columns
from fleetrisk.schemas import CVSS_METRICS

META_COLUMNS = ("cvss_score", "severity", "published_date", "patch_age_days", "exploitation") + CVSS_METRICS
POLICY_COLUMNS = ("policy_risk", "policy_priority", "policy_drivers", "top_driver")


def prepare_dimension(cve_meta: DataFrame, as_of: Column) -> DataFrame:
    """One row per CVE: normalised id, parsed vector, patch age.

    Keys are normalised and restricted to valid CVE ids. If a CVE occurs more
    than once the caller resolves it first (see sources.advisory.last_wins).
    """
    m = cve_meta.select(
        normalise_id("cve_id").alias("cve_id"),
        F.col("base_score").cast("double").alias("cvss_score"),
        "severity", "published_date",
        patch_age_days(F.col("published_date"), as_of).alias("patch_age_days"),
        "exploitation",
        *[c.alias(name) for name, c in parse_cvss(F.col("vector")).items()],
    )
    return m.where(is_cve_id("cve_id"))


def score_dimension(dim: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Policy outputs depend only on CVE metadata and as_of: score each CVE once."""
    return apply_policy(dim, thresholds)


def _unmatched_policy(thresholds: Thresholds) -> dict[str, Column]:
    """Policy of a row without metadata (all inputs null): constant-folded by Catalyst."""
    null = F.lit(None).cast("string")
    cols = policy_columns(cvss=null, exploitation=null, av=null, pr=null, ui=null, c=null, i=null,
                          a=null, age=F.lit(None).cast("int"), thresholds=thresholds)
    return {"policy_risk": cols["policy_risk"], "policy_priority": cols["policy_priority"],
            "policy_drivers": cols["policy_drivers"], "top_driver": cols["top_driver"]}


def enrich(flat: DataFrame, dim: DataFrame, measured: bool = False,
           scored: bool = False, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """flat LEFT JOIN dimension on normalised cve_id; unmatched rows keep null metadata.

    The dimension is broadcast when its measured size allows (``measured``: the caller
    did that), so the fact side is not shuffled. With ``scored`` the dimension already holds
    the policy columns; unmatched rows get the policy of an all-null row.
    """
    f = flat.withColumns({"kb_id": normalise_id("kb_id"), "cve_id": normalise_id("cve_id")})
    d = dim.withColumn("_matched", F.lit(True))
    out = join_dimension(f, d, "cve_id", "left", measured=measured)
    if scored:
        default = _unmatched_policy(thresholds)
        out = out.withColumns({c: F.when(F.col("_matched"), F.col(c)).otherwise(default[c]) for c in POLICY_COLUMNS})
    return out.drop("_matched")


def coverage(flat: DataFrame, dim: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """requested, matched (semi join) and missing (anti join) distinct CVE ids."""
    requested = flat.select(normalise_id("cve_id").alias("cve_id")).where(is_cve_id("cve_id")).distinct()
    keys = dim.select("cve_id")
    return requested, requested.join(keys, "cve_id", "left_semi"), requested.join(keys, "cve_id", "left_anti")


def enrich_counters(flat: DataFrame, dim: DataFrame) -> DataFrame:
    """requested/matched/missing CVEs, metadata rows, rows with score / vector, model rows.

    All come from rows counted per CVE, fully joined to the dimension: the flat rows are
    read once, and every sum is over CVEs.
    """
    rows = flat.groupBy(normalise_id("cve_id").alias("cve_id")).agg(F.count(F.lit(1)).alias("rows"))
    meta = dim.select("cve_id", F.lit(True).alias("_meta"), "cvss_score", "attack_vector")
    each = rows.join(meta, "cve_id", "full").withColumns({"rows": F.coalesce("rows", F.lit(0)), "_meta": F.coalesce("_meta", F.lit(False))})
    requested = (F.col("rows") > 0) & is_cve_id("cve_id")
    score, vector = F.col("cvss_score").isNotNull(), F.col("attack_vector").isNotNull()
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("rows"))), F.lit(0))
    return long_metrics(each.agg(
        F.count_if("_meta").alias("metadata_cves_returned"),
        F.count_if(requested).alias("requested_cves"),
        F.count_if(requested & F.col("_meta")).alias("matched_cves"),
        F.count_if(requested & ~F.col("_meta")).alias("missing_metadata_cves"),
        total(F.lit(True)).alias("rows_enriched"), total(score).alias("rows_with_cvss_score"),
        total(vector).alias("rows_with_attack_vector"), total(score & vector).alias("rows_with_model_metadata")))


def first_missing(flat: DataFrame, dim: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` CVE ids without metadata, sorted (top-k: TakeOrderedAndProject)."""
    return coverage(flat, dim)[2].orderBy("cve_id").limit(n)
