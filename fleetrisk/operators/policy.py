"""Explainable additive risk policy, labelling and validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetrisk.functions.cvss import exploited
from fleetrisk.functions.ids import is_cve_id, metric_is, normalise_id, safe_double

# fixed values: policy weights, thresholds and driver texts
EXPLOITATION_BONUS = 2.0
NETWORK_ATTACK_VECTOR_BONUS = 1.0
NO_PRIVILEGES_REQUIRED_BONUS = 0.5
NO_USER_INTERACTION_BONUS = 0.5
HIGH_IMPACT_BONUS = 0.5
MAX_PATCH_AGE_BONUS = 2.0
PATCH_AGE_DIVISOR_DAYS = 90
HIGH_PRIORITY_THRESHOLD = 9.0
MEDIUM_PRIORITY_THRESHOLD = 6.0
HIGH_CVSS_DRIVER_THRESHOLD = 7.0
DEFAULT_DRIVER = "baseline CVSS exposure"
DRIVER_TEXT = {
    "critical": "critical CVSS",
    "high": "high CVSS",
    "exploited": "exploitation signal",
    "network": "network attack vector",
    "no_privileges": "no privileges required",
    "no_interaction": "no user interaction",
    "impact": "high impact",
    "age": "patch age exposure",
}


@dataclass(frozen=True)
class Thresholds:
    high: float = HIGH_PRIORITY_THRESHOLD
    medium: float = MEDIUM_PRIORITY_THRESHOLD


def age_bonus(age) -> Column:
    """min(max(age, 0) / 90, 2.0); missing age -> 0."""
    a = F.greatest(safe_double(age), F.lit(0.0))
    return F.least(a / F.lit(float(PATCH_AGE_DIVISOR_DAYS)), F.lit(MAX_PATCH_AGE_BONUS))


def impact_bonus(c, i, a) -> Column:
    return F.when(metric_is(c, "H") | metric_is(i, "H") | metric_is(a, "H"),
                  F.lit(HIGH_IMPACT_BONUS)).otherwise(F.lit(0.0))


def additive_score(base: Column, rules: list[tuple[Column, float]], extra: list[Column] = ()) -> Column:
    """base + weight of every rule whose predicate holds + extra terms, added left to right."""
    total = base
    for predicate, weight in rules:
        total = total + F.when(predicate, F.lit(weight)).otherwise(F.lit(0.0))
    for term in extra:
        total = total + term
    return total


def priority_label(risk, thresholds: Thresholds = Thresholds()) -> Column:
    r = F.col(risk) if isinstance(risk, str) else risk
    return (F.when(r >= thresholds.high, "High").when(r >= thresholds.medium, "Medium")
            .otherwise("Low"))


def policy_columns(cvss="cvss_score", exploitation="exploitation", av="attack_vector",
                   pr="privileges_required", ui="user_interaction", c="confidentiality_impact",
                   i="integrity_impact", a="availability_impact", age="patch_age_days",
                   thresholds: Thresholds = Thresholds()) -> dict[str, Column]:
    """policy_risk, policy_priority, policy_drivers, top_driver as column expressions."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    score = safe_double(col(cvss))
    is_exploited = exploited(col(exploitation))
    network = metric_is(col(av), "N")
    no_priv = metric_is(col(pr), "N")
    no_ui = metric_is(col(ui), "N")
    impact = impact_bonus(col(c), col(i), col(a))
    ageb = age_bonus(col(age))
    risk = F.round(additive_score(score, [
        (is_exploited, EXPLOITATION_BONUS),
        (network, NETWORK_ATTACK_VECTOR_BONUS),
        (no_priv, NO_PRIVILEGES_REQUIRED_BONUS),
        (no_ui, NO_USER_INTERACTION_BONUS),
    ], [impact, ageb]), 2)
    drivers = F.array_compact(F.array(
        F.when(score >= thresholds.high, F.lit(DRIVER_TEXT["critical"]))
         .when(score >= HIGH_CVSS_DRIVER_THRESHOLD, F.lit(DRIVER_TEXT["high"])),
        F.when(is_exploited, F.lit(DRIVER_TEXT["exploited"])),
        F.when(network, F.lit(DRIVER_TEXT["network"])),
        F.when(no_priv, F.lit(DRIVER_TEXT["no_privileges"])),
        F.when(no_ui, F.lit(DRIVER_TEXT["no_interaction"])),
        F.when(impact > 0, F.lit(DRIVER_TEXT["impact"])),
        F.when(ageb >= 1.0, F.lit(DRIVER_TEXT["age"])),
    ))
    drivers = F.when(F.size(drivers) > 0, drivers).otherwise(F.array(F.lit(DEFAULT_DRIVER)))
    return {
        "policy_risk": risk,
        "policy_priority": priority_label(risk, thresholds),
        "policy_drivers": drivers,
        "top_driver": F.coalesce(F.get(drivers, 0), F.lit(DEFAULT_DRIVER)),
    }


def apply_policy(df: DataFrame, thresholds: Thresholds = Thresholds(), **columns) -> DataFrame:
    """Adds policy_risk, policy_priority, policy_drivers, top_driver in one projection."""
    cols = policy_columns(thresholds=thresholds, **columns)
    return (df.withColumns({"policy_risk": cols["policy_risk"], "policy_drivers": cols["policy_drivers"]})
            .withColumns({"policy_priority": priority_label("policy_risk", thresholds),
                          "top_driver": F.coalesce(F.get(F.col("policy_drivers"), 0), F.lit(DEFAULT_DRIVER))}))


def label(df: DataFrame) -> DataFrame:
    """Training targets copied from the policy outputs."""
    return df.withColumns({"risk_score": F.col("policy_risk"), "priority_label": F.col("policy_priority")})


def ensure_columns(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """Add absent required columns as typed nulls."""
    missing = {name: F.lit(None).cast(dtype) for name, dtype in required.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


REQUIRED = {"cvss_score": "double", "attack_vector": "string"}
DEDUP_KEYS = ("kb_id", "cve_id", "month")


def validate(df: DataFrame, keys=DEDUP_KEYS, required: dict[str, str] = REQUIRED,
             assume_unique: bool = False, ids_checked: bool = False) -> DataFrame:
    """Normalise ids, keep CVE rows, drop rows missing a required field, dedupe on keys.

    ``assume_unique`` skips the final dedupe when the caller guarantees the rows
    are already distinct on ``keys`` (e.g. deduplicated flat rows joined
    many-to-one to a dimension keyed by cve_id). The result is the same; the
    dedupe would otherwise be a sort-based aggregate over every wide row, since
    its keep-first buffers are variable-length. ``ids_checked`` skips the id
    normalisation and CVE filter for rows that come straight from ``flatten``
    (which already normalised ids and dropped non-CVE ids).
    """
    out = df
    if not ids_checked:
        out = out.withColumns({"cve_id": normalise_id("cve_id"), "kb_id": normalise_id("kb_id")})
        out = out.where(is_cve_id("cve_id"))
    out = ensure_columns(out, required)
    out = out.dropna(subset=list(required))
    return out if assume_unique else out.dropDuplicates(list(keys))


def rejected(df: DataFrame, required: dict[str, str] = REQUIRED) -> DataFrame:
    """Side table of rows validation drops, with the first reason."""
    out = ensure_columns(df, required)
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(name).isNull()
    reason = (F.when(~is_cve_id("cve_id"), "not a CVE id")
              .when(missing, "missing required field"))
    return out.withColumn("reject_reason", reason).where(F.col("reject_reason").isNotNull())


def validation_counters(df: DataFrame, required: dict[str, str] = REQUIRED, keys=DEDUP_KEYS) -> DataFrame:
    """rows_before, non_cve_rows_removed, rows_missing_required_fields, duplicate_rows_removed, rows_after, rows_dropped.

    One pass: rows are counted per key, and the sums are over keys. Returned in long form (metric, value).
    """
    src = ensure_columns(df, required)
    cve_ok = is_cve_id("cve_id")
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(name).isNull()
    ids = {"kb_id", "cve_id", "scan_id"}
    each = src.select(*[(normalise_id(k) if k in ids - {"scan_id"} else F.col(k)).alias(k) for k in keys],
                      (~cve_ok).cast("long").alias("_bad"), (cve_ok & missing).cast("long").alias("_missing"))
    counted = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.sum("_bad").alias("_bad"), F.sum("_missing").alias("_missing"))
    kept = F.col("_rows") - F.col("_bad") - F.col("_missing")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = counted.agg(total("_rows").alias("rows_before"), total("_bad").alias("non_cve_rows_removed"),
                      total("_missing").alias("rows_missing_required_fields"),
                      total(F.greatest(kept - 1, F.lit(0))).alias("duplicate_rows_removed"),
                      F.count_if(kept > 0).alias("rows_after"))
    return long_metrics(out.withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after")))


def long_metrics(*one_row_frames: DataFrame, derived: dict[str, str] | None = None,
                 drop: list[str] = ()) -> DataFrame:
    """Combine one-row aggregate frames into a (metric, value) long table.

    Frames are stacked to long form and unioned; derived metrics are computed by
    a final pivot-free aggregate over the union (no cartesian product).
    """
    parts = []
    all_names = [c for frame in one_row_frames for c in frame.columns]
    for frame in one_row_frames:
        names = frame.columns
        stack = "stack({n}, {pairs}) as (metric, value)".format(
            n=len(names), pairs=", ".join(f"'{c}', cast(`{c}` as bigint)" for c in names))
        parts.append(frame.selectExpr(stack))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if derived:
        wide = out.groupBy().pivot("metric", all_names).agg(F.first("value"))
        extra = wide.selectExpr(*[f"cast({expr} as bigint) as `{name}`" for name, expr in derived.items()])
        names = list(derived)
        extra = extra.selectExpr("stack({n}, {pairs}) as (metric, value)".format(
            n=len(names), pairs=", ".join(f"'{c}', `{c}`" for c in names)))
        out = out.unionByName(extra)
    if drop:
        out = out.where(~F.col("metric").isin(*drop))
    return out
