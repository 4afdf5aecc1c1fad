"""Host baseline operators: month windows, latest month, LCU context, inventory, product names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk.functions.ids import kb_id_strict, normalise_id, strip_ws
from fleetrisk.functions.months import month_id, month_range, month_span, parse_month_id

MAX_MONTHS = 48
REASON_NOT_ADMIN = "Baseline collected without administrative privileges"
REASON_NO_START = "Baseline did not provide LcuMonthId"
REASON_BAD_END = "MsrcLatestMonthId is not a month"
ROLLUP_MARK = "RollupFix"


def month_window(baselines: DataFrame, max_months: int = MAX_MONTHS, key: str = "scan_id") -> tuple[DataFrame, DataFrame]:
    """(months, rejects). months: one row per (host, position, month id) from the LCU
    month to the latest feed month (start clamped to end, oldest ``max_months``
    kept, ``truncated`` flags a cut); end defaults to the current month.
    rejects: hosts without admin rights, without a start month or with an end
    that is not a month, with the reason."""
    end = F.coalesce(F.col("MsrcLatestMonthId"), month_id(F.current_date()))
    ok_start = parse_month_id("LcuMonthId").isNotNull()
    reason = (F.when(~F.coalesce(F.col("IsAdmin"), F.lit(False)), REASON_NOT_ADMIN)
              .when(~ok_start, REASON_NO_START)
              .when(parse_month_id(end).isNull(), REASON_BAD_END))
    b = baselines.withColumn("_reason", reason)
    rejects = b.where(F.col("_reason").isNotNull()).select(key, F.col("_reason").alias("reason"))
    ok = b.where(F.col("_reason").isNull())
    months = ok.select(key, F.posexplode(month_range(F.col("LcuMonthId"), end, max_months)).alias("pos", "month_id"),
                       (month_span(F.col("LcuMonthId"), end) > max_months).alias("truncated"))
    return months.withColumn("pos", F.col("pos") + 1).select(key, "pos", "month_id", "truncated"), rejects


def latest_month(months: DataFrame, key: str = "scan_id", col: str = "month") -> DataFrame:
    """Per host the newest valid month id by parsed date (not by text)."""
    m = months.select(key, strip_ws(col).alias("_m")).withColumn("_d", parse_month_id("_m"))
    return m.where(F.col("_d").isNotNull()).groupBy(key).agg(F.max_by("_m", "_d").alias("latest_month_id"))


def lcu_context(packages: DataFrame, baselines: DataFrame, key: str = "scan_id") -> DataFrame:
    """Newest-installed cumulative update package per host: month id, name, time.
    Hosts without admin rights get nulls (their package list is not readable)."""
    p = packages.where(F.col("package_name").contains(ROLLUP_MARK))
    best = p.groupBy(key).agg(F.max(F.struct("install_time", "package_name")).alias("_b"))  # equal times: the last name
    b = baselines.select(key, "IsAdmin").join(best, key, "left")
    admin = F.coalesce(F.col("IsAdmin"), F.lit(False))
    return b.select(key,
                    F.when(admin, month_id("_b.install_time")).alias("lcu_month_id"),
                    F.when(admin, F.col("_b.package_name")).alias("lcu_package_name"),
                    F.when(admin, F.col("_b.install_time")).alias("lcu_install_time"))


def inventory(hotfix: DataFrame, packages: DataFrame, baselines: DataFrame, key: str = "scan_id") -> DataFrame:
    """Installed KB set per host: hot-fix ids union package KBs (name, else description),
    packages only for hosts with admin rights; distinct."""
    hf = hotfix.select(key, kb_id_strict(F.col("hotfix_id")).alias("kb_id"))
    admins = baselines.where(F.coalesce(F.col("IsAdmin"), F.lit(False))).select(key)
    pk = packages.join(admins, key, "left_semi").select(
        key, F.coalesce(kb_id_strict(F.col("package_name")), kb_id_strict(F.col("description"))).alias("kb_id"))
    return hf.unionByName(pk).where(F.col("kb_id").isNotNull()).distinct()


# fixed values: product-name resolution ranks (lower wins)
RANK_VERSIONED = 1
RANK_GENERIC = 2
RANK_FAMILY_ARCH = 3
RANK_FAMILY = 4
LOOKBACK_MONTHS = 6


def resolve_product(hosts: DataFrame, products: DataFrame, key: str = "scan_id") -> DataFrame:
    """Best feed product name per host over its latest month and the five before.

    hosts: key, family ('Windows 11'), display_version ('24H2'), arch_token
    ('x64' / 'ARM64' / '32-bit'), latest_month (first-of-month date).
    products: month (first-of-month date), product_name (names starting 'Windows ').
    Candidates join on the family (first two words, an equi-join instead of a
    pattern scan) and rank: 1 versioned exact, 2 generic exact (both
    case-insensitive), 3 family + architecture, 4 family only. The most recent
    month with any candidate wins, then the rank, then the name alphabetically.
    A host without a family, a month or any candidate keeps its row, with nulls.
    """
    profile = ["family", "display_version", "arch_token", "latest_month"]
    prod = (products.where(F.col("product_name").startswith("Windows "))
            .select("month", "product_name").distinct()
            .withColumn("_family", F.lower(F.substring_index(F.col("product_name"), " ", 2))))
    # resolve once per distinct host profile, not per host: the candidate fan-out is
    # then bounded by (#profiles x #product names), whatever the fleet size
    h = hosts.select(*profile).distinct().withColumn("_family", F.lower(F.col("family")))
    # each profile looks at its own months, so the join key is (family, month), not the family alone
    h = h.withColumn("month", F.explode(F.transform(F.sequence(F.lit(0), F.lit(LOOKBACK_MONTHS - 1)),
                                                    lambda k: F.add_months("latest_month", -k))))
    j = h.join(prod, ["_family", "month"])
    name = F.lower(F.col("product_name"))
    arch = F.lower(F.col("arch_token"))
    suffix = F.when(arch == "32-bit", F.lit(" for 32-bit systems")).otherwise(
        F.concat(F.lit(" for "), arch, F.lit("-based systems")))
    fam = F.lower(F.col("family"))
    dv = F.lower(F.coalesce(F.col("display_version"), F.lit("")))
    arch_hit = F.when(arch == "32-bit", name.contains("32-bit")).otherwise(name.contains(F.concat(arch, F.lit("-based"))))
    rank = (F.when((dv != "") & (name == F.concat(fam, F.lit(" version "), dv, suffix)), RANK_VERSIONED)
            .when(name == F.concat(fam, suffix), RANK_GENERIC)
            .when(arch_hit, RANK_FAMILY_ARCH).otherwise(RANK_FAMILY))
    j = j.withColumn("match_rank", rank)
    order = F.struct((-F.unix_date("month")).alias("m"), F.col("match_rank"), F.col("product_name"))
    best = j.groupBy(*profile).agg(F.min_by(F.struct("product_name", "match_rank", "month"), order).alias("_b"))
    best = best.select(*[F.col(c).alias(f"_p_{c}") for c in profile],
                       F.col("_b.product_name").alias("product_name_hint"),
                       F.col("_b.match_rank").alias("match_rank"), month_id("_b.month").alias("resolved_month_id"))
    cond = [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in profile]
    return hosts.join(best, cond, "left").select(key, "product_name_hint", "match_rank", "resolved_month_id")
