"""Roll-ups, distributions, ranking and top-k previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk.functions.display import join_list
from fleetrisk.operators.joins import saved, sized
from fleetrisk.operators.policy import DEFAULT_DRIVER

# fixed values: priority order and preview sizes
PRIORITY_ORDER = ("High", "Medium", "Low")
UNKNOWN_PRIORITY = "Unknown"
TOP_CVE_PREVIEW_LIMIT = 10
KB_TABLE_LIMIT = 10


def priority_ordinal(c) -> Column:
    """High 3 > Medium 2 > Low 1 > anything else 0 (null stays null so it is ignored)."""
    x = F.col(c) if isinstance(c, str) else c
    return (F.when(x == "High", 3).when(x == "Medium", 2).when(x == "Low", 1)
            .when(x.isNotNull(), 0))


def priority_from_ordinal(c: Column) -> Column:
    return (F.when(c == 3, "High").when(c == 2, "Medium").when(c == 1, "Low")
            .otherwise(UNKNOWN_PRIORITY))


def highest_priority(c) -> Column:
    """Ordinal max of priority labels as an aggregate; no label -> Unknown."""
    return priority_from_ordinal(F.max(priority_ordinal(c)))


def kb_rollup(scored: DataFrame, keys=("scan_id",), with_ml: bool = False) -> DataFrame:
    """Roll CVE rows up to KB grain.

    max policy risk, highest priority, *row* count (cve_count), and the top
    row's driver and drivers, where the top row is the highest risk with ties by
    (cve_id, month). All aggregates are associative (partial aggregation before
    the shuffle), so a hot KB is combined map-side.
    """
    order_key = F.struct((-F.col("policy_risk")).alias("r"), F.col("cve_id"), F.col("month"))
    top = F.struct(F.col("top_driver").alias("top_driver"),
                   F.array_join("policy_drivers", ", ").alias("review_reason"))
    aggs = [
        F.max("policy_risk").alias("policy_risk"),
        highest_priority("policy_priority").alias("policy_priority"),
        F.count(F.lit(1)).alias("cve_count"),
        F.min_by(top, order_key).alias("_top"),
    ]
    if with_ml:
        aggs += [F.max("ml_risk").alias("ml_risk"),
                 highest_priority("ml_priority").alias("ml_priority"),
                 F.coalesce(F.mode("cluster", True), F.lit(0)).alias("cluster")]
    # the rows are sorted by these keys: the KB first, few rows share it, while a scan has a large part of all
    out = scored.groupBy("kb_id", *keys).agg(*aggs)
    out = out.select(*keys, *[c for c in out.columns if c not in keys])
    return out.withColumns({
        "top_driver": F.coalesce(F.col("_top.top_driver"), F.lit(DEFAULT_DRIVER)),
        "review_reason": F.coalesce(F.col("_top.review_reason"), F.lit("")),
    }).drop("_top")


def rank_within(df: DataFrame, partition_cols, order_cols, rank_col: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """row_number() over (partition by ... order by ...) without a single-task group.

    A window partitioned by scan puts a whole scan in one task; a hot scan (a
    third of all rows) then ranks in one task, and a global rank in one
    partition. Instead the rows are range-partitioned on (partition cols, order
    cols), so a hot group spreads over many tasks; each row's position inside
    its range partition comes from ``monotonically_increasing_id`` after the
    sort; per (partition, group) counts give offsets through a running sum over
    a table of at most (#range partitions + #groups) rows. The sorted layout is
    saved to the shared folder so both uses see the same
    partitions even if executors are lost. ``order_cols`` must make the order
    total within a group (end with a unique key).
    """
    partition_cols = list(partition_cols)
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_cols = [F.col(c).asc_nulls_first() for c in partition_cols] + list(order_cols)
    laid = saved(df.repartitionByRange(n, *sort_cols)
                 .sortWithinPartitions(*sort_cols)
                 .withColumn("_part", F.spark_partition_id())
                 .withColumn("_pos", F.monotonically_increasing_id()))
    stats = laid.groupBy("_part", *partition_cols).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    running = Window.partitionBy(*partition_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.select(
        F.col("_part").alias("_s_part"),
        *[F.col(c).alias(f"_s_{i}") for i, c in enumerate(partition_cols)],
        (F.col("_first") - F.coalesce(F.sum("_n").over(running), F.lit(0))).alias("_base"))
    # stats has at most (#range partitions + #groups) rows
    side = sized(stats)
    cond = [F.col("_part") == F.col("_s_part")] + [
        F.col(c).eqNullSafe(F.col(f"_s_{i}")) for i, c in enumerate(partition_cols)]
    out = laid.join(side, cond).withColumn(rank_col, (F.col("_pos") - F.col("_base") + 1).cast("int"))
    out = out.drop("_s_part", "_base", *[f"_s_{i}" for i in range(len(partition_cols))])
    return out.drop("_part", "_pos")


def rank_kbs(rollup: DataFrame, keys=("scan_id",)) -> DataFrame:
    """Rank KBs by policy risk desc, ties by kb_id (stable-sort equivalent), 1..n per scan."""
    return rank_within(rollup, keys, [F.col("policy_risk").desc(), F.col("kb_id").asc()])


def top_per_group(df: DataFrame, group_cols, order_cols, k: int, rank_col: str = "pos") -> DataFrame:
    """First ``k`` rows per group. ``row_number() <= k`` plans a partial
    WindowGroupLimit before the shuffle, so each task forwards at most k rows per
    group and a hot group does not reach one task whole."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def cve_preview(scored: DataFrame, keys=("scan_id",), k: int = TOP_CVE_PREVIEW_LIMIT) -> DataFrame:
    """Top-k CVE rows per KB by policy risk (ties by cve_id, month) plus the hidden count."""
    keys = list(keys)
    scored = saved(scored)  # read twice below
    top = top_per_group(scored, ["kb_id"] + keys,
                        [F.col("policy_risk").desc(), F.col("cve_id"), F.col("month")], k, "cve_rank")
    counts = scored.groupBy(*keys, "kb_id").agg(F.count(F.lit(1)).alias("cve_total"))
    return (top.join(counts, keys + ["kb_id"])
            .withColumn("hidden_count", F.greatest(F.col("cve_total") - k, F.lit(0))))


def cve_counts(scored: DataFrame, keys=("scan_id",)) -> DataFrame:
    """Per KB its CVE rows (CVE x month, what rankings count) and its distinct CVEs.

    Rows are first counted per CVE, so no task gathers a KB's ids.
    """
    keys = list(keys)
    each = scored.groupBy(*keys, "kb_id", "cve_id").agg(F.count(F.lit(1)).alias("_n"))
    return each.groupBy(*keys, "kb_id").agg(F.sum("_n").alias("cve_rows"), F.count(F.lit(1)).alias("distinct_cves"))


def label_distribution(df: DataFrame, label_col: str = "priority_label") -> DataFrame:
    return df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("count"))


def score_range(df: DataFrame, score_col: str = "policy_risk", by: list[str] | None = None) -> DataFrame:
    """min / max / mean rounded to 2 dp; 0.0 when empty."""
    aggs = [F.round(F.coalesce(F.min(score_col), F.lit(0.0)), 2).alias("risk_min"),
            F.round(F.coalesce(F.max(score_col), F.lit(0.0)), 2).alias("risk_max"),
            F.round(F.coalesce(F.avg(score_col), F.lit(0.0)), 2).alias("risk_mean"),
            F.count(F.lit(1)).alias("rows")]
    return df.groupBy(*(by or [])).agg(*aggs)


def ranking_summary(ranking: DataFrame, keys=("scan_id",)) -> DataFrame:
    """Report summary: KBs, CVE rows reviewed, highest risks, highest priority."""
    aggs = [F.count(F.lit(1)).alias("kb_count"),
            F.sum("cve_count").alias("cves_reviewed"),
            F.max("policy_risk").alias("highest_policy_risk"),
            highest_priority("policy_priority").alias("highest_policy_priority")]
    if "ml_risk" in ranking.columns:
        aggs += [F.max("ml_risk").alias("highest_ml_risk"),
                 highest_priority("ml_priority").alias("highest_ml_priority")]
    return ranking.groupBy(*keys).agg(*aggs)


#: CVE rows in one list of a nested ranking
SEGMENT_ROWS = 20_000
#: CVE rows of a KB that one task may number
GROUP_ROWS = 100_000


def small_groups(ranking: DataFrame, scored: DataFrame, keys=("scan_id",), most: int | None = None) -> bool:
    """No KB has more than ``most`` CVE rows, as the ranking counts them, else the scored rows."""
    if "cve_count" in ranking.columns:
        largest = ranking.agg(F.max("cve_count"))
    else:
        largest = scored.groupBy(*keys, "kb_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"))
    return (largest.first()[0] or 0) <= (GROUP_ROWS if most is None else most)


def rank_cves(scored: DataFrame, rank_col: str, small: bool, keys=("scan_id",)) -> DataFrame:
    """Place of each CVE row in its KB. ``small``, see ``small_groups``: a KB is numbered where its rows meet, so
    they are shuffled once; else by ``rank_within``, which moves and saves all rows, but deals a large KB out."""
    group, order = [*keys, "kb_id"], [F.col("policy_risk").desc(), F.col("cve_id"), F.col("month")]
    if not small:
        return rank_within(scored, group, order, rank_col)
    return scored.withColumn(rank_col, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def nested_ranking(ranking: DataFrame, scored: DataFrame, keys=("scan_id",), segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Export shape: each ranked KB with its nested CVE list ordered by risk.

    A list holds at most ``segment_rows`` rows: a KB with more has several rows, numbered by
    ``segment`` from 0. If a KB has more rows than a task may number, a distributed rank deals the CVE rows out, so no task
    gathers a whole KB, and lists are gathered from runs of ranks. Else KBs are numbered, gathered and joined to the
    ranking after one shuffle of the rows.
    """
    keys = list(keys)
    has_ml = "ml_risk" in scored.columns
    item = F.struct(
        F.col("_at"), F.col("cve_id"), F.col("policy_risk"),
        (F.col("ml_risk") if has_ml else F.lit(None).cast("double")).alias("ml_risk"),
        F.col("policy_priority"),
        (F.col("ml_priority") if has_ml else F.lit(None).cast("string")).alias("ml_priority"),
        (F.col("cluster") if has_ml else F.lit(None).cast("int")).alias("cluster"),
        F.col("top_driver"), join_list("policy_drivers", ", ", "").alias("drivers"))
    wanted = [*keys, "kb_id", "cve_id", "month", "policy_risk", "policy_priority", "top_driver", "policy_drivers",
              *(("ml_risk", "ml_priority", "cluster") if has_ml else ())]
    small = small_groups(ranking, scored, keys)
    ranked = rank_cves(scored.select(*wanted), "_at", small, keys)
    lists = (ranked.withColumn("segment", F.floor((F.col("_at") - 1) / segment_rows).cast("int"))
             .groupBy(*keys, "kb_id", "segment").agg(F.array_sort(F.collect_list(item)).alias("_cves")))
    lists = lists.withColumn("cves", F.transform("_cves", lambda x: x.dropFields("_at"))).drop("_cves")
    if small:
        others = [c for c in ranking.columns if c not in (*keys, "kb_id")]
        return ranking.join(lists, keys + ["kb_id"], "left").select(*keys, "kb_id", F.coalesce("segment", F.lit(0)).alias("segment"), *others, "cves")
    # one row a segment on both sides, so a KB's lists meet in as many tasks as there are segments
    last = ranked.groupBy(*keys, "kb_id").agg(F.floor((F.max("_at") - 1) / segment_rows).cast("int").alias("_last"))
    slots = ranking.join(last, keys + ["kb_id"], "left").withColumn(
        "segment", F.explode(F.sequence(F.lit(0), F.coalesce("_last", F.lit(0))))).drop("_last")
    return slots.join(lists, keys + ["kb_id", "segment"], "left")
