"""Markdown report as a line table, rendered and written by Spark.

Every line is a row (scan_id, section, k1, k2, k3, line) whose key fixes its
place in the document, so a scan's report is built from row-level data in
parallel and written in key order: range partitioning on the key lets a very
large scan span several part files that concatenate in name order.
Fleet-wide sections (model evaluation, method, notes) form one document keyed
``fleet`` instead of being copied into every scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetrisk.functions.display import md_escape
from fleetrisk.operators.joins import saved
from fleetrisk.operators.rank import rank_cves, small_groups

FLEET_DOC = "fleet"
# fixed values: section titles, table headers and summary labels below are the report's format
TITLE = "# Patch Risk Review"
# texts of this engine's own
METHOD_TEXT = (
    "Missing updates are found by following supersedence from the installed updates. Every CVE row of a "
    "missing update is scored by an additive policy (CVSS base score plus bonuses for exploitation, network "
    "attack vector, no privileges, no user interaction, high impact and patch age). Updates are ranked by "
    "their highest policy score; supporting models add an estimated risk, a priority and a cluster.")
NOTES = (
    "- Policy scores are the primary ranking signal; model outputs support review.",
    "- CVE counts are row counts per update (CVE x month).",
    "- Month windows start at the installed cumulative update and are capped at 48 months.",
)
COLS = ("scan_id", "section", "k1", "k2", "k3", "line")


def _many(df: DataFrame, lines: list[tuple], scan: Column | None = None) -> DataFrame:
    """Lines (section, k1, k2, k3, line) of each row: one explode of an array of structs."""
    structs = [F.struct(F.lit(section).alias("section"), _col(k1).cast("long").alias("k1"), F.lit(k2).alias("k2"),
                        _col(k3).cast("long").alias("k3"), _col(line).alias("line")) for section, k1, k2, k3, line in lines]
    return df.select((scan if scan is not None else F.col("scan_id").cast("string")).alias("scan_id"), F.inline(F.array(*structs)))


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _fixed(section: int, k1: int, texts) -> list[tuple]:
    return [(section, k1, i, 0, t) for i, t in enumerate(texts)]


def _f2(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.format_string("%.2f", F.coalesce(col.cast("double"), F.lit(0.0)))


def _opt(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def scan_report(ranking: DataFrame, scored: DataFrame, summary: DataFrame) -> DataFrame:
    """Per-scan sections: summary, ranked remediation, review drivers, CVE-level review."""
    s, r = summary, ranking
    labels = [("Missing KBs reviewed", F.col("kb_count").cast("string")), ("CVEs reviewed", F.col("cves_reviewed").cast("string")),
              ("Highest policy risk", _f2("highest_policy_risk")), ("Highest ML risk", _f2(_opt(s, "highest_ml_risk", None))),
              ("Highest priority", F.coalesce(_opt(s, "highest_policy_priority", "Unknown"), F.lit("Unknown")))]
    per_scan = _many(s, [
        *_fixed(0, 0, [TITLE, ""]), (1, 0, 0, 0, "## Runtime Summary"),
        *[(1, i, 0, 0, F.concat(F.lit(f"- {label}: "), value)) for i, (label, value) in enumerate(labels, 1)], (1, 99, 0, 0, ""),
        *_fixed(4, 0, ["## Ranked Remediation", "",
                       "| Rank | KB | Policy Risk | ML Risk | Priority | ML Priority | Cluster | CVEs | Top Driver |",
                       "|---:|---|---:|---:|---|---|---:|---:|---|"]), *_fixed(4, 1 << 40, [""]),
        *_fixed(5, 0, ["## Review Drivers", ""]), *_fixed(5, 1 << 40, [""]),
        *_fixed(6, 0, ["## Ranking Review", ""])])
    row = F.concat_ws(" | ", F.col("rank").cast("string"), md_escape("kb_id"), _f2("policy_risk"),
                      _f2(_opt(r, "ml_risk", None)), md_escape("policy_priority"),
                      md_escape(F.coalesce(_opt(r, "ml_priority", None), F.lit("Unknown"))),
                      F.coalesce(_opt(r, "cluster", None), F.lit(0)).cast("string"),
                      F.col("cve_count").cast("string"), md_escape("top_driver"))
    rank = F.col("rank")
    per_kb = _many(r, [
        (4, rank, 0, 0, F.concat(F.lit("| "), row, F.lit(" |"))),
        (5, rank, 0, 0, F.concat(F.lit("- **"), md_escape("kb_id"), F.lit("**: "), md_escape("review_reason"))),
        (6, rank, 0, 0, F.concat(F.lit("### "), md_escape("kb_id"))), (6, rank, 1, 0, ""),
        (6, rank, 2, 0, "| CVE | Policy Risk | ML Risk | Policy Priority | ML Priority | Cluster | Driver | Policy Drivers |"),
        (6, rank, 3, 0, "|---|---:|---:|---|---|---:|---|---|"), (6, rank, 5, 0, "")])
    # position of each CVE row inside its KB; only the columns of a line are moved
    shown = ("scan_id", "kb_id", "cve_id", "month", "policy_risk", "ml_risk", "policy_priority", "ml_priority", "cluster", "top_driver", "policy_drivers")
    sc = rank_cves(scored.select(*[c for c in shown if c in scored.columns]).join(ranking.select("scan_id", "kb_id", "rank"), ["scan_id", "kb_id"]),
                   "_p", small_groups(ranking, scored))
    cve_row = F.concat_ws(" | ", md_escape("cve_id"), _f2("policy_risk"), _f2(_opt(sc, "ml_risk", None)),
                          md_escape("policy_priority"), md_escape(F.coalesce(_opt(sc, "ml_priority", None), F.lit("Unknown"))),
                          F.coalesce(_opt(sc, "cluster", None), F.lit(0)).cast("string"), md_escape("top_driver"),
                          md_escape(F.array_join("policy_drivers", ", ")))
    per_cve = _many(sc, [(6, F.col("rank"), 4, F.col("_p"), F.concat(F.lit("| "), cve_row, F.lit(" |")))])
    return per_scan.unionByName(per_kb).unionByName(per_cve)


def fleet_report(spark: SparkSession, model_summary: DataFrame | None) -> DataFrame:
    """Fleet document: model evaluation table, method and notes."""
    fleet = F.lit(FLEET_DOC)
    out = _many(spark.range(1), [
        *_fixed(0, 0, [TITLE + " (fleet)", ""]), *_fixed(2, 0, ["## Model Evaluation", "", "| Model | Metric | Value |", "|---|---|---:|"]),
        *_fixed(3, 0, ["", "## Method", "", METHOD_TEXT, ""]), *_fixed(7, 0, ["## Notes", "", *NOTES, ""])], fleet)
    if model_summary is not None:
        out = out.unionByName(_many(model_summary, [(2, 1, 0, F.xxhash64("stage", "metric"), F.concat(
            F.lit("| "), md_escape("stage"), F.lit(" | "), md_escape("metric"), F.lit(" | "),
            F.format_string("%.4f", F.col("value")), F.lit(" |")))], fleet))
    return out


def write_report(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    """One text document per scan folder, lines in key order across ordered part files, compressed (gzip), as texts of lines repeat.

    Lines are saved first: finding the ranges reads them once more, and would put them together again."""
    lines = saved(lines)
    n = partitions or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["scan_id", "section", "k1", "k2", "k3"]
    (lines.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
     .select("scan_id", "line").write.mode("overwrite").partitionBy("scan_id").text(path, compression="gzip"))
