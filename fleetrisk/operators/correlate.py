"""Expected vs installed correlation: KB maps, missing set, status, summaries."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from fleetrisk.functions.display import join_list
from fleetrisk.functions.ids import is_cve_id, kb_id_loose, normalise_id, normalise_id_array, update_type
from fleetrisk.operators.closure import Reachability, edges_from_entries

# fixed values: status and type texts
INSTALLED = "Installed"
SUPERSEDED = "Superseded"
MISSING = "Missing"
UNKNOWN_TYPE = "Unknown"
UPDATE_TYPES = ("Superseding", "Standalone")
REQUEST_MONTHS = 3
REASON_NO_PRODUCT = "No product name resolved"
REASON_NO_ENTRIES = "No KB data returned"


def merge_entries(batches: DataFrame, scan_col: str = "scan_id") -> DataFrame:
    """Set-union of months / CVEs / superseded KBs per normalised KB over several feed batches."""
    b = batches.withColumn("kb_id", normalise_id("kb_id")).where(F.coalesce(F.col("kb_id"), F.lit("")) != "")
    # collect_set dedupes identical arrays map-side, so a KB repeated in many batches
    # buffers its distinct arrays only; finalise_entries sorts every array
    empty = F.array().cast("array<string>")
    merged = b.groupBy(scan_col, "kb_id").agg(
        F.array_distinct(F.flatten(F.collect_set(F.coalesce("months", empty)))).alias("months"),
        F.array_distinct(F.flatten(F.collect_set(F.coalesce("cves", empty)))).alias("cves"),
        F.array_distinct(F.flatten(F.collect_set(F.coalesce("supersedes", empty)))).alias("supersedes"))
    return finalise_entries(merged)


def finalise_entries(entries: DataFrame) -> DataFrame:
    """Sorted arrays (month ids in text order), normalised superseded ids, update type."""
    return entries.withColumns({
        "kb_id": normalise_id("kb_id"),
        "months": F.array_sort(F.array_distinct(F.filter("months", lambda x: x.isNotNull() & (x != "")))),
        "cves": F.array_sort(F.array_distinct(F.filter("cves", lambda x: x.isNotNull() & (x != "")))),
        "supersedes": normalise_id_array("supersedes"),
    }).withColumn("update_type", update_type("supersedes"))


def product_kb_map(product_rows: DataFrame, product: str | None = None, scan_col: str = "scan_id", request: str | None = None) -> DataFrame:
    """KB entries from affected-software rows (one row per product x CVE x month).

    Rows of the chosen product (case-insensitive) are exploded over their KB
    articles and grouped per KB: distinct months, valid CVEs and the first KB
    number of each superseded value. With ``request``, a column of the rows, entries are
    those of each request on its own, for ``merge_entries``.
    """
    keys = [scan_col, *([request] if request else [])]
    rows = product_rows
    if product is not None:
        rows = rows.where(F.lower("full_product_name") == F.lower(F.lit(product)))
    # ids as the feed has them: a single text or an array of them, tidied and filtered
    cves = F.filter(F.transform(_texts(rows, "cve"), lambda c: F.when(is_cve_id(c), normalise_id(c))), lambda c: c.isNotNull())
    sup = F.filter(F.transform(_texts(rows, "supercedence"), kb_id_loose), lambda k: k.isNotNull())
    kb = rows.select(*keys, "month", cves.alias("cves"), sup.alias("supersedes"),
                     F.explode(F.transform("kb_articles", kb_id_loose)).alias("kb_id")).where(F.col("kb_id").isNotNull())
    out = kb.groupBy(*keys, "kb_id").agg(
        F.collect_set("month").alias("months"),
        F.array_distinct(F.flatten(F.collect_set("cves"))).alias("cves"),
        F.array_distinct(F.flatten(F.collect_set("supersedes"))).alias("supersedes"))
    return finalise_entries(out)


def _texts(rows: DataFrame, name: str):
    """Column as an array of texts: arrays as they are, a single text as one element, null as none."""
    col = F.col(name)
    if isinstance(rows.schema[name].dataType, ArrayType):
        return F.coalesce(col.cast("array<string>"), F.array().cast("array<string>"))
    return F.when(col.isNotNull(), F.array(col.cast("string"))).otherwise(F.array().cast("array<string>"))


class Correlation(Mapping):
    """Expected against installed KBs of each scan. Frames are built when they are asked for:

    entries, expected, installed; reached_kbs and present and missing (no roots are
    followed for these); reached (scan, root_kb, kb_id), superseded_by and status.
    """

    NAMES = ("entries", "expected", "installed", "reached_kbs", "present", "missing", "reached", "superseded_by", "status")

    def __init__(self, kb_entry: DataFrame, installed: DataFrame, scan_col: str = "scan_id", **options):
        self.scan_col = scan_col
        entries = kb_entry.withColumn("kb_id", normalise_id("kb_id")).where(F.coalesce(F.col("kb_id"), F.lit("")) != "")
        inst = installed.select(scan_col, normalise_id("kb_id").alias("kb_id")).where(F.col("kb_id") != "").distinct()
        self.reach = Reachability(edges_from_entries(entries, scan_col), inst, scan_col, **options)
        self._frames = {"entries": entries, "installed": inst}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise KeyError(name)
        if name not in self._frames:
            self._frames[name] = getattr(self, f"_{name}")()
        return self._frames[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.NAMES)

    def __len__(self) -> int:
        return len(self.NAMES)

    def _expected(self) -> DataFrame:
        return self["entries"].select(self.scan_col, "kb_id").distinct()

    def _reached_kbs(self) -> DataFrame:
        return self.reach.reached()

    def _present(self) -> DataFrame:
        return self.reach.present()

    def _missing(self) -> DataFrame:
        return self["expected"].join(self["present"], [self.scan_col, "kb_id"], "left_anti")

    def _reached(self) -> DataFrame:
        return self.reach.pairs()

    def _superseded_by(self) -> DataFrame:
        return self.reach.roots_of()

    def _status(self) -> DataFrame:
        key = [self.scan_col, "kb_id"]
        # the texts are made first: the joins move them, not the arrays of months, CVEs and superseded KBs
        entries = self["entries"].select(*key, F.coalesce("update_type", F.lit("Mapped")).alias("type"), join_list("months").alias("months"),
                                         F.coalesce(F.size("cves"), F.lit(0)).alias("cve_count"))
        return (entries
                .join(self["installed"].withColumn("_inst", F.lit(True)), key, "left")
                .join(self["superseded_by"], key, "left")
                .withColumn("status", F.when(F.col("_inst"), INSTALLED)
                            .when(F.size("replaced_by") > 0,
                                  F.concat(F.lit(SUPERSEDED + " by "), F.array_join("replaced_by", ", ")))
                            .otherwise(MISSING))
                .select(self.scan_col, "kb_id", "type", "status", "months", "cve_count"))


def correlate(kb_entry: DataFrame, installed: DataFrame, scan_col: str = "scan_id", **options) -> Correlation:
    """Reachability, logical presence, missing set and per-KB status in one place."""
    return Correlation(kb_entry, installed, scan_col, **options)


def requests(months: DataFrame, scan_col: str = "scan_id", size: int = REQUEST_MONTHS) -> DataFrame:
    """(scan, request, month): each host's months in requests of ``size``, numbered from 0.

    months: ``baseline.month_window``'s (scan, pos from 1, month_id).
    """
    return months.select(scan_col, F.floor((F.col("pos") - 1) / size).cast("int").alias("request"), F.col("month_id").alias("month"))


def requested_entries(product_rows: DataFrame, asked: DataFrame, scan_col: str = "scan_id") -> DataFrame:
    """KB entries of each request (scan, request, kb_id, ...): rows of each host's product in the months of its requests."""
    return product_kb_map(product_rows.join(asked, [scan_col, "month"]), scan_col=scan_col, request="request")


def scan_summary(c: Mapping[str, DataFrame], scan_col: str = "scan_id", hosts: DataFrame | None = None, raw: DataFrame | None = None) -> DataFrame:
    """Per scan: raw entries returned, expected, installed, logically present, superseded
    mappings, present among expected, missing.

    raw: rows that requests returned, one per (scan, request, KB); by default each month of a
    KB counts, as if months had been asked for one by one. hosts: (scan, ...) gets a row for each
    of its rows, zeros included, and keeps their columns; by default scans with expected KBs.
    """
    def per_scan(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(scan_col).agg(F.count(F.lit(1)).alias(name))
    if raw is None:
        raw = c["entries"].groupBy(scan_col).agg(F.sum(F.coalesce(F.size("months"), F.lit(0))).alias("raw_entries_returned"))
    else:
        raw = per_scan(raw, "raw_entries_returned")
    parts = [raw, per_scan(c["installed"], "installed_kbs"), per_scan(c["present"], "logical_present_kbs"),
             per_scan(c["reached_kbs"], "superseded_mappings"), per_scan(c["missing"], "missing_kbs")]
    expected = per_scan(c["expected"], "expected_kbs")
    out = expected if hosts is None else hosts.join(expected, scan_col, "left")
    for p in parts:
        out = out.join(p, scan_col, "left")
    out = out.fillna(0, subset=["raw_entries_returned", "expected_kbs", "installed_kbs", "logical_present_kbs", "superseded_mappings", "missing_kbs"])
    return out.withColumn("present_among_expected", F.col("expected_kbs") - F.col("missing_kbs"))


def missing_list(c: Mapping[str, DataFrame], kb_entry: DataFrame, scan_col: str = "scan_id") -> DataFrame:
    """Missing KBs with their update type (Unknown when the KB has no entry)."""
    types = kb_entry.select(scan_col, normalise_id("kb_id").alias("kb_id"), "update_type")
    return (c["missing"].join(types, [scan_col, "kb_id"], "left")
            .select(scan_col, "kb_id", F.coalesce("update_type", F.lit(UNKNOWN_TYPE)).alias("update_type")))


def missing_breakdown(missing_typed: DataFrame, scan_col: str = "scan_id") -> DataFrame:
    """Per scan count of missing KBs by update type (listed pivot values: no extra job)."""
    out = missing_typed.groupBy(scan_col).pivot("update_type", list(UPDATE_TYPES)).agg(F.count(F.lit(1)))
    return out.fillna(0, subset=list(UPDATE_TYPES))


def months_with_entries(kb_entry: DataFrame, scan_col: str = "scan_id", grain: str = "month",
                        requested: DataFrame | None = None, batch_size: int = REQUEST_MONTHS) -> DataFrame:
    """Per scan, sorted distinct months that returned any KB entry (text order).

    ``grain="batch"``: months are requested ``batch_size`` at a time, in the order of
    ``requested`` (scan, pos from 1, month_id), and all months of a request with any
    entry count.
    """
    if grain == "batch":
        batch = requested.select(scan_col, "month_id", F.floor((F.col("pos") - 1) / batch_size).alias("batch"))
        have = kb_entry.select(scan_col, F.explode("months").alias("month_id")).distinct()
        hit = batch.join(have, [scan_col, "month_id"], "left_semi").select(scan_col, "batch").distinct()
        m = batch.join(hit, [scan_col, "batch"], "left_semi").select(scan_col, F.col("month_id").alias("month"))
        return m.groupBy(scan_col).agg(F.array_sort(F.collect_set("month")).alias("months_with_entries"))
    m = kb_entry.select(scan_col, F.explode("months").alias("month"))
    return m.groupBy(scan_col).agg(F.array_sort(F.collect_set("month")).alias("months_with_entries"))
