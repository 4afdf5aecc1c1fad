"""Scan documents (one multi-line JSON file per host scan) as DataFrames.

A directory of scan files of mixed vintages reads into one DataFrame with the
superset schema; ``scan_id`` is ``host/file`` (parent folder and file name without
extension, so equal file names of two hosts stay apart), ``host`` the parent folder, ``scan_ts`` from the ``scan_yyyyMMdd_HHmmss`` name (else the
file's modification time). The nested arrays are exploded into the tables the
operators use (kb_entry, installed, stored missing).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetrisk import schemas
from fleetrisk.functions.ids import normalise_id, update_type
from fleetrisk.operators.joins import saved_until_done
from fleetrisk.operators.rank import rank_within
from fleetrisk.sources import scan_files

SCAN_NAME_TS = r"scan_(\d{8}_\d{6})"


def scan_host() -> Column:
    """Parent folder of the file a row was read from."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return F.get(parts, F.size(parts) - 2)


def scan_identity() -> Column:
    """``host/file``: what identifies a scan in batch reads and streams."""
    return F.concat(scan_host(), F.lit("/"), F.regexp_replace(F.col("_metadata.file_name"), r"\.json(\.gz)?$", ""))


def read_scans(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """All scan documents under ``path`` (recursive), one row per file.

    Files whose top level is not an object land in ``_corrupt_record`` and get
    ``valid = false``. The parsed documents are saved once to the reliable
    checkpoint folder: Spark refuses plans over raw JSON that read only the
    corrupt-record column, which filtering on validity would otherwise do.
    Raises when there are no scan files at all.
    """
    df = (spark.read.schema(schemas.SCAN).option("multiLine", True).option("mode", "PERMISSIVE")
          .option("recursiveFileLookup", True).option("pathGlobFilter", "{*.json,*.json.gz}").json(path))
    name = F.col("_metadata.file_name")
    stamp = F.regexp_extract(name, SCAN_NAME_TS, 1)
    out = df.select(
        "*", scan_identity().alias("scan_id"), scan_host().alias("host"),
        F.coalesce(F.try_to_timestamp(F.when(stamp != "", stamp), F.lit("yyyyMMdd_HHmmss")),
                   F.col("_metadata.file_modification_time")).alias("scan_ts"),
        name.alias("file_name"),
        F.col("_corrupt_record").isNull().alias("valid")).checkpoint(eager=True)
    if required and out.isEmpty():
        raise FileNotFoundError(f"no scan files found under {path}")
    return out


def latest_scans(scans: DataFrame, host: str = "host") -> DataFrame:
    """Newest scan per host by (scan time, file name): a max_by aggregate keyed by
    host (partial aggregation, no per-host sort), then a semi join."""
    newest = scans.groupBy(host).agg(F.max_by("scan_id", F.struct("scan_ts", "file_name")).alias("scan_id"))
    return scans.join(newest, [host, "scan_id"], "left_semi")


def kb_entries(scans: DataFrame) -> DataFrame:
    """kb_entry(scan_id, kb_id, months, cves, supersedes, update_type) from KbEntries."""
    e = scans.select("scan_id", F.explode("KbEntries").alias("e"))
    sup = F.coalesce(F.col("e.Supersedes"), F.array().cast("array<string>"))
    return e.select(
        "scan_id", normalise_id("e.KB").alias("kb_id"),
        F.coalesce(F.col("e.Months"), F.array().cast("array<string>")).alias("months"),
        F.coalesce(F.col("e.Cves"), F.array().cast("array<string>")).alias("cves"),
        sup.alias("supersedes"),
        F.coalesce(F.col("e.UpdateType"), update_type(sup)).alias("update_type"))


def installed(scans: DataFrame) -> DataFrame:
    i = scans.select("scan_id", F.explode("InstalledKbs").alias("kb_id")).withColumn("kb_id", normalise_id("kb_id"))
    return i.where(F.col("kb_id") != "").distinct()


def stored_missing(scans: DataFrame) -> DataFrame:
    m = scans.select("scan_id", F.explode("MissingKbs").alias("kb_id")).withColumn("kb_id", normalise_id("kb_id"))
    return m.where(F.col("kb_id") != "").distinct()


def baselines(scans: DataFrame) -> DataFrame:
    return scans.select("scan_id", "host", "Baseline.*")


#: list elements in one part of an exported scan
SEGMENT_ROWS = 20_000


def scan_documents(entries: DataFrame, installed_kbs: DataFrame, missing: DataFrame, baseline: DataFrame,
                   months_requested: DataFrame, scan_ts: Column, segment_rows: int = SEGMENT_ROWS, packed: bool = False) -> DataFrame:
    """(host, file_name, document): nested scan documents, in parts of at most ``segment_rows`` list elements.

    host is ``scan_id`` as text. All list elements of a scan form one order (section, key); a
    distributed rank numbers them, and a part holds a run of numbers. So lists close in bounded
    groups, and a large host spreads over many tasks. The first part carries the baseline.
    """
    none, text = F.lit(None), "string"
    entry = F.struct(F.col("kb_id").alias("KB"), F.col("months").alias("Months"), F.col("cves").alias("Cves"),
                     F.col("supersedes").alias("Supersedes"), F.col("update_type").alias("UpdateType"))

    def section(rows: DataFrame, number: int, key: Column, item: Column = none.cast(text)) -> DataFrame:
        return rows.select("scan_id", F.lit(number).alias("section"), key.cast(text).alias("key"), item.alias("entry"))

    months = entries.select("scan_id", F.explode("months").alias("month")).distinct()
    # an entry is ranked and gathered as its JSON text, a fraction of the bytes of its arrays, which the document holds as it is
    written = F.to_json(entry)
    rows = (section(entries.withColumn("kb_id", normalise_id("kb_id")), 0, F.coalesce(F.col("kb_id"), F.lit("")), written)
            .unionByName(section(installed_kbs.select("scan_id", "kb_id").distinct(), 1, F.col("kb_id")))
            .unionByName(section(missing.select("scan_id", "kb_id").distinct(), 2, F.col("kb_id")))
            .unionByName(section(months_requested, 3, F.concat_ws("/", F.format_string("%06d", F.col("pos").cast("long")), F.col("month_id"))))
            .unionByName(section(months, 4, F.col("month")))
            .unionByName(section(baseline, 5, F.lit(""))))  # a scan without any element has its one document, too
    rows = rows.withColumn("spread", F.monotonically_increasing_id())
    # entries of one KB are in the order of their texts
    ranked = rank_within(rows, ["scan_id"], [F.col("section"), F.col("key").asc_nulls_first(), F.col("entry").asc_nulls_first(), F.col("spread")], "at").withColumn("part", F.floor((F.col("at") - 1) / segment_rows).cast("long"))
    # an entry's document holds its text, the other lists their keys
    groups = ranked.groupBy("scan_id", "part").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("section") == k, F.struct("at", "key" if k else "entry")))).alias(f"_{k}") for k in range(5)])
    counts = ranked.groupBy("scan_id").agg((F.max("part") + 1).alias("parts"))
    facts = baseline.select("scan_id", F.struct(*[c for c in baseline.columns if c not in ("scan_id", "host")]).alias("Baseline"))
    doc = groups.join(counts, "scan_id").join(facts, "scan_id", "left")
    keys = lambda k: F.transform(f"_{k}", lambda x: x["key"])
    others = F.to_json(F.struct(
        F.when(F.col("part") == 0, F.col("Baseline")).alias("Baseline"), keys(1).alias("InstalledKbs"),
        F.transform("_3", lambda x: F.substring_index(x["key"], "/", -1)).alias("MonthsRequested"),
        keys(4).alias("MonthsWithEntries"), keys(2).alias("MissingKbs")))  # never an empty object: it has the lists
    body = F.concat(F.lit('{"KbEntries":['), F.array_join("_0.entry", ","), F.lit("],"), F.substring(others, F.lit(2), F.length(others)))
    stem = F.concat(F.lit("scan_"), F.date_format(scan_ts, "yyyyMMdd_HHmmss"))
    suffix = F.when(F.col("parts") > 1, F.format_string(".%06d-of-%06d", F.col("part") + 1, F.col("parts"))).otherwise("")
    return doc.select(F.col("scan_id").cast(text).alias("host"), F.concat(stem, suffix, F.lit(".json.gz" if packed else ".json")).alias("file_name"), body.alias("document"))


def export_scans(entries: DataFrame, installed_kbs: DataFrame, missing: DataFrame, baseline: DataFrame, months_requested: DataFrame,
                 path: str, scan_ts: Column | None = None, segment_rows: int = SEGMENT_ROWS, packed: bool = False) -> None:
    """Write one nested scan document per scan, or several parts of one: ``path/<scan_id>/scan_<time>[.<part>].json``, compressed
    and with ``.gz`` behind if ``packed``."""
    scan_ts = F.current_timestamp() if scan_ts is None else scan_ts
    with saved_until_done(entries.sparkSession):
        scan_files.write(scan_documents(entries, installed_kbs, missing, baseline, months_requested, scan_ts, segment_rows, packed), path)
