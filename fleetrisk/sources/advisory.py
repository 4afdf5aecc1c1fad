"""Vendor advisory documents -> one metadata row per CVE.

Advisories land as JSON partitioned by month (``.../month=2026-Feb/*.json``);
reading only the requested months prunes partitions. Each vulnerability yields
severity (first threat of type 3), exploitation (first threat of type 1), the
first CVSS set and the first revision date; when a CVE appears in several
months the last one wins, in month order (chronological by default, text order
for parity with a text sort).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetrisk import schemas
from fleetrisk.functions.ids import is_cve_id, loose_cve_id
from fleetrisk.functions.months import parse_month_id

# fixed values: threat type codes
SEVERITY_THREAT = 3
EXPLOITATION_THREAT = 1


def read_advisories(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """Month documents from a month-partitioned folder; ``months`` prunes partitions."""
    schema = schemas.ADVISORY
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.where(F.col("month").isin(*months)) if months else df


def vulnerabilities(docs: DataFrame) -> DataFrame:
    """(month, pos, v) with one row per Vulnerability element in document order."""
    return docs.select("month", F.posexplode("Vulnerability").alias("pos", "v"))


def _first_threat(threats: Column, kind: int) -> Column:
    return F.get(F.filter(threats, lambda t: t["Type"] == kind), 0)["Description"]["Value"]


def metadata_rows(vulns: DataFrame) -> DataFrame:
    """Per vulnerability: loose CVE id, severity, base score, vector, published date, exploitation."""
    first_set = F.get(F.col("v.CVSSScoreSets"), 0)
    return vulns.select(
        "month", "pos",
        loose_cve_id(F.col("v.CVE")).alias("cve_id"),
        _first_threat(F.col("v.Threats"), SEVERITY_THREAT).alias("severity"),
        first_set["BaseScore"].alias("base_score"),
        first_set["Vector"].alias("vector"),
        F.get(F.col("v.RevisionHistory"), 0)["Date"].alias("published_date"),
        _first_threat(F.col("v.Threats"), EXPLOITATION_THREAT).alias("exploitation"),
    ).where(F.col("cve_id").isNotNull())


def last_wins(rows: DataFrame, order: str = "time") -> DataFrame:
    """One row per CVE: the last occurrence by (month, position in the document).

    A ``max_by`` aggregate: partial aggregation keeps one row per CVE per task,
    so a CVE repeated in every month costs no shuffle volume. Keys are then
    restricted to strict CVE ids.
    """
    month_key = parse_month_id("month") if order == "time" else F.col("month")
    fields = F.struct("severity", "base_score", "vector", "published_date", "exploitation")
    out = rows.groupBy("cve_id").agg(F.max_by(fields, F.struct(month_key.alias("m"), F.col("pos"))).alias("f"))
    return out.select("cve_id", "f.*").where(is_cve_id("cve_id"))
