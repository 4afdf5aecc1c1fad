"""Host platform mappings: architecture, OS family, catalog constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetrisk.functions.ids import _col


def catalog_arch(arch) -> Column:
    """x64 / arm64 / x86 token for catalog matching; unknown -> x64."""
    a = F.lower(F.coalesce(_col(arch), F.lit("")))
    return (F.when(a.isin("x64", "amd64"), "x64")
            .when(a.contains("arm64"), "arm64")
            .when(a.isin("x86", "32-bit"), "x86")
            .otherwise("x64"))


def display_arch(arch) -> Column:
    """Baseline architecture label x64 / ARM64 / x86 (default x64)."""
    a = F.lower(F.coalesce(_col(arch), F.lit("")))
    return (F.when(a.contains("arm64"), "ARM64")
            .when(a.isin("x86", "32-bit") | a.contains("x86"), "x86")
            .otherwise("x64"))


def feed_arch_token(arch) -> Column:
    """Architecture token used in feed product names."""
    d = display_arch(arch)
    return F.when(d == "x86", "32-bit").when(d == "ARM64", "ARM64").otherwise("x64")


def os_family(os_name) -> Column:
    """'windows 11' / 'windows 10' / '' by substring."""
    o = F.lower(F.coalesce(_col(os_name), F.lit("")))
    return (F.when(o.contains("windows 11"), "windows 11")
            .when(o.contains("windows 10"), "windows 10")
            .otherwise(""))


def constraints(baseline: DataFrame, key: str = "scan_id") -> DataFrame:
    """One constraint row per host: family, display version, build major, catalog arch."""
    return baseline.select(
        key,
        os_family("OsName").alias("windows_gen"),
        F.coalesce(F.trim(F.col("DisplayVersion")), F.lit("")).alias("display_version"),
        F.coalesce(F.substring_index(F.col("Build"), ".", 1), F.lit("")).alias("build_major"),
        catalog_arch("Architecture").alias("catalog_arch"),
    )
