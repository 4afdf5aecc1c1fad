"""Mergeable distinct sketches: estimates for any roll-up beside the exact counts.

HyperLogLog sketches of KBs and CVEs per (host, month) are a few kilobytes each whatever they count. Any
scope (a month, a host, a quarter, the fleet) merges the sketches of its parts; the rows are not
read again. An exact count distinct of another scope reads and shuffles every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a sketch; one standard error of an estimate is about 1.04 / sqrt(2 ** LG_K)
LG_K = 12
COUNTED = ("kb_id", "cve_id")


def error_bound(lg_k: int = LG_K, deviations: float = 4.0) -> float:
    """Relative error that an estimate stays within, ``deviations`` standard errors wide."""
    return deviations * 1.04 / 2 ** (lg_k / 2)


def sketch(flat: DataFrame, keys=("scan_id", "month"), lg_k: int = LG_K) -> DataFrame:
    """keys, rows, and a sketch ``<column>_sketch`` of each counted column; tasks merge before the shuffle."""
    return flat.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.hll_sketch_agg(c, F.lit(lg_k)).alias(f"{c}_sketch") for c in COUNTED])


def roll_up(sketches: DataFrame, keys=()) -> DataFrame:
    """Merge sketches to a coarser scope; none of ``keys``: one row."""
    return sketches.groupBy(*keys).agg(F.sum("rows").alias("rows"), *[F.hll_union_agg(f"{c}_sketch", F.lit(False)).alias(f"{c}_sketch") for c in COUNTED])


def estimates(sketches: DataFrame) -> DataFrame:
    """Sketches replaced by estimates ``<column>_estimate``."""
    return sketches.select(*[c for c in sketches.columns if not c.endswith("_sketch")],
                           *[F.hll_sketch_estimate(f"{c}_sketch").alias(f"{c}_estimate") for c in COUNTED])
