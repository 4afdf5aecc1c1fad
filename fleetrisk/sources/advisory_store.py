"""Advisory metadata kept by month: incremental loads, and reads that prune months at run time.

The store is Parquet partitioned by month, one row per (month, CVE). A load merges its rows into the
months it touches, last load and position win, and overwrites only their partitions; a load that
runs again gives the same store. ``for_windows`` joins hosts' month windows to the partition column, so
Spark prunes the months that no window asks for when it runs (dynamic partition pruning).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetrisk.functions.ids import is_cve_id
from fleetrisk.functions.months import parse_month_id
from fleetrisk.operators.joins import sized

FIELDS = ("severity", "base_score", "vector", "published_date", "exploitation")
SCHEMA = "cve_id string, severity string, base_score double, vector string, published_date string, exploitation string, load long, pos long, month date"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Columns of SCHEMA; an empty store has no rows."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def upsert(rows: DataFrame, path: str, load: int) -> list:
    """Merge metadata rows (``advisory.metadata_rows``) into the store; returns the months rewritten.

    load: number of this load; of a month's rows of one CVE the highest (load, pos) stays. Rows
    whose month is not one, or whose id is not a CVE's, are left out. What reaches the driver is
    one row per month of the load.
    """
    spark = rows.sparkSession
    new = rows.select("cve_id", *FIELDS, F.lit(load).cast("long").alias("load"), F.col("pos").cast("long"), parse_month_id("month").alias("month"))
    new = new.where(F.col("month").isNotNull() & is_cve_id("cve_id")).checkpoint(eager=True)
    months = sorted(r["month"] for r in new.select("month").distinct().collect())
    if not months:
        return []
    both = read(spark, path).where(F.col("month").isin(*months)).select(new.columns).unionByName(new)
    best = both.groupBy("month", "cve_id").agg(F.max_by(F.struct(*FIELDS, "load", "pos"), F.struct("load", "pos")).alias("f"))
    # the old rows are read before their partitions are overwritten
    merged = best.select("cve_id", "f.*", "month").checkpoint(eager=True)
    (merged.repartitionByRange("month", "cve_id").sortWithinPartitions("month", "cve_id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path))
    return months


def for_windows(store: DataFrame, windows: DataFrame, key: str = "scan_id") -> DataFrame:
    """(key, cve_id, fields, month): per host and CVE the last month within the host's window.

    windows: (key, pos from 1, month_id), each host's months. Hosts of one window share it: the
    last-wins pick runs once per distinct window, however many hosts there are. The months of
    all windows (windows x their length, measured) are broadcast; beyond the bound the join is
    shuffled, and every month is read.
    """
    span = windows.groupBy(key).agg(F.min(parse_month_id("month_id")).alias("first"), F.max(parse_month_id("month_id")).alias("last"))
    span = span.withColumn("window", F.concat_ws("/", "first", "last")).checkpoint(eager=True)
    months = span.select("window", "first", "last").distinct().select(
        "window", F.posexplode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("at", "month"))
    wanted = sized(months).where(F.col("at") >= 0)  # a predicate marks this side as one worth pruning by
    hit = store.join(wanted, "month")
    best = hit.groupBy("window", "cve_id").agg(F.max_by(F.struct(*FIELDS, "month"), "month").alias("f"))
    return span.select(key, "window").join(best.select("window", "cve_id", "f.*"), "window").drop("window")
