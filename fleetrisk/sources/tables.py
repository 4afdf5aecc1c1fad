"""Stage-table sources and sinks: parquet between jobs, CSV/JSON for interchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetrisk import schemas
from fleetrisk.operators.joins import saved
from fleetrisk.sources import run_log


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def write_stage(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Parquet hand-off between jobs (replaces the reference's CSV hand-offs)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def _flatten_arrays(df: DataFrame, sep: str = ", ") -> DataFrame:
    """CSV cannot hold arrays/structs: arrays of strings are joined, structs serialised to JSON."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            cols.append(F.array_join(F.col(f.name), sep).alias(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(cols)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Interchange CSV with header and no index column."""
    _flatten_arrays(df).write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             na_tokens: tuple[str, ...] = ()) -> DataFrame:
    """CSV with an explicit schema; optional tokens turned into nulls (D13 parity)."""
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    if na_tokens:
        df = df.select([
            F.when(F.col(f.name).isin(*na_tokens), None).otherwise(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in df.schema.fields])
    return df


def write_ranking(ranking: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Ranking JSON sink; nested CVE arrays kept, one folder per scan.

    Ranges of (scan, rank) go to tasks, so a large scan spreads over several and small ones share one. Rows are saved first: finding
    the ranges reads them once more, and what their lists were gathered from is freed. Files are compressed, as drivers repeat.
    """
    order = [c for c in ("scan_id", "rank", "segment") if c in ranking.columns]
    ranking = saved(ranking)
    ranking.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("scan_id").json(path, compression="gzip")


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """Ranking JSON source with the ranking schema.

    Accepts JSON lines (as ``write_ranking`` writes them) and files that are one JSON list.
    Rows that are not objects go to _corrupt_record; so does a line that is a list or a scalar.
    """
    schema = T.StructType([*schemas.RANKING.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_ranking_list(spark: SparkSession, path: str) -> DataFrame:
    """Ranking file whose top level must be a JSON list of objects; anything else raises."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    not_list = whole.where(~(F.col("value").startswith("[") & F.col("value").endswith("]")))
    if not not_list.isEmpty():
        raise ValueError(f"ranking file below {path} is not a JSON list")
    parsed = F.from_json("value", T.ArrayType(schemas.RANKING))
    return whole.select(F.inline(parsed))


def write_summary(spark: SparkSession, run_id: str, stage: str, metrics: DataFrame, path: str, attempt: int = 1) -> bool:
    """Log a stage summary (long table metric/value) keyed by run, stage and attempt: written again, it stays one."""
    return run_log.record(spark, path, run_id, stage, metrics, attempt=attempt)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Long table (run_id, stage, metric, value) of the last attempts."""
    return run_log.metrics(run_log.read(spark, path))
