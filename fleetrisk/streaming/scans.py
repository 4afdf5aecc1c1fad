"""Continuous ingestion of scan documents with Structured Streaming.

New scan files landing in a folder are read as a file stream with the scan
schema; every micro-batch is flattened against the scans' stored missing sets,
enriched with the scored CVE dimension (a static side, broadcast if its measured size allows),
rolled up to KB grain, ranked per scan and written to the batch's own folder of a
parquet table. A scan file is a complete document, so batches need no state across
triggers. foreachBatch may run a batch again after a failure; the run overwrites
the folder ``batch_id=N`` it wrote before, so the table holds each batch once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetrisk import schemas
from fleetrisk.operators import enrich, flatten, policy, rank
from fleetrisk.operators.joins import sized
from fleetrisk.session import ensure_checkpoint_dir
from fleetrisk.sources import scans as scan_source


def scan_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.SCAN).option("multiLine", True).option("mode", "PERMISSIVE")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.json(path)
    return df.select("*", scan_source.scan_identity().alias("scan_id"))


def rank_batch(batch: DataFrame, dimension: DataFrame) -> DataFrame:
    """Ranking of the missing KBs of the scans in one batch (static-DataFrame operators)."""
    docs = batch.where(F.col("_corrupt_record").isNull())
    entries = scan_source.kb_entries(docs)
    missing = scan_source.stored_missing(docs)
    flat = flatten.dedupe(flatten.flatten(entries, missing), flatten.RUNTIME_KEYS)
    scored = policy.validate(enrich.enrich(flat, dimension, measured=True, scored=True),
                             keys=flatten.RUNTIME_KEYS)
    rolled = rank.kb_rollup(scored, keys=("scan_id",))
    return rank.rank_kbs(rolled, keys=("scan_id",))


def start_ranking_stream(spark: SparkSession, scan_path: str, dimension: DataFrame, output_path: str,
                         name: str = "scan_ranking",
                         checkpoint: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Start the ingestion query; ``available_now`` processes what is there and stops."""
    dimension = sized(dimension)  # measured once, not per batch
    base = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"

    def write(batch: DataFrame, batch_id: int) -> None:
        ranked = rank_batch(batch, dimension)
        ranked.write.mode("overwrite").parquet(f"{output_path.rstrip('/')}/batch_id={batch_id}")

    writer = scan_stream(spark, scan_path).writeStream.queryName(name).foreachBatch(write).option(
        "checkpointLocation", base)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
