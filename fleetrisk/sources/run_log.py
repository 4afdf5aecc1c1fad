"""Log of runs: one record per (run, stage, attempt), committed by write-then-rename.

A record is written to a folder of its own under another name and renamed into place. A task, job or
driver that runs again finds the place taken and adds nothing, and a reader never sees half a
record. Of a stage's attempts the last counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUCCEEDED, FAILED, MISSING = "succeeded", "failed", "missing"
RECORD = "status string, message string, metrics map<string,double>, artefacts map<string,string>, run_id string, stage string, attempt int"


def _place(path: str, run_id: str, stage: str, attempt: int) -> str:
    for part in (run_id, stage):
        if not part or any(c in part for c in "/=\\") or part.startswith(("_", ".")):
            raise ValueError(f"not a name of a run or stage: {part!r}")
    return f"{path.rstrip('/')}/run_id={run_id}/stage={stage}/attempt={attempt}"


def record(spark: SparkSession, path: str, run_id: str, stage: str, metrics: DataFrame | None = None, status: str = SUCCEEDED,
           artefacts: dict[str, str] | None = None, attempt: int = 1, message: str | None = None) -> bool:
    """Log one attempt of a stage; False if it was logged before, and nothing changes then.

    metrics: a long table (metric, value) of a stage's summary, gathered into the record's one row.
    """
    jvm, place = spark._jvm, _place(path, run_id, stage, attempt)
    final = jvm.org.apache.hadoop.fs.Path(place)
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(final):
        return False
    pending = f"{path.rstrip('/')}/_pending/{uuid.uuid4().hex}"
    if metrics is None:
        metrics = spark.createDataFrame([], "metric string, value double")
    one = metrics.agg(F.map_from_entries(F.collect_list(F.struct("metric", F.col("value").cast("double")))).alias("metrics"))
    named = F.create_map(*[F.lit(x) for pair in sorted((artefacts or {}).items()) for x in pair]) if artefacts else F.lit(None)
    (one.select(F.lit(status).alias("status"), F.lit(message).cast("string").alias("message"), "metrics",
                named.cast("map<string,string>").alias("artefacts")).coalesce(1).write.json(pending))
    fs.mkdirs(final.getParent())
    if fs.exists(final) or not fs.rename(jvm.org.apache.hadoop.fs.Path(pending), final):
        fs.delete(jvm.org.apache.hadoop.fs.Path(pending), True)
        return False
    return True


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records: columns of RECORD."""
    return spark.read.schema(RECORD).option("pathGlobFilter", "*.json").json(path)  # folders that begin with _ are not read


def latest(log: DataFrame) -> DataFrame:
    """The last attempt of each stage of each run."""
    fields = F.struct("attempt", "status", "message", "metrics", "artefacts")
    return log.groupBy("run_id", "stage").agg(F.max_by(fields, "attempt").alias("r")).select("run_id", "stage", "r.*")


def statuses(log: DataFrame, stages: list[str]) -> DataFrame:
    """(run_id, stage, status, attempts) of every expected stage of each run; one never logged is missing."""
    expected = log.select("run_id").distinct().withColumn("stage", F.explode(F.array(*[F.lit(s) for s in stages])))
    tries = log.groupBy("run_id", "stage").agg(F.count(F.lit(1)).alias("attempts"))
    return (expected.join(latest(log).select("run_id", "stage", "status"), ["run_id", "stage"], "left").join(tries, ["run_id", "stage"], "left")
            .select("run_id", "stage", F.coalesce("status", F.lit(MISSING)).alias("status"), F.coalesce("attempts", F.lit(0).cast("long")).alias("attempts")))


def metrics(log: DataFrame, stage: str | None = None) -> DataFrame:
    """Long table (run_id, stage, metric, value) of the stages that succeeded last."""
    rows = latest(log).where(F.col("status") == SUCCEEDED)
    rows = rows if stage is None else rows.where(F.col("stage") == stage)
    return rows.select("run_id", "stage", F.explode("metrics").alias("metric", "value"))


def artefacts(log: DataFrame, stage: str | None = None) -> DataFrame:
    """Long table (run_id, stage, name, path)."""
    rows = latest(log) if stage is None else latest(log).where(F.col("stage") == stage)
    return rows.select("run_id", "stage", F.explode("artefacts").alias("name", "path"))
