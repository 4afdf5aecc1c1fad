"""Join helpers: broadcast only behind a measured size, shuffle join beyond it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetrisk.session import shared_folder

# largest side (bytes of its rows as text) we are willing to ship to every executor
BROADCAST_BYTES = 64 << 20


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives executor loss.

    For large frames: Parquet is a fraction of a checkpoint's bytes, and readers open the columns that they need.
    """
    folder = shared_folder(df.sparkSession, "saved")
    if _steps:
        _steps[-1].append(folder)
    path = f"{folder}/rows.parquet"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: folders of ``saved`` in each ``saved_until_done`` that is open, the innermost last
_steps: list[list[str]] = []


@contextmanager
def saved_until_done(spark: SparkSession) -> Iterator[None]:
    """What is saved inside goes at the end: no frame that reads it may be used afterwards."""
    made: list[str] = []
    _steps.append(made)
    try:
        yield
    finally:
        _steps.pop()
        path = spark._jvm.org.apache.hadoop.fs.Path
        for folder in made:
            path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(folder), True)


def saved_alone(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The frame that ``build`` returns, saved; what was saved to build it goes, so only one step's hand-overs are on disk."""
    with saved_until_done(spark):
        out = saved(build())
        folder = _steps[-1].pop()
    if _steps:  # of a step around this one
        _steps[-1].append(folder)
    return out


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows of ``df`` as text."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns]))))).first()[0] or 0


def sized(dim: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``dim`` materialised, and marked for broadcast if its measured bytes stay within the bound.

    It is saved to the reliable checkpoint folder once, so measuring it doesn't
    compute it twice. Beyond the bound both sides are shuffled; while a shuffle partition of ``dim`` stays within the
    bound on average, it is hashed there, so the large side is not sorted. Else Spark sorts and merges, with spilling.
    """
    dim = dim.checkpoint(eager=True)
    size, parts = measured_bytes(dim), int(dim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if size <= max_bytes:
        return F.broadcast(dim)
    return dim.hint("shuffle_hash") if size <= max_bytes * parts else dim


def join_dimension(fact: DataFrame, dim: DataFrame, on, how: str = "left", measured: bool = False) -> DataFrame:
    """Join a large fact table to a dimension; ``measured`` says that ``dim`` comes from ``sized``.

    A broadcast dimension leaves the fact side where it is (no shuffle).
    """
    return fact.join(dim if measured else sized(dim), on, how)
