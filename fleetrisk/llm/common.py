"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetrisk.session import ensure_checkpoint_dir

#: whole texts go to Python workers in batches of bounded size
ARROW_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: UTF-8 bytes handled at once inside a task, whatever the Arrow batch size
SLICE_BYTES = 4 << 20

#: fixed odd multipliers of the 64-bit mixers (splitmix64)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Let executors import this package: they get it as a zip through Spark's own file server.

    Functions are pickled by name, so that workers keep compiled tokenizers between tasks.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="fleetrisk-code-")  # only the driver reads it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/fleetrisk-code.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def prepare(spark: SparkSession) -> None:
    """What every operator needs of a session: the shared folder, this package on the executors, small Arrow batches."""
    ensure_checkpoint_dir(spark)
    for name, value in ARROW_CONF.items():
        spark.conf.set(name, value)
    ship_code(spark)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; the package is asked for only when a path is needed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared checkpoint folder, deleted when the JVM ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    return fs.makeQualified(hadoop_path).toString()


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = shared_folder(spark, tag)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into zero-copy slices of about ``limit`` bytes of text, one row at least."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start, n = 0, batch.num_rows
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Return freed memory to the system: workers live from stage to stage, and would keep their largest batch's."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # glibc
        _LIBC.malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GOLDEN) | np.uint64(1)
POWER_BASE = np.uint64(0x9DDFEA08EB382D69)
ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _powers(n: int, cache: list = []) -> np.ndarray:  # noqa: B006
    if not cache or len(cache[0]) < n:
        size = max(64, 1 << (n - 1).bit_length())
        cache[:] = [np.cumprod(np.append(np.uint64(1), np.full(size - 1, POWER_BASE)), dtype=np.uint64)]
    return cache[0]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end) of each row's UTF-8 text; a null row is empty."""
    col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(col) else (0, 0)
    raw = np.frombuffer(data, dtype=np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    starts, ends = offsets[:-1] - lo, offsets[1:] - lo
    if col.null_count:
        null = col.is_null().to_numpy(zero_copy_only=False)
        ends = np.where(null, starts, ends)
    return raw, starts, ends


class Words(NamedTuple):
    """Words of a slice of texts: row r holds words ``bounds[r]`` to ``bounds[r + 1]``; word w is ``raw[begin[w]:end[w]]``."""

    hashes: np.ndarray
    bounds: np.ndarray
    raw: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def words_of(col: pa.Array, lower: bool) -> Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each row with 64-bit hashes.

    The hash is a polynomial over mixed byte codes modulo 2**64, finalised; two
    different words collide with a chance of about 2**-64.
    """
    raw, starts, ends = text_bytes(col)
    if lower:
        raw = LOWER[raw]
    inside = ~ASCII_SPACE[raw]
    first = inside.copy()
    if len(raw):
        first[1:] &= ~inside[:-1]
        row_starts = starts[(starts < len(raw)) & (ends > starts)]
        first[row_starts] = inside[row_starts]  # a row's text never continues the row before
    begin = np.flatnonzero(first)
    bounds = np.searchsorted(begin, np.append(starts, len(raw)))
    if not len(begin):
        return Words(np.zeros(0, np.uint64), np.zeros(len(col) + 1, np.int64), raw, begin, begin)
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    end = np.flatnonzero(last) + 1
    size = end - begin
    edges = np.concatenate(([0], begin, [len(raw)]))
    place = np.arange(len(raw)) - np.repeat(edges[:-1], np.diff(edges))
    np.minimum(place, size.max() - 1, out=place)  # white space between words may run longer than any word
    values = BYTE_CODES[raw]
    values *= _powers(int(size.max()))[place]
    values[~inside] = 0
    return Words(mix64(np.add.reduceat(values, begin)), bounds, raw, begin, end)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes; shorter input gives none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * GOLDEN + words[k:k + n]
    return mix64(total)


def crc_mod(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus
