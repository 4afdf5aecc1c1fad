"""Scan documents as a Spark data source: ``spark.read.format("scans")``, ``readStream`` and ``write``.

Partitions are planned from the file listing: the host (parent folder) and the time of a scan are in its
path, so the newest scan of each host is chosen, and comparisons of host and scan_ts are applied, before
any file is opened. Batch and stream read files by the same code.

A scan too large for one document is written as parts ``scan_<time>.<number>-of-<count>.json``, each a
document with a slice of the lists. Each part is written under another name and then renamed, so a
repeated task writes the same file again; a scan counts only when all its parts are listed, so
readers never see half of one, whatever tasks or jobs fail. Files whose names end in ``.json.gz`` are compressed.
"""

from __future__ import annotations

import gzip
import json
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage)

from fleetrisk import schemas
from fleetrisk.session import ship_package

#: bytes of files that one partition reads, and of rows in one batch
PARTITION_BYTES, BATCH_BYTES = 32 << 20, 8 << 20
#: bytes of a document for a byte of its compressed file, about
PACKED = 10
#: fixed values: names of scan files
SCAN_FILE = re.compile(r"(?P<scan>.+?)(?:\.(?P<part>\d+)-of-(?P<parts>\d+))?\.json(?P<packed>\.gz)?$")
SCAN_TIME = re.compile(r"scan_(\d{8}_\d{6})")

SCHEMA = T.StructType([*schemas.SCAN.fields, T.StructField("scan_id", T.StringType()), T.StructField("host", T.StringType()),
                       T.StructField("scan_ts", T.TimestampType()), T.StructField("file_name", T.StringType()),
                       T.StructField("valid", T.BooleanType())])
SINK_SCHEMA = "host string, file_name string, document string"


def filesystem_of(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":/", ":///", 1))


@dataclass(frozen=True)
class ScanFile:
    path: str
    host: str
    scan: str  # file name without part and extension
    name: str
    time: datetime
    size: int
    landed: int  # modification time, ns
    parts: int


def listed(path: str) -> list[ScanFile]:
    """Files of all complete scans below ``path``."""
    from pyarrow import fs

    filesystem, root = filesystem_of(path)
    found, parts = [], defaultdict(set)
    for info in filesystem.get_file_info(fs.FileSelector(root, recursive=True)):
        name = info.path.rsplit("/", 1)[-1]
        match = SCAN_FILE.match(name)
        if not info.is_file or match is None or name.startswith((".", "_")):
            continue
        host = info.path.rsplit("/", 2)[-2]
        stamp = SCAN_TIME.search(name)
        try:
            time = datetime.strptime(stamp[1], "%Y%m%d_%H%M%S").replace(tzinfo=UTC) if stamp else None
        except ValueError:
            time = None
        time = time or datetime.fromtimestamp(info.mtime_ns / 1e9, UTC)
        file = ScanFile(info.path, host, match["scan"], name, time, info.size * (PACKED if match["packed"] else 1), info.mtime_ns, int(match["parts"] or 1))
        parts[host, file.scan, file.parts].add(match["part"])
        found.append(file)
    return sorted((f for f in found if len(parts[f.host, f.scan, f.parts]) >= f.parts), key=lambda f: f.path)


def newest(files: list[ScanFile]) -> list[ScanFile]:
    """Files of the newest scan of each host, by (time, name)."""
    best: dict[str, tuple] = {}
    for f in files:
        best[f.host] = max(best.get(f.host, (f.time, f.scan)), (f.time, f.scan))
    return [f for f in files if best[f.host] == (f.time, f.scan)]


def fitted(value, kind: T.DataType):
    """A JSON value as the column's type; one that doesn't fit is null, a number or flag in a text column its JSON text."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: fitted(value.get(f.name), f.dataType) for f in kind.fields} if isinstance(value, dict) else None
    if isinstance(kind, T.ArrayType):
        return [fitted(v, kind.elementType) for v in value] if isinstance(value, list) else None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    return value if isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63 else None


def opened(filesystem, path: str) -> bytes:
    with filesystem.open_input_file(path) as source:
        data = source.read()
    return gzip.decompress(data) if path.endswith(".gz") else data


def read_files(path: str, files: list[ScanFile], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """One row per file; a top level that is not an object gives a row with ``valid = false`` and the text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    filesystem, _ = filesystem_of(path)
    arrow, rows, size = to_arrow_schema(schema), [], 0
    for f in files:
        try:
            text = opened(filesystem, f.path).decode("utf-8", "replace")
        except (EOFError, gzip.BadGzipFile, zlib.error) as bad:
            text = f"{f.name}: {bad}"
        try:
            document = json.loads(text)
        except ValueError:
            document = None
        valid = isinstance(document, dict)
        row = fitted(document if valid else {}, schemas.SCAN)
        row |= {"_corrupt_record": None if valid else text, "scan_id": f"{f.host}/{f.scan}", "host": f.host, "scan_ts": f.time, "file_name": f.name, "valid": valid}
        rows.append(row)
        size += len(text)
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)


@dataclass
class Files(InputPartition):
    files: list[ScanFile]


def dealt(files: list[ScanFile], limit: int = PARTITION_BYTES) -> list[Files]:
    """Partitions of about ``limit`` bytes, one file at least."""
    out, size = [Files([])], 0
    for f in files:
        if out[-1].files and size + f.size > limit:
            out.append(Files([]))
            size = 0
        out[-1].files.append(f)
        size += f.size
    return out


def _moment(value) -> datetime:
    return value if value.tzinfo else value.replace(tzinfo=UTC)


class ScanReader(DataSourceReader):
    """Options: path, latest (true: only each host's newest scan). Predicates apply to the chosen scans."""

    COMPARE = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
               LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}

    def __init__(self, schema: T.StructType, options):
        self.schema, self.path = schema, options["path"]
        self.latest = str(options.get("latest", "false")).lower() == "true"
        self.limit = int(options.get("partitionBytes", PARTITION_BYTES))
        self.hosts: list[frozenset] = []
        self.times: list[tuple[type, datetime]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if isinstance(f, In | EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) else None
            if column == "host" and isinstance(f, In | EqualTo):
                self.hosts.append(frozenset(f.value if isinstance(f, In) else [f.value]))
            elif column == "scan_ts" and type(f) in self.COMPARE:
                self.times.append((type(f), _moment(f.value)))
            else:
                yield f

    def chosen(self) -> list[ScanFile]:
        files = [f for f in listed(self.path) if all(f.host in names for names in self.hosts)]
        files = newest(files) if self.latest else files  # then the time: a host whose newest scan fails it has none
        return [f for f in files if all(self.COMPARE[kind](f.time, value) for kind, value in self.times)]

    def partitions(self):
        return dealt(self.chosen(), self.limit)

    def read(self, partition):
        return read_files(self.path, partition.files, self.schema)


class ScanStream(DataSourceStreamReader):
    """Scans in the order they land: by modification time, then path. A file must land with a new modification time."""

    def __init__(self, schema: T.StructType, options):
        self.schema, self.path = schema, options["path"]

    def initialOffset(self):
        return {"landed": -1, "path": ""}

    def latestOffset(self):
        last = max(((f.landed, f.path) for f in listed(self.path)), default=(-1, ""))
        return {"landed": last[0], "path": last[1]}

    def partitions(self, start, end):
        low, high = ((o["landed"], o["path"]) for o in (start, end))
        return dealt([f for f in listed(self.path) if low < (f.landed, f.path) <= high])

    def read(self, partition):
        return read_files(self.path, partition.files, self.schema)

    def commit(self, end):
        pass


class ScanWriter(DataSourceArrowWriter):
    """Rows of SINK_SCHEMA: one file each, ``host/file_name``, renamed into place; compressed if the name ends in ``.gz``."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        filesystem, root = filesystem_of(self.path)
        made = set()
        for batch in iterator:
            for host, name, document in zip(*(c.to_pylist() for c in batch.columns)):
                if host not in made:
                    filesystem.create_dir(f"{root}/{host}", recursive=True)
                    made.add(host)
                hidden = f"{root}/{host}/.{uuid.uuid4().hex}"
                with filesystem.open_output_stream(hidden, compression=None) as out:
                    out.write(gzip.compress(document.encode(), 1, mtime=0) if name.endswith(".gz") else document.encode())
                filesystem.move(hidden, f"{root}/{host}/{name}")
        return WriterCommitMessage()


class ScanSource(DataSource):
    @classmethod
    def name(cls):
        return "scans"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ScanReader(schema, self.options)

    def streamReader(self, schema):
        return ScanStream(schema, self.options)

    def writer(self, schema, overwrite):
        return ScanWriter(self.options)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ScanSource)


def read(spark: SparkSession, path: str, latest: bool = False, required: bool = True) -> DataFrame:
    """Scan documents below ``path`` with the columns of ``scans.read_scans``; ``latest``: each host's newest only.

    Raises when there is no scan file at all and ``required`` holds.
    """
    register(spark)
    if required and not listed(path):
        raise FileNotFoundError(f"no scan files found under {path}")
    return spark.read.format("scans").option("path", path).option("latest", str(latest).lower()).load()


def stream(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("scans").option("path", path).load()


def write(documents: DataFrame, path: str) -> None:
    """documents: SINK_SCHEMA."""
    register(documents.sparkSession)
    documents.select("host", "file_name", F.col("document")).write.format("scans").option("path", path).mode("append").save()
