"""WARC archives as a Spark data source, and revisit records for equal payloads.

Writing: each task rolls archives of bounded size below a staging folder; the
driver moves those of committed tasks into place, so retried tasks leave nothing behind.
Bodies are gzip-coded inside uncompressed records: the HTTP header says so, and a
reader passes over an unwanted body by its length.

Reading: one partition for each archive. Record-type and header predicates are pushed
down; a record's headers are parsed first, and only the body of a record that the
predicates keep, where payloads are asked for, is read and decoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import itertools
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from fleetrisk.llm.common import shared_folder, ship_code

ARCHIVE_BYTES = 1 << 30
BATCH_BYTES = 8 << 20
#: fixed values of the WARC 1.1 format
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"

SCHEMA = ("record_type string, page_id long, target_uri string, record_date string, payload_digest string, "
          "payload_bytes long, refers_to long, payload binary")
SINK_SCHEMA = ("record_type string, page_id long, target_uri string, payload_digest string, payload_bytes long, "
               "refers_to long, refers_to_uri string, payload binary")
#: column: header
HEADERS = {"record_type": "warc-type", "page_id": "x-page-id", "target_uri": "warc-target-uri", "record_date": "warc-date",
           "payload_digest": "warc-payload-digest", "payload_bytes": "x-payload-length", "refers_to": "x-refers-to-page"}
NUMBERS = ("page_id", "payload_bytes", "refers_to")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, name).urn}>"


def _clean(value: str) -> str:
    """A header value: line ends would end the header."""
    return " ".join(value.split())


def record_bytes(row: dict, date: str = EPOCH, name: str = "record") -> bytes:
    """One record, its id made from ``name``. A response carries its payload gzip-coded; a revisit refers to
    its response by payload digest, URI, date and page."""
    kind, digest = row["record_type"], row["payload_digest"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if kind == "response":
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        body = packer.compress(row["payload"] or b"") + packer.flush()
        block = http + f"Content-Encoding: gzip\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    else:
        block = http + b"\r\n"
    lines = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(name)}", f"WARC-Date: {date}",
             f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {row['payload_bytes']}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {row['refers_to']}"]
        if row["refers_to_uri"] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_clean(row['refers_to_uri'])}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_bytes(date: str = EPOCH, name: str = "info") -> bytes:
    block = b"software: fleetrisk\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(name)}\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}"
    return VERSION + b"\r\n" + head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":/", ":///", 1))


def parse_headers(lines: list[bytes]) -> dict[str, str]:
    """Header names in lower case; a continued line joins the one before."""
    found, name = {}, None
    for line in lines:
        if line[:1] in b" \t" and name:
            found[name] += " " + line.strip().decode("utf-8", "replace")
        else:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def _header_block(source) -> list[bytes] | None:
    """The lines up to the next empty one; None at the end of the archive."""
    lines = []
    while line := source.readline():
        line = line.rstrip(b"\r\n")
        if line:
            lines.append(line)
        elif lines:
            return lines
    return lines or None


def read_records(source, wanted, with_payload: bool):
    """(headers, payload or None) of the records whose headers ``wanted`` accepts.

    source: a buffered, seekable binary file. Other bodies are passed over unread. A
    body is decoded as its HTTP headers say (gzip or none).
    """
    while lines := _header_block(source):
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"not a WARC record before byte {source.tell()}: {lines[0][:40]!r}")
        headers = parse_headers(lines[1:])
        length = int(headers["content-length"])
        if not wanted(headers):
            source.seek(length, io.SEEK_CUR)
            continue
        payload = None
        if with_payload and headers.get("content-type", "").startswith("application/http") and headers.get("warc-type") != "revisit":
            block = source.read(length)
            if len(block) < length:
                raise ValueError("archive ends inside a record")
            head, _, payload = block.partition(b"\r\n\r\n")
            if parse_headers(head.split(b"\r\n")[1:]).get("content-encoding") == "gzip":
                payload = gzip.decompress(payload)
        else:
            source.seek(length, io.SEEK_CUR)
        yield headers, payload


def open_archive(filesystem, path: str):
    file = io.BufferedReader(filesystem.open_input_file(path), 1 << 18)
    return io.BufferedReader(gzip.GzipFile(fileobj=file)) if path.endswith(".gz") else file


def _value(column: str, headers: dict[str, str]):
    text = headers.get(HEADERS[column])
    if text is None:
        return None
    if column == "payload_digest":
        return text.removeprefix("sha1:")
    return int(text) if column in NUMBERS else text


@dataclass
class ArchivePartition(InputPartition):
    path: str


@dataclass
class Archives(WriterCommitMessage):
    paths: list[str]


class WarcReader(DataSourceReader):
    """Options: path; payload = none (headers only), measure (decode, digest and length) or full (also return it)."""

    def __init__(self, schema, options):
        self.schema, self.path, self.payload = schema, options["path"], options.get("payload", "full")
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            # measured columns come from the body where it is decoded, so headers can't decide them
            if column in HEADERS and (self.payload == "none" or column not in ("payload_digest", "payload_bytes")):
                self.tests.append((column, frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        filesystem, root = _filesystem(self.path)
        found = filesystem.get_file_info(fs.FileSelector(root, recursive=False))
        names = sorted(f.path for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz")))
        return [ArchivePartition(name) for name in names] or [ArchivePartition("")]

    def wanted(self, headers: dict[str, str]) -> bool:
        return headers.get("warc-type") != "warcinfo" and all(_value(c, headers) in values for c, values in self.tests)

    def read(self, partition):
        if not partition.path:
            return
        filesystem, _ = _filesystem(self.path)
        names = [f.name for f in self.schema.fields]
        types = {n: pa.int64() if n in NUMBERS else pa.binary() if n == "payload" else pa.string() for n in names}
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[n]) for n in names], names=names)

        with open_archive(filesystem, partition.path) as source:
            for headers, payload in read_records(source, self.wanted, self.payload != "none"):
                row = {c: _value(c, headers) for c in HEADERS} | {"payload": payload if self.payload == "full" else None}
                if payload is not None:
                    row |= {"payload_bytes": len(payload), "payload_digest": base32_sha1(payload)}
                rows.append(row)
                size += 200 + len(row["payload"] or b"")
                if size > BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.limit, self.date = options["path"], int(options.get("archiveBytes", ARCHIVE_BYTES)), options.get("date", EPOCH)
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator):
        filesystem, root = _filesystem(self.path)
        paths, out, size = [], None, 0
        # ids differ between records, also of repeated rows: by write, task and place in the task
        names = (f"{self.staging}:{TaskContext.get().partitionId()}:{k}" for k in itertools.count())
        filesystem.create_dir(f"{root}/{self.staging}", recursive=True)
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > self.limit:
                    if out is not None:
                        out.close()
                    paths.append(f"{uuid.uuid4().hex}.warc")
                    out = filesystem.open_output_stream(f"{root}/{self.staging}/{paths[-1]}", buffer_size=1 << 20)
                    size = out.write(info_bytes(self.date, next(names)))
                size += out.write(record_bytes(row, self.date, next(names)))
        if out is not None:
            out.close()
        return Archives(paths)

    def commit(self, messages):
        filesystem, root = _filesystem(self.path)
        for message in messages:
            for name in message.paths if message is not None else []:
                filesystem.move(f"{root}/{self.staging}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages):
        from pyarrow import fs

        filesystem, root = _filesystem(self.path)
        if filesystem.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            filesystem.delete_dir(f"{root}/{self.staging}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; option path names a folder that all machines share."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    ship_code(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest):
    """Base32 of a 40-digit hex column: 8 groups of 5 hex digits are 4 letters each."""
    groups = []
    for k in range(8):
        value = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("long")
        groups += [F.substring(F.lit(BASE32), (F.shiftright(value, shift).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*groups)


def archive_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The WARC record of each page (page_id, url, html): columns of the sink.

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the
    smallest page_id are responses, the others revisit it. A null html is an empty
    payload. A null page_id never is the smallest; if a payload has only such rows, all
    are responses. Only a digest, its length, a page_id and its url per distinct payload
    and task are aggregated; the copies of a payload meet their first by a join whose hot keys AQE can split.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = (pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
            .withColumn("hex", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long")))
    first = (rows.where(F.col("payload_bytes") >= least_bytes).groupBy("hex")
             .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "target_uri"))).alias("first"),
                  F.max("payload_bytes").alias("payload_bytes"), F.count("*").alias("copies"))
             .where("copies > 1").select("hex", "payload_bytes", F.col("first.page_id").alias("first_id"), F.col("first.target_uri").alias("first_uri")))
    # joined on more than the grouping key, so both sides are dealt anew and a hot payload can be split
    joined = rows.join(first, ["hex", "payload_bytes"], "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(F.when(again, "revisit").otherwise("response").alias("record_type"), "page_id", "target_uri",
                         base32_of_hex(F.col("hex")).alias("payload_digest"), "payload_bytes",
                         F.when(again, F.col("first_id")).alias("refers_to"),
                         F.when(again, F.col("first_uri")).alias("refers_to_uri"), F.when(~again, F.col("payload")).alias("payload"))


def write_archives(pages: DataFrame, path: str | None = None, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write the pages as WARC archives; returns the folder (a new shared one by default)."""
    spark = pages.sparkSession
    register(spark)
    path = path or shared_folder(spark, "warc")
    (archive_records(pages, least_bytes).write.format("warc").option("path", path).option("archiveBytes", archive_bytes)
     .mode("append").save())
    return path


def read_archives(spark: SparkSession, path: str, payload: str = "full") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", payload).load()


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive the pages and read the archives back: the contract's rows.

    Responses are measured from their decoded bodies, revisits from headers alone.
    """
    spark, path = pages.sparkSession, write_archives(pages)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = read_archives(spark, path, "measure").where(F.col("record_type") == "response")
    revisits = read_archives(spark, path, "none").where(F.col("record_type") == "revisit")
    return responses.select(*columns).unionByName(revisits.select(*columns))


#: the rows of ``round_trip``: what the archives must give back
ORACLE = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first_id FROM p GROUP BY hex HAVING count(*) > 1),
j AS (SELECT p.*, CASE WHEN f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
      FROM p LEFT JOIN f USING (hex))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM j
"""
