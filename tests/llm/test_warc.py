import base64
import gzip
import hashlib
import io

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from brute import SF
from fleetrisk.llm import warc
from fleetrisk.llm.common import table

PAGES = [(3, "http://a", "same"), (1, "http://b", "same"), (2, "http://c\r\nX: y", "other é"), (4, None, None), (5, "u", ""),
         (None, "n", "same"), (None, "n", "alone"), (2, "http://c", "other é"), (6, "big", "x" * 300_000)]
SCHEMA = "page_id long, url string, html string"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip_of_odd_pages(spark):
    found = sorted(tuple(r) for r in warc.round_trip(spark.createDataFrame(PAGES, SCHEMA).withColumn("payload", F.lit(1))).fillna(-1).collect())
    expected = []
    for page_id, _, html in PAGES:
        first = {"same": 1, "other é": 2, None: 4, "": 4, "alone": None}.get(html, page_id)
        again = first is not None and page_id != first
        expected.append((-1 if page_id is None else page_id, len((html or "").encode()), sha(html), "revisit" if again else "response", first if again else -1))
    assert found == sorted(expected)


def test_record_ids_differ(spark):
    """Also of repeated rows, of rows without page_id, of the archives' own records and of two writes to one folder."""
    pages = spark.createDataFrame(PAGES * 2 + [(7, "http://z", "x" * 100)] * 40, SCHEMA).repartition(3)
    path = warc.write_archives(pages, archive_bytes=500)
    warc.write_archives(pages, path, archive_bytes=500)
    ids, uris = [], set()
    filesystem, root = warc._filesystem(path)
    for found in filesystem.get_file_info(fs.FileSelector(root)):
        with filesystem.open_input_stream(found.path) as f:
            for headers, _ in warc.read_records(io.BytesIO(f.read()), lambda h: True, False):
                ids.append(headers["warc-record-id"])
                uris.add((headers.get("x-refers-to-page"), headers.get("warc-refers-to-target-uri")))
    assert len(ids) > 2 * len(PAGES * 2) + 80 and len(set(ids)) == len(ids)
    assert {("1", "http://b"), ("4", None)} <= uris


def test_small_payloads_are_responses(spark):
    records = warc.archive_records(spark.createDataFrame(PAGES, SCHEMA), least_bytes=5)
    assert {(r.page_id, r.record_type) for r in records.collect() if r.page_id in (1, 3, 4, 5)} == {(k, "response") for k in (1, 3, 4, 5)}


def test_whole_table(spark):
    pages = table(spark, SF, "pages")
    path = warc.write_archives(pages, archive_bytes=50_000)
    back = warc.read_archives(spark, path).where("record_type = 'response'")
    assert {(r.page_id, r.target_uri, bytes(r.payload).decode()) for r in back.collect()} == {tuple(r) for r in pages.collect()}


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_predicates_are_pushed_and_bodies_skipped(spark):
    path = warc.write_archives(spark.createDataFrame(PAGES, SCHEMA))
    one = warc.read_archives(spark, path, "none").where("page_id = 3 and record_type = 'revisit'")
    assert [(r.payload, r.refers_to, r.payload_bytes) for r in one.collect()] == [(None, 1, 4)]
    assert " = 3" not in one._jdf.queryExecution().executedPlan().toString()  # no test is left above the scan
    assert warc.read_archives(spark, path, "none").where(F.col("page_id").isin(2, 6)).count() == 3


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_unwanted_bodies_are_not_read():
    row = {"record_type": "response", "page_id": 1, "target_uri": "u", "payload_digest": sha("x"), "payload_bytes": 1, "refers_to": None, "payload": b"x"}
    data = warc.info_bytes() + warc.record_bytes(row) + warc.record_bytes(row | {"page_id": 2})
    source = Counting(data)
    found = list(warc.read_records(source, lambda h: h.get("x-page-id") == "2", True))
    assert [p for _, p in found] == [b"x"] and source.taken < 200


def test_other_writers_archives(spark, tmp_path):
    """Whole-file gzip, an uncoded body and a continued header line are read as well."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    record = (b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/\r\n b\r\nContent-Type: application/http\r\nContent-Length: "
              + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    (tmp_path / "b.warc").write_bytes(record)
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert [(bytes(r.payload), r.target_uri) for r in rows] == [(b"<p>hi</p>", "http://a/ b")] * 3


def test_broken_archive_is_an_error():
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(b"no warc\r\n\r\n"), lambda h: True, False))
