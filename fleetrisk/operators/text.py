"""Extraction from stored HTML pages, as table jobs over a pages table."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# fixed values: extraction patterns
PACKAGE_URL_PATTERN = r"(?i)https?://[^\"]+\.(?:msu|cab)(?:\?[^\"]*)?"
HREF_PATTERN = r"""href="([^"]*)\""""
RESULT_TABLE_ID = "ctl00_catalogBody_updateMatches"
UPDATE_ID_PATTERN = r"^[0-9a-fA-F-]{36}$"
CANDIDATE_FIELDS = ("title", "products", "classification", "last_updated", "version", "size")
#: pages go to Python workers in batches of so many rows and bytes; a page that is larger goes alone
PAGE_BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: result rows that a task holds before it sends them
ROWS_HELD = 4_000


def extract_urls(pages: DataFrame, html: str = "html", pattern: str = PACKAGE_URL_PATTERN,
                 group: int = 0, keys=("page_id",)) -> DataFrame:
    """Distinct matches per page in first-seen order, one row each, with file name.

    ``array_distinct`` keeps the first occurrence, so position = first-seen order.
    """
    urls = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(pattern), group))
    out = pages.select(*keys, F.posexplode(urls).alias("pos", "url"))
    name = F.substring_index(F.substring_index(F.col("url"), "/", -1), "?", 1)
    return out.withColumn("file_name", name)


class _ResultTable(HTMLParser):
    """Rows of one table by id: (row id, visible text of each cell). Tables inside a cell are
    part of its text; entities are decoded; tags separate words."""

    def __init__(self, table_id: str):
        super().__init__(convert_charrefs=True)
        self.table_id, self.depth = table_id, 0
        self.rows: list[tuple[str, list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table" and (self.depth or dict(attrs).get("id") == self.table_id):
            self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self.cell = None
            self.rows.append(((dict(attrs).get("id") or "").strip(), []))
        elif self.depth == 1 and tag in ("td", "th") and self.rows:
            self.cell = []
            self.rows[-1][1].append("")
        self._text(" ")

    def handle_endtag(self, tag):
        if self.depth == 1 and tag in ("td", "th", "tr", "table"):
            self.cell = None
        if self.depth and tag == "table":
            self.depth -= 1
        self._text(" ")

    def handle_data(self, data):
        self._text(data)

    def _text(self, data):
        if self.cell is not None and self.rows:
            self.cell.append(data)
            if data != " ":
                self.rows[-1][1][-1] = " ".join("".join(self.cell).split())


def parse_result_rows(html: str | None, table_id: str = RESULT_TABLE_ID) -> list[tuple]:
    """(position, update id, six text fields) of the result rows of one page."""
    parser = _ResultTable(table_id)
    parser.feed(html or "")
    parser.close()
    found = []
    for pos, (row_id, cells) in enumerate(parser.rows):
        update_id, mark, _ = row_id.partition("_R")
        if mark and re.match(UPDATE_ID_PATTERN, update_id) and len(cells) >= 8:
            found.append((pos, update_id, *cells[1:7]))
    return found


def result_rows(pages: DataFrame, html: str = "html", table_id: str = RESULT_TABLE_ID,
                keys=("page_id",)) -> DataFrame:
    """Rows of the catalog result table: id '<36-char id>_R<n>', >= 8 cells, 6 text fields.

    Markup is nested and quoted in ways a pattern can't follow, so each page goes through
    an HTML parser, in Arrow batches; a page's rows depend on that page alone. Batches are bounded in
    bytes (PAGE_BATCH_CONF), pages are opened one by one and rows sent in runs of about ROWS_HELD, so a
    worker's memory is that of one batch and one page, however many pages there are.
    """
    for name, value in PAGE_BATCH_CONF.items():
        pages.sparkSession.conf.set(name, value)
    fields = [StructField("candidate_pos", IntegerType())] + [StructField(c, StringType()) for c in ("update_id", *CANDIDATE_FIELDS)]
    source = pages.select(F.col(html).cast("string").alias("__html"), *keys)
    schema = StructType([*source.schema.fields[1:], *fields])
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            column, rows, parents = batch.column(0), [], []
            keys_of = batch.select(list(range(1, batch.num_columns)))

            def sent():
                kept = keys_of.take(pa.array(parents, pa.int64()))
                own = [pa.array(c, pa.int32() if k == 0 else pa.string()) for k, c in enumerate(zip(*rows))]
                return pa.RecordBatch.from_arrays([*kept.columns, *own], names=names)

            for at in range(batch.num_rows):
                page = column[at].as_py()
                if page and table_id in page:
                    found = parse_result_rows(page, table_id)
                    rows += found
                    parents += [at] * len(found)
                    if len(rows) >= ROWS_HELD:
                        yield sent()
                        rows, parents = [], []
            if rows:
                yield sent()

    return source.mapInArrow(run, schema)
