"""Removal of repeated word sequences through difference-cover anchors.

Two equal windows of 13 words start at places i and j of their documents. The residues
{1, 2, 4} modulo 7 are a difference cover: some shift below 7 takes both places to cover
residues, and the 7 words from there lie inside both windows. So hashing 7-word runs
at cover places alone (3 of 7) finds every match: it shares an aligned anchor.

1. Anchors: a task's block of documents sends each anchor hash, once if several of its documents have it,
   to the hash's part; parts answer the blocks which anchors occur elsewhere.
2. Extension: only windows that hold a shared anchor are hashed whole; a block sends a window for
   its smallest document, parts answer whether a smaller doc_id has it anywhere.
3. Removal: words under answered windows go.

What is sent is packed: one row holds a block's entries for one part. A hash that a
third of the documents share costs one entry a block, never one a document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetrisk.llm.common import give_back, stored, text_slices, window_hashes, words_of
from fleetrisk.llm.decontaminate import bounded

WINDOW = 13
PERIOD, COVER = 7, (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
#: entries of a part, about: it sets the number of parts from the size of the texts
PART_ENTRIES = 400_000
BYTES_PER_ANCHOR = 14
MAX_BLOCK_ROWS = 1 << 16

MESSAGE = "part long, block long, data binary"
MESSAGE_SCHEMA = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])
PLACES_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("places", pa.binary())])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one blob, each with its type and length in front."""
    return b"".join(a.dtype.str.encode().ljust(4) + np.uint64(len(a)).tobytes() + np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(data: bytes) -> list[np.ndarray]:
    found, at = [], 0
    while at < len(data):
        kind = np.dtype(data[at:at + 4].decode().strip())
        n = int(np.frombuffer(data, np.uint64, 1, at + 4)[0])
        found.append(np.frombuffer(data, kind, n, at + 12))
        at += 12 + n * kind.itemsize
    return found


def small(values: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds the values."""
    top = int(values.max(initial=0))
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def _blocks(batches, column: str):
    """(block id, rows) over a task's input; ids are the same when a task runs again."""
    task, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        for part in text_slices(batch, column):
            for at in range(0, part.num_rows, MAX_BLOCK_ROWS):
                yield task << 32 | k, part.slice(at, MAX_BLOCK_ROWS)
                k += 1


def _messages(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(MESSAGE_SCHEMA)], schema=MESSAGE_SCHEMA)


def _send(block: int, parts: int, header: bytes, hashes: np.ndarray, *entries: np.ndarray) -> pa.RecordBatch:
    """The header to the block itself (a part of its own below zero), the entries to their hashes' parts."""
    part = ((hashes >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    ends = np.append(cuts[1:], len(order))
    rows = [(-1 - block, block, header)]
    for b, e in zip(cuts.tolist(), ends.tolist(), strict=True):
        own = order[b:e]
        rows.append((int(part[own[0]]), block, pack(*(small(x[own]) if x.dtype == np.int64 else x[own] for x in entries))))
    return _messages(rows)


def anchors(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, place) of the cover-place anchors of documents long enough for a window."""
    words = words_of(rows.column(2), lower=False)
    runs = window_hashes(words.hashes, ANCHOR)
    sizes = np.diff(words.bounds)
    row = np.repeat(np.arange(len(sizes)), sizes)[:len(runs)]
    place = np.arange(len(row)) - words.bounds[:-1][row]
    residue = np.zeros(PERIOD, bool)
    residue[list(COVER)] = True
    known = rows.column(0).is_valid().to_numpy(zero_copy_only=False)
    keep = residue[place % PERIOD] & (place + ANCHOR <= sizes[row]) & (sizes[row] >= WINDOW) & known[row]
    return runs[:len(row)][keep], row[keep], place[keep]


def _grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first elements of equal runs, run number of each element) after a stable sort by hash."""
    order = np.argsort(hashes, kind="stable")
    new = np.diff(hashes[order], prepend=hashes[order[:1]] ^ hashes.dtype.type(1)) != 0
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def anchor_messages(docs: DataFrame, parts: int) -> DataFrame:
    """Step 1, sending. docs: doc_id, text_hash, text."""
    def run(batches):
        for block, rows in _blocks(batches, "text"):
            hashes, row, place = anchors(rows)
            header = [np.asarray(pc_fill(rows.column(k))) for k in (0, 1)]
            if not len(hashes):
                continue
            order, first, group = _grouped(hashes)
            sorted_rows = row[order]
            several = np.maximum.reduceat(sorted_rows, first) != np.minimum.reduceat(sorted_rows, first)
            local = order[several[group]]  # shared inside the block: known here
            lead = np.zeros(len(order), bool)
            lead[first] = True
            sent = np.sort(order[lead | ~several[group]])
            h = hashes[sent]
            yield _send(block, parts, pack(*header, small(row[local]), small(place[local])), h,
                        h.astype("<u4"), (h >> np.uint64(32)).astype("<u1"), row[sent], place[sent])

    return docs.mapInArrow(run, MESSAGE)


def pc_fill(column: pa.Array) -> np.ndarray:
    """int64 values; a null is 0 (rows without a doc_id send nothing)."""
    return column.fill_null(0).to_numpy(zero_copy_only=False)


def anchor_answers(messages: DataFrame) -> DataFrame:
    """Step 1, answering: rows (block, data) to each block: its header, or its entries (row, place) that other blocks share."""
    def merge(table: pa.Table) -> pa.Table:
        part, blocks, blobs = (table.column(k).to_pylist() for k in range(3))
        if part[0] < 0:
            return table
        entries = [unpack(b) for b in blobs]
        sizes = [len(e[0]) for e in entries]
        hashes = np.concatenate([e[0].astype(np.uint64) | e[1].astype(np.uint64) << np.uint64(32) for e in entries])
        source = np.repeat(np.arange(len(blocks)), sizes)
        order, first, group = _grouped(hashes)
        by = source[order]
        shared = np.zeros(len(order), bool)
        shared[order] = (np.maximum.reduceat(by, first) != np.minimum.reduceat(by, first))[group]
        return _answers(part[0], blocks, sizes, shared, [(e[2], e[3]) for e in entries])

    return messages.groupBy("part").applyInArrow(merge, MESSAGE)


def _answers(part: int, blocks: list[int], sizes: list[int], marked: np.ndarray, entries) -> pa.Table:
    rows, at = [], 0
    for block, n, (row, place) in zip(blocks, sizes, entries, strict=True):
        own = marked[at:at + n]
        at += n
        if own.any():
            rows.append((part, block, pack(row[own], place[own])))
    give_back()
    return pa.Table.from_batches([_messages(rows)])


def assembled(answers: DataFrame) -> DataFrame:
    """(doc_id, text_hash, places) of the documents with marked places, from each block's header and answers."""
    def gather(table: pa.Table) -> pa.Table:
        ids = hashes = None
        rows, places = [], []
        for part, data in zip(table.column(0).to_pylist(), table.column(2).to_pylist(), strict=True):
            found = unpack(data)
            if part < 0:
                ids, hashes = found[:2]
            rows.append(found[-2].astype(np.int64))
            places.append(found[-1].astype(np.int64))
        row, place = np.concatenate(rows), np.concatenate(places)
        order = np.lexsort((place, row))
        row, place = row[order], place[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        ends = np.append(first[1:], len(row))
        own = row[first]
        blobs = [place[b:e].astype("<i8" if e > b and place[e - 1] >= 1 << 31 else "<i4") for b, e in zip(first.tolist(), ends.tolist(), strict=True)]
        return pa.table([pa.array(ids[own]), pa.array(hashes[own]), pa.array([pack(b) for b in blobs], pa.binary())], schema=PLACES_SCHEMA)

    return (answers.groupBy("block").applyInArrow(gather, "doc_id long, text_hash long, places binary")
            .dropDuplicates(["doc_id", "text_hash"]))  # repeated rows have equal places


def _covered(starts: np.ndarray, before: int, size: int, n: int) -> np.ndarray:
    """Which of n places lie in [start - before, start - before + size) of some start."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(starts - before, 0, n), 1)
    np.add.at(edge, np.clip(starts - before + size, 0, n), -1)
    return np.cumsum(edge)[:n] > 0


def window_messages(docs: DataFrame, parts: int) -> DataFrame:
    """Step 2, sending. docs: doc_id, text_hash, text, places (of shared anchors)."""
    def run(batches):
        for block, rows in _blocks(batches, "text"):
            words = words_of(rows.column(2), lower=False)
            windows = window_hashes(words.hashes, WINDOW)
            row, place, hashes = [], [], []
            for r, data in enumerate(rows.column(3).to_pylist()):
                b, n = int(words.bounds[r]), int(words.bounds[r + 1] - words.bounds[r]) - WINDOW + 1
                # a window holds an anchor if it starts up to PERIOD - 1 words before it
                starts = np.flatnonzero(_covered(unpack(data)[0].astype(np.int64), PERIOD - 1, PERIOD, n))
                place.append(starts)
                row.append(np.full(len(starts), r))
                hashes.append(windows[b + starts])
            ids, text_hashes = pc_fill(rows.column(0)), pc_fill(rows.column(1))
            row, place, hashes = np.concatenate(row), np.concatenate(place), np.concatenate(hashes)
            if not len(hashes):
                continue
            order, first, group = _grouped(hashes)
            by = ids[row[order]]
            least = by == np.minimum.reduceat(by, first)[group]
            local, sent = order[~least], np.sort(order[least])
            yield _send(block, parts, pack(ids, text_hashes, small(row[local]), small(place[local])), hashes[sent],
                        hashes[sent], ids[row[sent]].astype("<i8"), row[sent], place[sent])

    return docs.mapInArrow(run, MESSAGE)


def window_answers(messages: DataFrame) -> DataFrame:
    """Step 2, answering: the entries whose window also starts in a document of a smaller doc_id."""
    def merge(table: pa.Table) -> pa.Table:
        part, blocks, blobs = (table.column(k).to_pylist() for k in range(3))
        if part[0] < 0:
            return table
        entries = [unpack(b) for b in blobs]
        hashes, ids = (np.concatenate([e[k] for e in entries]) for k in range(2))
        order, first, group = _grouped(hashes)
        by = ids.astype(np.int64)[order]
        later = np.zeros(len(order), bool)
        later[order] = by > np.minimum.reduceat(by, first)[group]
        return _answers(part[0], blocks, [len(e[0]) for e in entries], later, [(e[2], e[3]) for e in entries])

    return messages.groupBy("part").applyInArrow(merge, MESSAGE)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, places): starts of the windows that a document with a smaller doc_id has too."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // (BYTES_PER_ANCHOR * PART_ENTRIES)
    shared = stored(assembled(anchor_answers(anchor_messages(docs, parts))), "anchors")
    return stored(assembled(window_answers(window_messages(_with_places(docs, shared), parts))), "windows")


def _with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of docs that have places; only their texts are shuffled while their keys are few enough to broadcast."""
    keys = ["doc_id", "text_hash"]
    few = bounded(places.select(*keys))
    return docs.join(few, keys, "left_semi").join(places.hint("merge"), keys).select(*keys, "text", "places")


def _finished(batches, with_places: bool):
    for batch in batches:
        for part in text_slices(batch):
            out = []
            texts = part.column(2).to_pylist()
            places = part.column(3).to_pylist() if with_places else [None] * len(texts)
            for text, data in zip(texts, places, strict=True):
                words = (text or "").encode().split()
                n = len(words)
                if data is not None:
                    gone = _covered(unpack(data)[0].astype(np.int64), 0, WINDOW, n)
                    words = [words[k] for k in np.flatnonzero(~gone).tolist()]
                out.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest(), b" ".join(words).decode() if with_places else None))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns],
                                             names=["doc_id", "text_hash", "n_words", "n_removed", "kept_sha256", "kept_text"])


_RESULT = "doc_id long, text_hash long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def shortened(docs: DataFrame) -> DataFrame:
    """The documents that lose words: doc_id, text_hash, n_words, n_removed, kept_sha256, kept_text (words joined by a space)."""
    keyed = _keyed(docs)
    return _with_places(keyed, repeated_windows(keyed)).mapInArrow(lambda b: _finished(b, True), _RESULT).dropDuplicates(["doc_id", "text_hash"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, kept_sha256.

    docs: doc_id, text; other columns are ignored. A null or empty text has no words.
    Rows of one doc_id never remove each other's words; a row without a doc_id is neither
    smaller nor larger than any, and keeps its words. An empty table gives no rows.
    Windows are compared by 64-bit hashes.
    """
    whole = _keyed(docs).mapInArrow(lambda b: _finished(b, False), _RESULT)
    less = shortened(docs).select("doc_id", "text_hash", F.col("n_removed").alias("less"), F.col("kept_sha256").alias("sha"))
    return whole.join(stored(less, "shortened"), ["doc_id", "text_hash"], "left").select(
        "doc_id", "n_words", F.coalesce("less", "n_removed").alias("n_removed"), F.coalesce("sha", "kept_sha256").alias("kept_sha256"))


#: 13-word windows over whole texts, joined to the smallest document that has each
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT rid, doc_id, s, array_to_string(list_slice(w, s + 1, s + 13), ' ') AS h
        FROM (SELECT rid, doc_id, w, unnest(range(0, len(w) - 12)) AS s FROM d WHERE len(w) >= 13)),
least_id AS (SELECT h, min(doc_id) AS least_doc FROM win GROUP BY h),
gone AS (SELECT rid, list(DISTINCT p) AS places FROM (
           SELECT rid, unnest(range(s, s + 13)) AS p FROM win JOIN least_id USING (h) WHERE least_doc < doc_id) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN places IS NULL THEN array_to_string(w, ' ')
              ELSE coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(places, i - 1)), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (rid)
"""
