"""Token ids as seekable zstandard files: one frame or more per document, a seek table behind them.

A file is a series of independent zstandard frames, each with a content checksum, then
a skippable frame with the documents (id and number of tokens each), then the seek table
of the public seekable format: sizes of every frame and a checksum of its content. Any
zstandard decoder reads the file through; a reader that wants some documents reads the two
trailing frames and decompresses those documents' frames only.

A folder holds files in ascending doc_id order and a manifest, written last, that names the files of
committed tasks with their ranges of documents and the tokens before them. What a failed task
or job leaves behind is in no manifest, so it is never read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage)

from fleetrisk.llm.common import BYTE_CODES, _powers, give_back, mix64, prepare, shared_folder, ship_code, text_bytes, text_slices, tokenizer_path
from fleetrisk.llm.packing import FROM_BYTE_LEVEL, LATIN_END, MARKS
from fleetrisk.llm.warc import _filesystem

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
FILE_BYTES = 256 << 20
#: a document's ids go into frames of so many bytes at most, so a reader's memory is bounded
FRAME_BYTES = 4 << 20
LEVEL = 1
#: text bytes encoded at once, and chunks of text a worker remembers the ids of
SLICE, MEMO_CHUNKS = 2 << 20, 300_000
BATCH_BYTES = 8 << 20

#: fixed values of the zstandard seekable format
SKIPPABLE_SEEK_TABLE, SEEKABLE_MAGIC, CHECKSUM_FLAG, FOOTER = 0x184D2A5E, 0x8F92EAB1, 0x80, struct.Struct("<IBI")
#: the documents stand in a skippable frame of their own: width of an id in bytes, then entries
SKIPPABLE_DOCUMENTS, SKIPPABLE_HEAD = 0x184D2A50, struct.Struct("<II")
DOCUMENT_HEAD = struct.Struct("<4sIQ")
DOCUMENT_MAGIC = b"TKDX"
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
DOCUMENT = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("tokens", "<u8"), ("frames", "<u4")])
MANIFEST = "manifest.json"
SCHEMA = "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long"
SINK_SCHEMA = "doc_id long, ids binary"


def cut_mask(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True where a chunk of text begins: at a row's start, and at places where pre-tokens surely part.

    Such a place is a single space, or either side of a single line feed, between two
    characters that are surely no white space. Chunks are encoded on their own.
    """
    mask = np.zeros(len(raw) + 1, bool)
    visible = np.zeros(256, bool)
    visible[0x21:0x7F] = True
    two_bytes, lead = np.zeros(256, bool), visible.copy()
    two_bytes[0xC3:0xE0] = True  # two-byte characters from U+00C0 on: none is white space
    lead[0xC3:0xE0] = lead[0xE4:0xF5] = True
    before = np.zeros(len(raw), bool)
    if len(raw) > 1:
        before[1:] = visible[raw[:-1]]
        before[2:] |= two_bytes[raw[:-2]]  # the byte after such a lead ends its character
        # a lead's own second byte is no separator, so `before` at that place doesn't matter
    after = np.zeros(len(raw), bool)
    after[:-1] = lead[raw[1:]]
    full = ends > starts
    before[starts[full]] = False
    second = starts[full] + 1
    second = second[second < ends[full]]
    before[second] = visible[raw[second - 1]]
    after[ends[full] - 1] = False
    feed = (raw == 0x0A) & before & after
    mask[:-1] = ((raw == 0x20) & before & after) | feed
    mask[1:] |= feed
    mask[starts[full]] = True
    return mask[:-1]


class ChunkEncoder:
    """Token ids of texts by a byte-level BPE tokenizer; chunks that recur are looked up.

    New words of letters go in bulk through a merge loop (tiktoken) over the tokenizer file's own
    ranks, which are in the order of its merges; other chunks go through the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = self.tokenizer.get_added_tokens_decoder()
        ranks = {bytes(FROM_BYTE_LEVEL[c] for c in token): rank for token, rank in self.tokenizer.get_vocab().items() if rank not in special}
        self.merges = tiktoken.Encoding("words", pat_str=r"[^\x00]+|\x00", mergeable_ranks=ranks, special_tokens={})
        self.between = ranks[b"\0"]
        self.memo: dict[int, bytes] = {}
        self.tails: dict[bytes, bytes] = {b"": b""}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(found.ids, "<u4").tobytes() for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: list[tuple[int, bytes]]) -> None:
        words, plain = [], []
        for key, chunk in chunks:
            core = chunk.rstrip(MARKS)  # a run of marks behind letters is a pre-token of its own
            text = core.decode()
            letters = text[1:] if text[:1] == " " else text
            if letters.isalpha() and max(letters) < LATIN_END:
                words.append((key, text, chunk[len(core):]))
            else:
                plain.append((key, chunk.decode()))
        if plain:
            self.memo.update(zip((k for k, _ in plain), self.whole([t for _, t in plain]), strict=True))
        if words:
            unknown = [t for t in {t for _, _, t in words} if t not in self.tails]
            self.tails.update(zip(unknown, self.whole([t.decode() for t in unknown]), strict=True))
            ids = np.array(self.merges.encode_ordinary("\0".join(t for _, t, _ in words) + "\0"), "<u4")
            ends = np.flatnonzero(ids == self.between)
            ids, begin = ids.tobytes(), 0
            for (key, _, tail), end in zip(words, (4 * ends).tolist(), strict=True):
                self.memo[key] = ids[begin:end] + self.tails[tail]
                begin = end + 4

    def chunks(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of rows ``raw[starts[r]:ends[r]]`` that follow each other."""
        begin = np.flatnonzero(cut_mask(raw, starts, ends))
        if not len(begin):
            return np.zeros(0, "<u4"), np.zeros(len(starts) + 1, np.int64)
        size = np.diff(np.append(begin, len(raw)))
        values = BYTE_CODES[raw] * _powers(int(size.max()))[np.arange(len(raw)) - np.repeat(begin, size)]
        distinct, at, back = np.unique(mix64(np.add.reduceat(values, begin)), return_index=True, return_inverse=True)
        del values
        if len(self.memo) > MEMO_CHUNKS:
            self.memo.clear()
            self.tails = {b"": b""}
        memo, keys, data = self.memo, distinct.tolist(), raw.tobytes()
        self.learn([(k, data[b:b + n]) for k, b, n in zip(keys, begin[at].tolist(), size[at].tolist(), strict=True) if k not in memo])
        found = [memo[k] for k in keys]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        sizes = sizes[back]
        last = np.cumsum(sizes)
        ids = flat[np.repeat(first[back] - (last - sizes), sizes) + np.arange(last[-1])]
        return ids, np.append(0, last)[np.searchsorted(begin, np.append(starts, len(raw)))]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): row r has ``ids[bounds[r]:bounds[r + 1]]``. A very long text is encoded in parts."""
        raw, starts, ends = text_bytes(column)
        if len(column) != 1 or len(raw) <= 2 * SLICE:
            return self.chunks(raw, starts, ends)
        parts, at = [], 0
        while at < len(raw):
            reach = SLICE
            while True:
                window = raw[at:at + reach]
                cuts = np.flatnonzero(cut_mask(window, np.array([0]), np.array([len(window)])))
                stop = len(window) if at + reach >= len(raw) else int(cuts[-1])
                if stop:
                    break
                reach *= 2
            parts.append(self.chunks(window[:stop], np.array([0]), np.array([stop]))[0])
            at += stop
        ids = np.concatenate(parts)
        return ids, np.array([0, len(ids)])


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    found = ChunkEncoder(path)
    give_back()
    return found


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids): little-endian uint32 ids of each text, the end id behind them."""
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                ids, bounds = encode(part.column(1))
                data, bounds = ids.tobytes(), (4 * bounds).tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([data[a:b] + tail for a, b in zip(bounds, bounds[1:])], pa.binary())],
                                                 names=["doc_id", "ids"])

    return docs.mapInArrow(run, SINK_SCHEMA)


def checksum(content) -> int:
    """The seek table's checksum: the low 32 bits of XXH64."""
    import xxhash

    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class TokenFile:
    """Writes one file to a binary stream. Ids are held in two bytes each where all ids of the tokenizer fit."""

    def __init__(self, out, width: int, level: int = LEVEL, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.out, self.width, self.frame_bytes = out, width, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.entries, self.documents, self.size, self.tokens = [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and self.width == 2 and int(ids.max()) > 0xFFFF:
            raise ValueError("an id does not fit the width of the file")
        content = memoryview(ids.astype(f"<u{self.width}").tobytes())
        frames = 0
        for at in range(0, max(len(content), 1), self.frame_bytes):
            part = content[at:at + self.frame_bytes]
            packed = self.packer.compress(part)
            self.size += self.out.write(packed)
            self.entries.append((len(packed), len(part), checksum(part)))
            frames += 1
        self.documents.append((doc_id is not None, doc_id or 0, len(ids), frames))
        self.tokens += len(ids)

    def close(self) -> dict:
        """Write the two trailing frames; what the manifest says of the file."""
        body = DOCUMENT_HEAD.pack(DOCUMENT_MAGIC, self.width, len(self.documents)) + np.array(self.documents, DOCUMENT).tobytes()
        body += struct.pack("<I", zlib.crc32(body))
        table = np.array(self.entries, ENTRY).tobytes() + FOOTER.pack(len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        for magic, content in ((SKIPPABLE_DOCUMENTS, body), (SKIPPABLE_SEEK_TABLE, table)):
            self.size += self.out.write(SKIPPABLE_HEAD.pack(magic, len(content)) + content)
        self.out.close()
        ids = [d[1] for d in self.documents if d[0]]
        return {"documents": len(self.documents), "tokens": self.tokens, "bytes": self.size, "documents_bytes": len(body) + SKIPPABLE_HEAD.size,
                "least": min(ids, default=None), "most": max(ids, default=None), "nulls": len(self.documents) - len(ids)}


class CorruptTokenFile(ValueError):
    """A checksum, a magic number or a size is not what it should be."""


def read_index(source, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(frames, documents, width of an id) from the two trailing frames; source: a seekable binary file."""
    source.seek(size - FOOTER.size)
    frames, flag, magic = FOOTER.unpack(source.read(FOOTER.size))
    if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
        raise CorruptTokenFile("no seek table with checksums at the end of the file")
    at = size - FOOTER.size - frames * ENTRY.itemsize - SKIPPABLE_HEAD.size
    source.seek(at)
    if at < 0 or SKIPPABLE_HEAD.unpack(source.read(SKIPPABLE_HEAD.size)) != (SKIPPABLE_SEEK_TABLE, size - at - SKIPPABLE_HEAD.size):
        raise CorruptTokenFile("seek table of another size")
    entries = np.frombuffer(source.read(frames * ENTRY.itemsize), ENTRY)
    begin = int(entries["packed"].sum(dtype=np.int64))
    source.seek(begin)
    body = source.read(at - begin)[SKIPPABLE_HEAD.size:]
    if len(body) < DOCUMENT_HEAD.size + 4 or struct.pack("<I", zlib.crc32(body[:-4])) != body[-4:]:
        raise CorruptTokenFile("index of documents is damaged")
    mark, width, count = DOCUMENT_HEAD.unpack(body[:DOCUMENT_HEAD.size])
    documents = np.frombuffer(body[DOCUMENT_HEAD.size:-4], DOCUMENT)
    if mark != DOCUMENT_MAGIC or len(documents) != count or int(documents["frames"].sum()) != frames:
        raise CorruptTokenFile("index of documents and seek table differ")
    return entries, documents, width


def read_documents(source, size: int, wanted=None, read=None):
    """(document number, doc_id or None, tokens before it in the file, ids) of the wanted documents.

    wanted: a function of (known, doc_id arrays) giving a mask; None is all. Only frames of
    wanted documents are read and decompressed; each is checked against its checksum.
    read: a list that takes the numbers of the frames read, for tests.
    """
    import zstandard

    entries, documents, width = read_index(source, size)
    unpacker = zstandard.ZstdDecompressor()
    place = np.append(0, np.cumsum(entries["packed"], dtype=np.int64))
    first = np.append(0, np.cumsum(documents["frames"], dtype=np.int64))
    before = np.append(0, np.cumsum(documents["tokens"], dtype=np.int64))
    mask = np.ones(len(documents), bool) if wanted is None else wanted(documents["known"].astype(bool), documents["doc_id"])
    for d in np.flatnonzero(mask).tolist():
        low, high, parts = int(first[d]), int(first[d + 1]), []
        source.seek(int(place[low]))
        for k in range(low, high):
            entry = entries[k]
            try:
                part = unpacker.decompress(source.read(int(entry["packed"])), max_output_size=int(entry["size"]))
            except zstandard.ZstdError as error:
                raise CorruptTokenFile(f"frame {k}: {error}") from error
            if len(part) != entry["size"] or checksum(part) != entry["checksum"]:
                raise CorruptTokenFile(f"frame {k}: another size or checksum")
            parts.append(part)
            if read is not None:
                read.append(k)
        ids = np.frombuffer(b"".join(parts), f"<u{width}").astype("<u4")
        if len(ids) != documents["tokens"][d]:
            raise CorruptTokenFile(f"document {d}: another number of ids")
        yield d, int(documents["doc_id"][d]) if documents["known"][d] else None, int(before[d]), ids


@dataclass
class Files(WriterCommitMessage):
    partition: int
    files: list[dict]


@dataclass
class FilePartition(InputPartition):
    name: str
    size: int
    before: int


class TokenFileWriter(DataSourceArrowWriter):
    """Rows (doc_id, ids) in order, partitions in order; the manifest comes last and makes them one dataset."""

    def __init__(self, options):
        self.path, self.limit = options["path"], int(options.get("fileBytes", FILE_BYTES))
        self.width, self.level, self.frame = int(options.get("width", 4)), int(options.get("level", LEVEL)), int(options.get("frameBytes", FRAME_BYTES))

    def write(self, iterator):
        filesystem, root = _filesystem(self.path)
        filesystem.create_dir(root, recursive=True)
        found, file, name = [], None, None
        for batch in iterator:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if file is not None and file.size >= self.limit:
                    found.append({"name": name, **file.close()})
                    file = None
                if file is None:
                    name = f"{uuid.uuid4().hex}.zst"
                    file = TokenFile(filesystem.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20), self.width, self.level, self.frame)
                file.add(doc_id, np.frombuffer(ids.as_buffer(), "<u4") if ids.is_valid else np.zeros(0, "<u4"))
        if file is not None:
            found.append({"name": name, **file.close()})
        return Files(TaskContext.get().partitionId(), found)

    def commit(self, messages):
        filesystem, root = _filesystem(self.path)
        filesystem.create_dir(root, recursive=True)
        files, before = [], 0
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            for file in message.files:
                files.append(file | {"before": before})
                before += file["tokens"]
        with filesystem.open_output_stream(f"{root}/_{MANIFEST}") as out:
            out.write(json.dumps({"width": self.width, "tokens": before, "files": files}).encode())
        filesystem.move(f"{root}/_{MANIFEST}", f"{root}/{MANIFEST}")

    def abort(self, messages):
        filesystem, root = _filesystem(self.path)
        for message in messages:
            for file in message.files if message is not None else []:
                filesystem.delete_file(f"{root}/{file['name']}")


class TokenFileReader(DataSourceReader):
    """Options: path; ids = full, or crc for ids_crc32 alone. Comparisons of doc_id are pushed down to files and frames."""

    def __init__(self, schema, options):
        self.path, self.ids = options["path"], options.get("ids", "full")
        self.tests: list[tuple] = []

    def pushFilters(self, filters):
        kinds = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
        for f in filters:
            if isinstance(f, kinds) and f.attribute == ("doc_id",):
                self.tests.append((type(f).__name__, np.array(sorted(f.value)) if isinstance(f, In) else f.value))
            else:
                yield f

    def wanted(self, known: np.ndarray, ids: np.ndarray) -> np.ndarray:
        for kind, value in self.tests:
            known = known & {"EqualTo": lambda: ids == value, "In": lambda: np.isin(ids, value), "GreaterThan": lambda: ids > value,
                             "GreaterThanOrEqual": lambda: ids >= value, "LessThan": lambda: ids < value, "LessThanOrEqual": lambda: ids <= value}[kind]()
        return known

    def may_hold(self, file: dict) -> bool:
        """Whether a file's range of doc_ids can meet the tests."""
        low, high = file["least"], file["most"]
        if low is None:
            return not self.tests
        meets = {"EqualTo": lambda v: low <= v <= high, "In": lambda v: bool(((v >= low) & (v <= high)).any()), "GreaterThan": lambda v: high > v,
                 "GreaterThanOrEqual": lambda v: high >= v, "LessThan": lambda v: low < v, "LessThanOrEqual": lambda v: low <= v}
        return all(meets[kind](value) for kind, value in self.tests)

    def partitions(self):
        filesystem, root = _filesystem(self.path)
        with filesystem.open_input_file(f"{root}/{MANIFEST}") as source:
            files = json.loads(source.read())["files"]
        return [FilePartition(f["name"], f["bytes"], f["before"]) for f in files if self.may_hold(f)] or [FilePartition("", 0, 0)]

    def read(self, partition):
        if not partition.name:
            return
        filesystem, root = _filesystem(self.path)
        types = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary(), "ids_crc32": pa.int64()}
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], names=list(types))

        with filesystem.open_input_file(f"{root}/{partition.name}") as source:
            for _, doc_id, before, ids in read_documents(source, partition.size, self.wanted if self.tests else None):
                data = ids.tobytes()
                rows.append((doc_id, partition.before + before, len(ids), data if self.ids == "full" else None, zlib.crc32(data)))
                size += 100 + len(rows[-1][3] or b"")
                if size > BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class TokenFileSource(DataSource):
    """``spark.read.format("tokenfiles")`` and ``df.write.format("tokenfiles")``; option path names a folder that all machines share."""

    @classmethod
    def name(cls):
        return "tokenfiles"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TokenFileReader(schema, self.options)

    def writer(self, schema, overwrite):
        return TokenFileWriter(self.options)


def register(spark: SparkSession) -> None:
    ship_code(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenFileSource)


def write_tokens(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID,
                 file_bytes: int = FILE_BYTES, frame_bytes: int = FRAME_BYTES) -> str:
    """Encode the documents and write their ids in ascending doc_id order; returns the folder (a new shared one by default).

    docs: columns doc_id and text; others are ignored. A null or empty text is the end id
    alone. Null doc_ids come first; rows of one doc_id stand in the order they are read in, and
    may lie in several files, as ranges part on the place of a row too. Very long texts
    are encoded in parts and cut into frames. An empty table gives a folder without files.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    prepare(spark)
    register(spark)
    path, tokenizer = path or shared_folder(spark, "tokens"), tokenizer or tokenizer_path(TOKENIZER)
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id) <= 0xFFFF else 4
    order = [F.col("doc_id").asc_nulls_first(), "place"]
    rows = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("place", F.monotonically_increasing_id())
            .repartitionByRange(*order).sortWithinPartitions(*order))
    (encoded(rows.select("doc_id", "text"), tokenizer, end_id).write.format("tokenfiles").option("path", path).option("width", width)
     .option("fileBytes", file_bytes).option("frameBytes", frame_bytes).mode("append").save())
    return path


def read_tokens(spark: SparkSession, path: str, ids: str = "full") -> DataFrame:
    """Columns of SCHEMA: start counts the ids of all documents before; with ids = crc, ids is null."""
    register(spark)
    return spark.read.format("tokenfiles").option("path", path).option("ids", ids).load()


def round_trip(docs: DataFrame) -> DataFrame:
    """Write the documents' ids and read the files back: the contract's rows."""
    return read_tokens(docs.sparkSession, write_tokens(docs), "crc").drop("ids")
