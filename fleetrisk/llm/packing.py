"""Sequence packing by power-of-two decomposition.

Each document's token ids are cut into pieces whose lengths are powers of two
(full-length pieces first, then the binary digits of the rest, largest first).
Every piece is a sequence of its own, in the bucket of its length: batches are
drawn from one bucket, so no sequence crosses documents and none is padded.
No shuffle is needed: a piece depends on its own document only.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetrisk.llm.common import give_back, text_slices, tokenizer_path, words_of

MAX_LENGTH = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: words a worker remembers the ids of; the memo starts anew beyond that, which changes no result
MEMO_WORDS = 150_000

#: below it, letters are unchanged by NFC
LATIN_END = "\u0180"
WORD_END = "</w>"
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: how byte-level BPE writes bytes as characters: printable Latin-1 as itself, the rest from U+0100 on
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
FROM_BYTE_LEVEL = {chr(b): b for b in _PRINTABLE} | {
    chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}

#: text bytes encoded at once
SLICE = 1 << 20
SCHEMA = ("doc_id long, start long, length long, doc_tokens long, ids binary")


def binary_lengths(n: int, max_length: int) -> list[int]:
    """Piece lengths of a document of ``n`` ids: full pieces, then the binary digits of the rest."""
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << k for k in range(max_length.bit_length(), -1, -1) if rest >> k & 1]


class WordEncoder:
    """Token ids of a slice of texts, for a tokenizer that encodes white-space separated words independently.

    The tokenizer file lower-cases, drops white space and marks word ends, so a text's ids
    are its words' ids in order, and only a slice's distinct words that the worker does not
    remember are encoded. Words of letters, with marks behind or not, go in bulk through
    a merge loop (tiktoken) over the file's own ranks, with U+0000 as the word end.
    That gives the tokenizer's ids because each token of the file is what its own
    string encodes to (``tests/llm/test_packing.py`` checks it). Other words go through the tokenizer.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        special = self.tokenizer.get_added_tokens_decoder()
        ranks, self.ends = {}, np.zeros(max(vocab.values()) + 1, bool)
        for token, rank in vocab.items():
            if rank not in special:
                core = token.removesuffix(WORD_END) or token
                self.ends[rank] = core != token
                ranks[bytes(FROM_BYTE_LEVEL[c] for c in core) + b"\0" * (core != token)] = rank
        self.merges = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[int, bytes] = {}
        self.marks: dict[bytes, bytes] = {b"": b""}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: list[tuple[int, bytes]]) -> None:
        cores, keys, tails = [], [], []
        for key, word in words:
            core = word.rstrip(MARKS)  # a run of marks is a pre-token of its own
            text = core.decode().lower()
            if text.isalpha() and max(text) < LATIN_END:
                tail = word[len(core):]
                if tail not in self.marks:
                    self.marks[tail] = self.whole(tail.decode())
                cores.append(text)
                keys.append(key)
                tails.append(self.marks[tail])
            else:
                self.memo[key] = self.whole(word.decode())
        if cores:
            ids = np.array(self.merges.encode_ordinary("\0".join(cores) + "\0"), dtype="<u4")
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            ids, begin = ids.tobytes(), 0
            for key, end, tail in zip(keys, ends, tails, strict=True):
                self.memo[key] = ids[begin:end] + tail
                begin = end

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): row r has ``ids[bounds[r]:bounds[r + 1]]``."""
        words = words_of(col, lower=True)
        if not len(words.hashes):
            return np.zeros(0, "<u4"), np.zeros(len(col) + 1, np.int64)
        distinct, at, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
            self.marks = {b"": b""}
        memo, raw, keys = self.memo, words.raw.tobytes(), distinct.tolist()
        self.learn([(k, raw[b:e]) for k, b, e in zip(keys, words.begin[at].tolist(), words.end[at].tolist(), strict=True)
                    if k not in memo])
        found = [memo[k] for k in keys]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        sizes = sizes[back]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(starts[back] - (ends - sizes), sizes) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[words.bounds]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    found = WordEncoder(path)
    give_back()  # what reading the file took
    return found


def pieces(docs: DataFrame, tokenizer: str | None = None, max_length: int = MAX_LENGTH,
           end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens and ids (little-endian uint32 bytes).

    docs: columns doc_id and text; others are ignored. A null or empty text is the
    end id alone, one piece. Repeated rows and null ids are packed like any other row.
    An empty table gives no rows.
    """
    if max_length & (max_length - 1) or max_length < 1:
        raise ValueError("max_length must be a power of two")
    path = tokenizer or tokenizer_path(TOKENIZER)
    tail = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                        ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                ids, bounds = encode(part.column(1))
                bounds, rows = bounds.tolist(), []
                for r, doc_id in enumerate(part.column(0).to_pylist()):
                    own = ids[bounds[r]:bounds[r + 1]].tobytes() + tail
                    n, at = len(own) // 4, 0
                    for length in binary_lengths(n, max_length):
                        rows.append((doc_id, at, length, n, own[4 * at:4 * (at + length)]))
                        at += length
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def pack(docs: DataFrame, tokenizer: str | None = None, max_length: int = MAX_LENGTH,
         end_id: int = END_ID) -> DataFrame:
    """Pieces with their place: each is one sequence of its bucket (``length``), at offset 0.

    sequence_id is unique over the whole result: partition number and place in it, so
    it needs no global count. See ``pieces`` for nulls and empty input.
    """
    return (pieces(docs, tokenizer, max_length, end_id)
            .withColumn("sequence_id", F.monotonically_increasing_id())
            .withColumn("offset", F.lit(0).cast("long")))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write sequences as Parquet, one folder per length, for readers that batch equal lengths."""
    packed.write.mode("overwrite").partitionBy("length").parquet(path)


def digest(packed: DataFrame) -> DataFrame:
    """The contract's columns: ids as their CRC-32."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")
