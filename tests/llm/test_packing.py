import json
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from fleetrisk.llm import packing

PATH = public_tokenizers.path(packing.TOKENIZER)
TEXTS = ["It's we'LL a\xa0x 12a3\x85.., the The THE the. the,", "e ́x ΑΣ Σ İ aİb é É straße",
         "a\x1cb <|endoftext|> x<|startoftext|>y", "", " \n\t", None, "ab " * 5000, "x" * 9000, "中文 字符。😀"]


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def test_binary_lengths():
    assert packing.binary_lengths(5, 8) == [4, 1]
    assert packing.binary_lengths(16, 8) == [8, 8]
    assert packing.binary_lengths(1, 2048) == [1]
    for n in range(1, 300):
        found = packing.binary_lengths(n, 16)
        assert sum(found) == n and all(x & (x - 1) == 0 for x in found) and found == sorted(found, reverse=True)


def test_pieces_rebuild_every_document(spark):
    rows = [(i, t, "extra", 1) for i, t in enumerate(TEXTS)] + [(None, "the end", "x", 2), (3, "", "again", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, sequence_id int")
    found = packing.pack(docs).collect()
    assert len({r.sequence_id for r in found}) == len(found) and {r.offset for r in found} == {0}
    for doc_id, text, *_ in rows:
        own = sorted((r for r in found if r.doc_id == doc_id), key=lambda r: (r.start, r.sequence_id))
        if doc_id == 3:
            assert [(r.start, r.length) for r in own] == [(0, 1), (0, 1)]
            continue
        ids = [i for r in own for i in np.frombuffer(r.ids, "<u4").tolist()]
        assert ids == ids_of(text) and {r.doc_tokens for r in own} == {len(ids)}
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
        assert all(r.length <= 2048 and r.length & (r.length - 1) == 0 for r in own)
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in packing.digest(packing.pack(docs)).collect()}
    assert all(crc[r.doc_id, r.start] == zlib.crc32(r.ids) for r in found)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_token_is_what_its_string_encodes_to():
    """The condition under which the two merge loops agree."""
    with open(PATH, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    merges = packing.encoder(PATH).merges._core_bpe
    special = Tokenizer.from_file(PATH).get_added_tokens_decoder()
    wrong = 0
    for token, rank in vocab.items():
        if rank not in special:
            core = token.removesuffix(packing.WORD_END) or token
            data = bytes(packing.FROM_BYTE_LEVEL[c] for c in core) + b"\0" * (core != token)
            wrong += merges.encode_single_piece(data) != [rank]
    assert wrong == 0


def test_buckets_hold_one_length(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "f g")], "doc_id long, text string")
    packing.write_buckets(packing.pack(docs), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.length, len(r.ids) // 4) for r in back.collect()} <= {(n, n) for n in (1, 2, 4, 8)}
