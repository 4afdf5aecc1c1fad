import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brute import SF
from fleetrisk.llm import token_files as tf
from fleetrisk.llm.common import table


@pytest.fixture(scope="module")
def encode():
    return tf.encoder(tf.tokenizer_path(tf.TOKENIZER))


def library(encode, text):
    return encode.tokenizer.encode(text or "", add_special_tokens=False).ids


PIECES = st.sampled_from([" ", "  ", "\n", "\n\n", "\t", " ", " ", "　", "\u0085", " ", "\x1c", "don't", " 's", "it's", "'", "''s", "Été", "straße",
                          "日本", "word", "Word,", "...", "!?", "12", "3.5", "<|endoftext|>", "<|", "é", "é", "ª", "🙂", "​", "Привет", "\0", "\r\n", "x" * 40])


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(st.lists(PIECES, max_size=12).map("".join), st.text(max_size=30)), max_size=6))
def test_ids_are_the_librarys(encode, texts):
    ids, bounds = encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library(encode, t) for t in texts]


def test_words_are_merged_as_the_library_does(encode):
    """The merge loop takes ranks where the library takes its list of merges: the same order, for each token's own string."""
    tokens = [t for t in encode.tokenizer.get_vocab() if t.lstrip("Ġ").isalpha()]
    texts = [bytes(tf.FROM_BYTE_LEVEL[c] for c in t).decode(errors="ignore") for t in tokens]
    texts = [t for t in dict.fromkeys(texts) if t.strip()]
    ids, bounds = encode(pa.array(texts, pa.string()))
    found = encode.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [f.ids for f in found]


def test_very_long_texts_are_encoded_in_parts(encode):
    text = "The long text goes on, and on.\n" * 200_000
    ids, _ = encode(pa.array([text]))
    assert ids.tolist() == library(encode, text)
    text = "a" * 30_000 + "b c" * 1000
    assert encode(pa.array([text]))[0].tolist() == library(encode, text)


def written(documents, width=2, frame_bytes=16):
    out = io.BytesIO()
    out.close, end = lambda: None, tf.TokenFile(out, width, frame_bytes=frame_bytes)
    for doc_id, ids in documents:
        end.add(doc_id, np.array(ids, "<u4"))
    return out, end.close()


def test_file_format():
    documents = [(None, [5]), (3, list(range(40))), (7, []), (7, [65535])]
    out, info = written(documents)
    data = out.getvalue()
    assert info == {"documents": 4, "tokens": 42, "bytes": len(data), "documents_bytes": info["documents_bytes"], "least": 3, "most": 7, "nulls": 1}
    # any decoder reads it through: skippable frames hold nothing
    plain = b"".join(np.array(ids, "<u2").tobytes() for _, ids in documents)
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == plain
    assert data[-4:] == (0x8F92EAB1).to_bytes(4, "little") and int.from_bytes(data[-9:-5], "little") == 1 + 5 + 1 + 1
    frames = []
    found = list(tf.read_documents(io.BytesIO(data), len(data), lambda known, ids: known & (ids == 7), frames))
    assert [(d, i, at, ids.tolist()) for d, i, at, ids in found] == [(2, 7, 41, []), (3, 7, 41, [65535])] and frames == [6, 7]
    with pytest.raises(ValueError):
        written([(1, [65536])])


def test_damage_is_found():
    out, _ = written([(1, list(range(30))), (2, [9, 9, 9])])
    data = out.getvalue()
    whole = [ids.tolist() for _, _, _, ids in tf.read_documents(io.BytesIO(data), len(data))]
    assert whole == [list(range(30)), [9, 9, 9]]
    for place in range(len(data)):
        bad = bytearray(data)
        bad[place] ^= 0x10
        try:
            found = [ids.tolist() for _, _, _, ids in tf.read_documents(io.BytesIO(bytes(bad)), len(bad))]
        except (tf.CorruptTokenFile, OverflowError, MemoryError, ValueError):
            continue
        assert found == whole, place  # a flag of no meaning
    with pytest.raises(tf.CorruptTokenFile):
        tf.read_index(io.BytesIO(data[:-1]), len(data) - 1)


def expected(encode, rows):
    found, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*library(encode, text), tf.END_ID], "<u4")
        found.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return found


def test_round_trip_of_the_given_table(spark, encode):
    docs = table(spark, SF, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    found = tf.round_trip(docs.repartition(5))
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found.orderBy("doc_id").collect()] == expected(encode, rows)


def test_files_frames_and_filters(spark, encode, monkeypatch, tmp_path):
    rows = [(i, f"text {i} " * (i % 7)) for i in range(200)] + [(None, "none"), (5, "again"), (5, "again"), (300, None), (301, "long " * 50_000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start long, place long")
    path = tf.write_tokens(docs, file_bytes=500, frame_bytes=1000)
    read = tf.read_tokens(spark, path)
    assert read.count() == len(rows)
    by_start = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read.orderBy("start").collect()]
    assert [d for d, *_ in by_start] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    ends = [s + n for _, s, n, _ in by_start]
    assert [s for _, s, _, _ in by_start] == [0, *ends[:-1]]
    one = read.where(F.col("doc_id").isin(5, 301)).collect()
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in one) == sorted([*library(encode, t), 0] for i, t in rows if i in (5, 301))
    assert read.where("doc_id > 299").count() == 2 and read.where("doc_id <= 2 and doc_id >= 1").count() == 2 and read.where("doc_id is null").count() == 1


def test_only_wanted_files_are_planned(spark):
    from pyspark.sql.datasource import EqualTo, LessThan

    docs = spark.range(300).selectExpr("id as doc_id", "repeat('word ', 20) as text")
    path = tf.write_tokens(docs, file_bytes=300)
    reader = tf.TokenFileReader(None, {"path": path})
    every = len(reader.partitions())
    assert list(reader.pushFilters([EqualTo(("doc_id",), 17), EqualTo(("start",), 0), LessThan(("doc_id",), 100)])) == [EqualTo(("start",), 0)]
    assert every > 5 and len(reader.partitions()) == 1


def test_uncommitted_files_are_not_read(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    path = tf.write_tokens(docs)
    filesystem, root = tf._filesystem(path)
    with filesystem.open_output_stream(f"{root}/left-behind.zst", compression=None) as out:
        out.write(b"half a file")
    assert tf.read_tokens(spark, path).count() == 2


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tf.round_trip(empty).count() == 0
