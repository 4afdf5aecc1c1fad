import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa
from tokenizers import Tokenizer

from fleetrisk.llm import token_counts as tc

PATH = public_tokenizers.path(tc.TOKENIZER)
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = ["it's we'LL 'round 're're 'vex ''s 's's \n's  's   'll!'s x's 'r 'v1 'l' ' 'lé",
         "<|endoftext|>a<|endoftext|><|endoftext|> b<|endoft", "   \n\n  \t x  　　y   z　", "中文字符测试，数字123 ½²", "", None, " ",
         "     " * 40 + "x" + " " * 70 + "\n" * 9, "é́ё ñ 😀😀 👨‍👩‍👧", "'", "a'", "\x00\x01 \x1c\x1d x\x85y", "x" * 3000, "word " * 4000]


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_counts_are_the_librarys(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "again", 1), (0, TEXTS[0], 7)],
                                 "doc_id long, text string, n_tokens int")
    found = tc.token_counts(docs).collect()
    assert len(found) == len(TEXTS) + 2
    for r in found:
        text = "again" if r.doc_id is None else TEXTS[r.doc_id]
        assert (r.n_bytes, r.n_tokens) == (len((text or "").encode()), library(text))
        assert r.over_limit == (r.n_tokens > 512)


def test_empty_table(spark):
    assert tc.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("abe'slrv t1!\n\té ½中'  ")), st.characters(codec="utf-8"))), max_size=4))
def test_any_text(texts):
    found = tc.transducer(PATH).count(pa.array(texts, pa.string()))
    assert found.tolist() == [library(t) for t in texts]


def test_compiling_anew_changes_nothing():
    machine = tc.Transducer(tc.MergeRules(PATH), table_bytes=1 << 16)
    words = pa.array([" ".join(f"{a}{b}tion{c}" for a in "abcdef" for b in "xyz" for c in "klmn"), "another text of plain words"])
    first = machine.count(words).tolist()
    assert first == [library(t) for t in words.to_pylist()] == machine.count(words).tolist()


def test_chunk_maps_compose():
    """Counts don't depend on where a text is cut into chunks."""
    text = pa.array(["the quick brown fox's den, 1234 steps away; it'll jump   over\n\n it " * 50])
    machine, found = tc.transducer(PATH), set()
    before = tc.CHUNK
    try:
        for size in (8, 64, 100_000):
            tc.CHUNK = size
            found.add(int(machine.count(text)[0]))
    finally:
        tc.CHUNK = before
    assert found == {library(text[0].as_py())}


def long_texts():
    import random

    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    return ["x" * 5001, "ab" * 4000, some(letters, 20_000), some("aaaab", 9_000), " " * 7003, some(" \t", 5_000) + "z", "\n" * 4_100 + " x", some("'!-.", 6_000),
            "'" * 3_333, some("0123456789", 5_000), some("中文字符测试é", 4_000), "a" + some("éü", 3_000) + " b " + some(letters, 4_000) + "'s", "the" * 3_000,
            "<|endoftext|>" + some(letters, 3_000) + "<|endoftext|>", "internationalization" * 500, ""]


def test_long_runs_without_a_break():
    """Words, blanks and signs of thousands of characters are cut and composed to the library's counts."""
    texts = long_texts()
    machine = tc.Transducer(tc.MergeRules(PATH))
    assert machine.count(pa.array(texts)).tolist() == [library(t) for t in texts]
    assert machine.count(pa.array(["".join(texts), None])).tolist() == [library("".join(texts)), 0]


def test_long_runs_read_on_and_compiled_anew(monkeypatch):
    """Without rounds left the rest is read in order; a table that fills up within a run changes nothing."""
    texts = long_texts()
    for rounds, warm, size, table_bytes in ((0, 1, 16, tc.TABLE_BYTES), (1, 4, 16, 1 << 16), (8, 32, 64, 1 << 16)):
        monkeypatch.setattr(tc, "ROUNDS", rounds)
        monkeypatch.setattr(tc, "WARM", warm)
        monkeypatch.setattr(tc, "CHUNK", size)
        machine = tc.Transducer(tc.MergeRules(PATH), table_bytes=table_bytes)
        assert machine.count(pa.array(texts)).tolist() == [library(t) for t in texts]


def test_a_long_word_costs_little_more_than_prose():
    """Once compiled, 200,000 letters without a break take a few times as long as prose of that length, not 200 times."""
    import random
    import time

    rng = random.Random(1)
    word, prose = "".join(rng.choice("etaoinshrdlu") for _ in range(200_000)), "some plain words of prose " * 7_700
    machine, best = tc.Transducer(tc.MergeRules(PATH)), {}
    for text in (word, prose):
        col = pa.array([text])
        assert machine.count(col)[0] == library(text)
        spent = []
        for _ in range(3):
            at = time.perf_counter()
            machine.count(col)
            spent.append(time.perf_counter() - at)
        best[text[:4]] = min(spent)
    assert best[word[:4]] < 10 * best["some"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "ab", "'", " ", "!", "é", "中", "1", "'s", "ing"]), st.integers(1, 400)), max_size=5))
def test_any_repeats(parts):
    text = "".join(p * n for p, n in parts)
    before = tc.CHUNK
    try:
        tc.CHUNK = 8
        assert tc.transducer(PATH).count(pa.array([text])).tolist() == [library(text)]
    finally:
        tc.CHUNK = before
