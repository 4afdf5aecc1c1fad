import random

import brute
from brute import SF
from fleetrisk.llm import substrings
from fleetrisk.llm.common import table


def rows(seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    passage = [rng.choice(words) for _ in range(60)]
    found = []
    for _ in range(60):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            size = rng.choice((12, 13, 14, 20, 40))
            b = rng.randrange(60 - size)
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage[b:b + size]
        found.append(" ".join(text))
    found += [found[5], found[6], None, "", "a " * 40, "a " * 13, "a " * 12, found[7].replace(" ", " \n\x0b"), "Éa b " * 20]
    ids = rng.sample(range(1000), len(found))
    return list(zip(ids, found)) + [(ids[5], found[5]), (None, found[6]), (ids[6], found[9])]


def test_words_kept_are_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, 0, b"x") for i, t in data], "doc_id long, text string, n_words int, places binary")
    expected = sorted((i or -1, *r) for (i, _), r in zip(data, brute.kept_words(data), strict=True))
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.deduplicated(docs).collect()) == expected


def test_blocks_and_parts_change_nothing(spark, monkeypatch):
    data = rows(6)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(substrings, "PART_ENTRIES", 20)
    expected = sorted((i or -1, *r) for (i, _), r in zip(data, brute.kept_words(data), strict=True))
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.deduplicated(docs).collect()) == expected


def test_given_table_and_texts(spark):
    docs = table(spark, SF, "documents")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    expected = {i: r for (i, _), r in zip(data, brute.kept_words(data), strict=True)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.deduplicated(docs).collect()} == expected
    assert {r.doc_id for r in substrings.shortened(docs).collect()} == {i for i, r in expected.items() if r[1]}


def test_empty_table(spark):
    assert substrings.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_cover_reaches_every_pair_of_residues():
    p, cover = substrings.PERIOD, set(substrings.COVER)
    assert all(any((i + d) % p in cover and (j + d) % p in cover for d in range(p)) for i in range(p) for j in range(p))
