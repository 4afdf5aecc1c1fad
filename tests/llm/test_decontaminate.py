import hashlib

import brute
from brute import SF
from fleetrisk.llm import decontaminate as de
from fleetrisk.llm.common import table

LONG = " ".join(f"word{k}" for k in range(20))
ITEMS = [(1, LONG), (2, "Tiny item"), (10, "tiny ITEM!"), (3, ""), (4, None), (5, "the the the the"), (6, "x" + " ".join(f"word{k}" for k in range(3, 18))), (1, LONG)]
DOCS = [(1, f"before {LONG.upper()} after"), (2, "a tiny-item here"), (3, None), (4, ""), (5, "the THE the the the the"), (6, "word1 word2 word3 " + "é" * 5),
        (7, " ".join(["filler"] * 400) + " " + LONG), (8, "..."), (9, "!tiny item"), (None, "tiny item"), (2, "a tiny-item here"), (11, LONG.replace("word10", "other"))]


def test_rows_are_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in DOCS], "doc_id long, text string, rid int, term string")
    bench = spark.createDataFrame([(i, t, 2) for i, t in ITEMS], "item_id long, text string, wid int")
    found = de.contamination(docs, bench).collect()
    expected = []
    for doc_id, text in DOCS:
        n, hit, items, bad = brute.contamination(text, ITEMS)
        expected.append((doc_id or -1, n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bad))
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found) == sorted(expected)
    kept = de.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for (i, *_, bad) in expected if not bad)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert de.contamination(docs.limit(0), bench).count() == 0
    assert {(r.n_hit, r.contaminated) for r in de.contamination(docs, bench.limit(0)).collect()} == {(0, False)}


def test_given_tables(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    items = [(r.item_id, r.text) for r in bench.limit(40).collect()]
    few = docs.limit(60)
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in de.contamination(few, bench.limit(40)).collect()}
    for r in few.collect():
        n, hit, names, _ = brute.contamination(r.text, items)
        assert found[r.doc_id] == (n, hit, len(names))


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    first = sorted(map(str, de.contamination(docs, bench).collect()))
    monkeypatch.setattr(de, "BROADCAST_ROWS", 0)
    assert sorted(map(str, de.contamination(docs, bench).collect())) == first


def test_proximity(spark):
    """Against brute force: every term of a window within slop of its place, counted from the rarest term."""
    import random

    rng = random.Random(2)
    letters = ["a", "b", "c", "d", "e", "f"]
    texts = [(i, " ".join(rng.choice(letters) for _ in range(14))) for i in range(40)] + [(90, None), (91, "")]
    items = [(i, " ".join(rng.choice(letters) for _ in range(n))) for i, n in enumerate((1, 2, 3, 4, 4, 5))]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    windows, _ = de.benchmark_windows(bench)
    index, vocabulary = de.build_index(docs, windows)
    terms = de.window_terms(index, vocabulary, windows)
    rid = {r.rid: r.doc_id for r in index.where("term = 0").collect()}
    words = {r.wid: r.words for r in windows.collect()}
    rarest = {r.wid: r.off for r in terms.where("rarity = 1").collect()}
    phrases = {(rid[r.rid], r.wid, r.start) for r in de.phrase_matches(index, terms).collect()}
    for slop in (0, 1, 3):
        got = {(rid[r.rid], r.wid, r.start) for r in de.proximity_matches(index, terms, slop).collect()}
        want = set()
        for doc_id, text in texts:
            w = (text or "").split()
            for wid, window in words.items():
                for p, word in enumerate(w):
                    start = p - rarest[wid]
                    if word == window[rarest[wid]] and all(any(x == t and abs(q - start - off) <= slop for q, x in enumerate(w)) for off, t in enumerate(window)):
                        want.add((doc_id, wid, start))
        assert got == want and (slop or got == phrases)


def test_a_very_long_text_and_clashing_names(spark):
    long = "filler words " * 400_000 + LONG
    docs = spark.createDataFrame([(1, long, 5, "x"), (2, LONG, 6, "y")], "doc_id long, text string, __bad_id int, __bad_text string")
    bench = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in de.contamination(docs, bench).collect()}
    assert found == {1: (800_020, 20, False), 2: (20, 20, True)}
    kept = de.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and [(r.doc_id, r["__bad_id"]) for r in kept.collect()] == [(1, 5)]


def test_wide_rows_are_not_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(1, "x" * 1000)], "a int, b string")
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(de.bounded(df))
    monkeypatch.setattr(de, "BROADCAST_BYTES", 500)
    assert "broadcast" not in plan(de.bounded(df))


def test_query_reports_proximity(spark):
    """Moved and inserted words leave proximity matches, counted beside the phrases; contamination is of phrases alone."""
    w = LONG.split()[:13]
    swapped, inserted, torn = w[:4] + [w[5], w[4]] + w[6:], w[:6] + ["new"] + w[6:], w[:6] + ["far"] * 9 + w[6:]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(swapped)), (3, " ".join(inserted)), (4, " ".join(torn)), (5, None), (6, ""),
                                  (3, " ".join(inserted)), (7, " ".join(inserted + ["x"] * 50_000 + inserted))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(w), 0), (2, " ".join(w), 0), (3, None, 0)], "item_id long, text string, n_near int")
    found = sorted((r.doc_id, r.n_hit, r.contaminated, r.n_near, r.n_near_items) for r in de.contamination(docs, bench, slop=de.SLOP).collect())
    assert found == [(1, 13, True, 1, 2), (2, 0, False, 1, 2), (3, 0, False, 1, 2), (3, 0, False, 1, 2), (4, 0, False, 0, 0),
                     (5, 0, False, 0, 0), (6, 0, False, 0, 0), (7, 0, False, 2, 2)]
    assert "n_near" not in de.contamination(docs, bench).columns
    assert {r.n_near for r in de.contamination(docs, bench.limit(0), slop=1).collect()} == {0}
