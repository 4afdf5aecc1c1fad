import hashlib

from brute import SF
from pyspark.sql import functions as F

from fleetrisk.llm import spotsigs
from fleetrisk.llm.common import table


def check(rows, found):
    order = sorted(rows, key=lambda r: r[0])
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    for k, (doc_id, text) in enumerate(order):
        text, follows = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 4
        edited = text[:len(text) - n] + follows[:n]
        r = by_id[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.near_next == 1 if text == follows else True
        assert (r.fingerprint == r.edited_fingerprint and r.near_edited == 1) if text == edited else True


def test_given_table(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = spotsigs.fingerprints(docs).collect()
    check(rows, found)
    prints = {}
    for r in found:
        prints.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    near = sorted(r.near_edited for r in found)
    assert near[len(near) // 4] > 0.45 and sum(r.near_next for r in found) < 0.05 * len(found)


def test_odd_texts_and_small_ranges(spark):
    rows = [(2, None), (10, ""), (-4, "the quick brown fox of the den"), (7, "😀é the end of it all"), (8, "😀é the end of it all"), (30, "word"), (31, "x" * 5000)]
    docs = spark.createDataFrame([(i, t, 5, "y") for i, t in rows], "doc_id long, text string, key int, at string")
    check(rows, spotsigs.fingerprints(docs).collect())
    pairs = spotsigs.edited_pairs(docs, rows_per_range=2)
    assert {(r.doc_id, r.edited_sha256) for r in pairs.collect()} == {(r.doc_id, r.edited_sha256) for r in spotsigs.fingerprints(docs).collect()}


def test_ranges_are_counted_as_by_bisection(spark):
    from bisect import bisect_right

    keys = [*range(-3, 400), spotsigs._FIRST, 1 << 40]
    for n in (1, 2, 3, 17, 300):
        cuts = sorted([spotsigs._FIRST] + [k * 5 // 4 for k in range(n - 1)])
        rows = spark.createDataFrame([(k,) for k in keys], "key long").select("key", spotsigs._range_of(F.col("key"), cuts).alias("own")).collect()
        assert {r.key: r.own for r in rows} == {k: bisect_right(cuts, k) for k in keys}


def test_every_row_its_own_range(spark):
    rows = [(3 * i, f"the text number {i} of the many " * (i % 4)) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check(rows, [r for r in spotsigs.edited_pairs(docs, rows_per_range=1).select(
        "doc_id", "n_chars", "edited_sha256", spotsigs.written(F.col("own")).alias("fingerprint"), spotsigs.written(F.col("changed")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("own"), F.col("changed")).alias("near_edited"), spotsigs.likeness(F.col("own"), F.col("next")).alias("near_next")).collect()])


def test_a_very_long_text(spark):
    rows = [(1, "the fox of the den is in a wood and " * 30_000), (2, "word " * 100_000), (3, "x" * 1_000_000)]
    check(rows, spotsigs.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_ties_nulls_one_row_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "c d"), (1, "c d"), (None, "e f")], "doc_id long, text string")
    assert spotsigs.fingerprints(docs).count() == 4
    one = spotsigs.fingerprints(docs.where("doc_id = 1").limit(1)).collect()
    assert [(r.near_next, r.near_edited) for r in one] == [(1.0, 1.0)]
    assert spotsigs.fingerprints(docs.limit(0)).count() == 0


def test_chains_pass_over_common_words(spark):
    docs = spark.createDataFrame([(1, "The fox of the red den is big. The fox red den big, the fox of red den!")], "doc_id long, text string")
    own = spotsigs.with_signatures(docs, "text", "own").first().own
    again = spotsigs.with_signatures(docs.withColumn("text", __import__("pyspark").sql.functions.upper("text")), "text", "own").first().own
    assert own == again and len(own) == len(set(own)) and own == sorted(own)


def test_similar_sets_are_brute_force(spark):
    base = "the {} of a {} in the {} with that {} and this {} for the {} by an {} on the {} was {} as it is {}".split("{}")
    def make(*changed):
        return "".join(p + (f"noun{k}" if k not in changed else f"other{k}") + f" verb{k} " for k, p in enumerate(base))
    rows = [(1, make()), (2, make()), (3, make(2)), (4, make(2, 5)), (5, make(1, 3, 5, 7)), (6, "nothing like it at all in the world of things"), (7, ""), (8, make() + "the end came of late")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {r.doc_id: set(r.own) for r in spotsigs.with_signatures(docs, "text", "own").collect()}
    named = {r.doc_id: r.id for r in spotsigs.classes(docs).collect()}
    assert named == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 8: 8}
    expected = {(a, b) if (len(sets[a]), a) < (len(sets[b]), b) else (b, a) for a in set(named.values()) for b in set(named.values())
                if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert expected and {(r.a, r.b) for r in spotsigs.similar_sets(docs).collect()} == expected
