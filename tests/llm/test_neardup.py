import random

import numpy as np
from pyspark.sql import functions as F

import brute
from brute import SF
from fleetrisk.llm import neardup
from fleetrisk.llm.common import table


def texts(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    found = []
    for size in (3, 5, 7, 12, 40, 150):
        base = [rng.choice(words) for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            copy = base[:]
            for _ in range(edits):
                copy[rng.randrange(size)] = rng.choice(words)
            found.append(" ".join(copy))
    # a chain: each is like the next, the ends are not alike
    chain = [f"c{k}" for k in range(300)]
    found += [" ".join(chain[k:k + 200]) for k in range(0, 60, 10)]
    return found


def test_components_are_brute_force(spark):
    rows = list(enumerate(texts() + ["", None, " \n", "The the", "the THE"]))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    expected = brute.near_components([r for r in rows if brute.shingles(r[1])])
    found = neardup.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    by_id = dict(rows)
    for r in found:
        assert r.n_shingles == len(brute.shingles(by_id[r.doc_id]))
        assert r.component_id == expected.get(r.doc_id, r.doc_id) and r.kept == (r.component_id == r.doc_id)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if r.kept}


def test_given_table(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute.near_components(rows)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == expected


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (9, "a b c d e f"), (None, "a b c d e f"), (None, "zzz"), (7, None)], "doc_id long, text string")
    found = sorted((r.doc_id or -1, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect() if r.component_id is not None)
    assert found == [(-1, 5, False), (5, 5, True), (5, 5, True), (7, 7, True), (9, 5, False)]
    assert sorted((r.doc_id or -1, r.text) for r in neardup.keep_one(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()) == [(-1, "zzz"), (5, "a b c d e f"), (7, "")]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0 and neardup.keep_one(docs.limit(0)).count() == 0


def test_tiles_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 3)
    monkeypatch.setattr(neardup, "TASK_ROWS", 50)
    rows = list(enumerate(texts(8)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == brute.near_components(rows)


def test_a_family_without_an_original(spark):
    """Copies of an original that is not there: links lie between copies, not around a hub."""
    rng = random.Random(4)
    base = [f"v{k}" for k in range(250)]
    rows = []
    for i in range(60):
        copy = base[:]
        for _ in range(rng.choice((2, 3, 4, 5, 6))):
            copy[rng.randrange(250)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == brute.near_components(rows)


def test_components_of_a_long_path(spark):
    order = list(range(60))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(100, 101), (101, 100), (103, 103)], "a long, b long")
    found = {r.node: r.component for r in neardup.components(edges).collect()}
    assert found == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100}


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    a, b = np.unique(pool[:3000]), np.unique(pool[600:3600])
    regs = neardup.registers([a, b, a, np.zeros(0, np.uint64), pool[:1]])
    found, used = neardup.estimate(regs[[0, 0, 0]], regs[[1, 2, 3]])
    assert abs(found[0] - 2400 / 3600) < 0.2 and found[1] == 1 and found[2] < 0.05 and used[0] == neardup.REGISTERS
    full = neardup.filled(regs)
    assert (full[[0, 1, 2, 4]] > 0).all() and (full[3] == 0).all() and len(np.unique(full[4])) == 1


def test_unrelated_sets_estimate_near_zero():
    rng = np.random.default_rng(1)
    left, right = (neardup.registers([np.unique(rng.integers(0, 1 << 64, 500, dtype=np.uint64)) for _ in range(200)]) for _ in range(2))
    found, _ = neardup.estimate(left, right)
    assert found.mean() < 0.002


def brute_components(rows, percent):
    sets = [(i, brute.shingles(t)) for i, t in rows]
    label = {i: i for i, _ in rows}
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a & b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def test_the_threshold_is_a_parameter(spark):
    rows = list(enumerate(texts(11)))
    # more texts near the thresholds
    base = [f"t{k}" for k in range(200)]
    for size, new in ((166, 10), (166, 11)):
        rows.append((len(rows), " ".join(base[:size + 4] + [f"n{new}x{k}" for k in range(new)])))
    rows += [(len(rows), " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (60, 80, 85):
        found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, percent).collect()}
        assert found == brute_components(rows, percent), percent
    assert len(set(brute_components(rows, 80).values())) < len(set(brute_components(rows, 85).values()))
    assert neardup.keep_one(docs, 80).count() == len(set(brute_components(rows, 80).values()))


def test_bands_follow_the_threshold():
    assert neardup.bands_of(85) == (25, 5)
    for percent in (50, 60, 70, 80, 85, 95):
        bands, width = neardup.bands_of(percent)
        assert (1 - (percent / 100) ** width) ** bands < 1e-6 and bands * width <= neardup.REGISTERS
