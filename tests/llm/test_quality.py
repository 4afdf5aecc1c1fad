import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fleetrisk.llm import quality
from fleetrisk.llm.common import table

LABELS = "doc_id long, quality int, toxic int"


def grams(text):
    found, bounds = quality.features(pa.array([text], pa.string()))
    assert bounds.tolist() == [0, len(found)]
    return found.tolist()


def test_features_are_unigrams_and_bigrams_of_each_row():
    texts = ["a b a", None, "", "Solo", "a b"]
    found, bounds = quality.features(pa.array(texts, pa.string()))
    assert np.diff(bounds).tolist() == [5, 0, 0, 1, 3]
    assert sorted(found[:5].tolist()) == sorted(grams("a") * 2 + grams("b") + [g for g in grams("a b") if g not in grams("a") + grams("b")]
                                                + [g for g in grams("b a") if g not in grams("a") + grams("b")])


def test_ratios_are_brute_force(spark):
    good = [f"fine words about topic{k % 7} and more fine words" for k in range(30)]
    bad = [f"buy!! now!! cheap{k % 5}!! now!! buy!!" for k in range(12)]
    rows = list(enumerate(good + bad + ["", None, "fine words"]))
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, kept string, log_ratio double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(i, 0, 0) for i in range(30, 36)] + [(20, 1, 1), (21, None, None), (19, 0, 0)], LABELS)
    targets = set(range(19))  # 19 has conflicting labels
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in targets:
            target.update(grams(t))
    found = {r.doc_id: r for r in quality.resample(docs, labels).collect()}
    for i, t in rows:
        own, n = Counter(grams(t)), len(grams(t))
        mine = own if i in targets else Counter()
        ratio = 0.0
        for g in grams(t):
            q = (raw[g] - own[g] + 1) / (sum(raw.values()) - n + quality.BUCKETS)
            p = (target[g] - mine[g] + quality.BUCKETS * q) / (sum(target.values()) - sum(mine.values()) + quality.BUCKETS)
            ratio += math.log(p / q) / n
        assert found[i].n_grams == n and found[i].log_ratio == pytest.approx(ratio, abs=1e-9)
        assert found[i].kept == (n > 0 and ratio >= -(0.06 + 0.6 / math.sqrt(max(n, 1))))
    keys = sorted((r.gumbel_key for r in found.values()), reverse=True)
    assert [r.gumbel_key for r in sorted(found.values(), key=lambda r: r.rank)] == keys
    assert sum(r.selected for r in found.values()) == sum(r.kept for r in found.values())
    assert all(r.selected == (r.rank <= sum(x.kept for x in found.values())) for r in found.values())


def test_labelled_texts_are_told_apart(spark):
    """Each text is judged without its own n-grams, so labelled texts are held out from themselves."""
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = {r.doc_id: r for r in quality.resample(docs, labels).collect()}
    assert len(found) == docs.count()
    judged = [(r.quality, r.toxic, found[r.doc_id]) for r in labels.collect()]
    good = sorted(r.log_ratio for q, t, r in judged if q == 1)
    bad = sorted(r.log_ratio for q, _, r in judged if q == 0)
    auc = np.searchsorted(bad, good).sum() / (len(good) * len(bad))
    clean = [r.kept for q, t, r in judged if q == 1 and t == 0]
    assert auc > 0.97 and sum(clean) > 0.98 * len(clean)
    assert sum(not r.kept for q, _, r in judged if q == 0) > 0.9 * len(bad)
    assert all(r.kept == r.selected for r in found.values())
    few = quality.resample(docs, labels, 0.3).where("selected").collect()
    assert all(r.kept for r in few) and 0 <= len(few) - 0.3 * sum(r.kept for r in found.values()) < 1


def test_runs_agree_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    first = sorted(map(str, quality.resample(docs, labels).collect()))
    assert len(first) == 4 and first == sorted(map(str, quality.resample(docs.repartition(3), labels).collect()))
    none = quality.resample(docs, labels.limit(0)).collect()
    assert [r.kept for r in sorted(none, key=lambda r: r.rank)] == [True, True, True, False]
    assert quality.resample(docs.limit(0), labels).count() == 0 and quality.sample(docs, labels, 0.0).count() == 0


def test_gumbel_top_k_follows_importance(spark):
    """Texts e times as important are drawn about e times as often as the first."""
    docs = spark.createDataFrame([(i, "alpha beta" if i % 2 else "gamma delta") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 400, 2)] + [(i, 1, 0) for i in range(0, 396, 2)], LABELS)
    rows = quality.resample(docs, labels, 0.01).collect()
    picked = [r for r in rows if r.selected]
    ratio = {r.doc_id % 2: r.log_ratio for r in rows if r.doc_id > 1000}
    want = 1 / (1 + math.exp(-quality.SHARPNESS * (ratio[1] - ratio[0])))
    assert len(picked) == 40 and abs(sum(r.doc_id % 2 for r in picked) / 40 - want) < 0.3


def test_toxic_texts_of_good_prose_are_rejected(spark):
    """Judged by models of the other half of the labels."""
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = {r.doc_id: r for r in quality.resample(docs, labels.where("doc_id % 2 = 0")).collect()}
    judged = [(r.toxic, found[r.doc_id]) for r in labels.where("doc_id % 2 = 1 and quality = 1").collect()]
    toxic, clean = ([r for t, r in judged if t == v] for v in (1, 0))
    assert sum(not r.kept for r in toxic) > 0.85 * len(toxic) and sum(r.kept for r in clean) > 0.95 * len(clean)
    assert sum(r.selected for r in toxic) < 0.15 * len(toxic)


def test_a_toxic_word_in_a_long_text(spark):
    prose = "some plain words of good prose about the weather and the sea " * 40
    texts = [prose + f"part {k} " + ("Vilewords! " if k % 4 == 0 else "") for k in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(100, prose + "VILEWORD"), (101, prose), (102, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(72)], LABELS)
    kept = {r.doc_id for r in quality.resample(docs, labels).where("kept").collect()}
    assert kept == {k for k in range(80) if k % 4} | {101}
