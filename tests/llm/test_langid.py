import zlib

import numpy as np

from fleetrisk.llm import langid
from fleetrisk.llm.common import table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.lang is not None]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts(spark):
    words = {"xx": "kala mala tala pala " * 5, "yy": "gruz bruz druz fruz " * 5}
    train = [(i, words[lang] + str(i), lang, 0.0) for i in range(40) for lang in words]
    odd = [(1000, None, None, 0.0), (1001, "12 34 !!", "xx", 0.0), (1002, "", "yy", 0.0), (None, "kala mala tala", "xx", 0.0), (1003, "gruz BRUZ", None, 0.0),
           (1003, "gruz BRUZ", None, 0.0), (1004, "日本語の文章です", None, 0.0)]
    docs = spark.createDataFrame(train + odd, "doc_id long, text string, lang string, lang_score double")
    found = {}
    for r in langid.identify(docs).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert [found[k][0].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and found[1000][0].score == 0
    assert found[None][0].lang_pred == "xx" and found[None][0].held_out is False
    assert [r.lang_pred for r in found[1003]] == ["yy", "yy"]
    assert found[1004][0].rejected and found[1004][0].lang_pred in words
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == 83 and {r.lang_score for r in kept.collect()} == {0.0}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score, r.rejected) for r in langid.identify(docs).collect()] == [("und", 0.0, True)]
    assert langid.identify(docs.limit(0)).count() == 0


def test_labels_of_held_out_rows_are_not_learned(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "abc abd" if i not in held else "xyz xyw", "aa" if i not in held else "zz") for i in range(200)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.languages) == {"aa"}


def sf_model(spark, without=None):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    return docs, langid.fit(docs.where(docs.lang != without) if without else docs)


def test_centroids_hold_their_share():
    rng = np.random.default_rng(0)
    topics = np.repeat(np.eye(3, 40, dtype=np.float32), [100, 60, 20], axis=0) + 0.2 * rng.random((180, 40), dtype=np.float32)
    odd = np.eye(40, dtype=np.float32)[[30, 35]]
    x = langid._unit(np.vstack([topics, odd]))
    means = langid.spherical_means(x, np.full(len(x), 100.0), 4)
    assert len(means) >= 3 and langid._members(x, means).min() >= langid.LEAST_SHARE * len(x)
    assert sorted(np.unique(means[:, :3].argmax(axis=1))) == [0, 1, 2]
    assert len(langid.spherical_means(x[:1], np.ones(1), 4)) == 1


def test_several_centroids_of_a_language(spark):
    _, model = sf_model(spark)
    assert all(model.languages.count(lang) >= 2 for lang in ("en", "de", "fr"))


def test_prediction_is_the_nearest_centroid(spark):
    docs, model = sf_model(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.identify(docs).collect():
        text = texts[r.doc_id] or ""
        tf = langid.trigram_counts([text])[0].astype(float)
        vector = tf * model.idf
        cosines = [float(vector @ c) / np.linalg.norm(vector) if tf.any() else 0.0 for c in model.centroids.astype(float)]
        best = int(np.argmax(cosines))
        assert (r.lang_pred, tf.any()) == (model.languages[best] if tf.any() else "und", r.lang_pred != "und")
        assert abs(r.score - max(cosines)) < 1e-4
        close = cosines[best] * np.sqrt(1 + model.noise[best] / max(tf.sum(), 1))
        limit = model.floor[best] * tf.sum() / (tf.sum() + langid.FEW_TRIGRAMS)
        assert r.rejected == (not tf.any() or close < limit) or abs(close - limit) < 1e-4


def test_unlearned_languages_are_rejected_and_learned_ones_stay(spark):
    docs, model = sf_model(spark)
    rows = [(r.lang, r.text) for r in docs.where("lang is not null").collect() if r.text and any(c.isalpha() for c in r.text)]
    rejected = langid.classify([t for _, t in rows], model)[2]
    assert 0 < rejected.sum() <= 0.01 * len(rows)
    for without in ("es", "de"):
        _, fewer = sf_model(spark, without)
        own = [t for lang, t in rows if lang == without and len(t) > 300]
        assert langid.classify(own, fewer)[2].mean() > 0.95
    foreign = ["Tämä on suomenkielinen teksti, jossa kerrotaan säästä ja ihmisten elämästä pohjoisessa maassa talven aikana. Kun aurinko ei nouse, "
               "monet kalastajat istuvat iltaisin tuvassa ja kutovat verkkoja, lapset tekevät läksyjä ja vanhukset muistelevat menneitä vuosia.",
               "Dit is een Nederlandse tekst over het weer en het leven van mensen in het noorden van het land. Wanneer de zon niet schijnt, blijven veel "
               "vissers thuis, maken kinderen hun huiswerk en vertellen ouderen verhalen over vroeger, toen alles nog langzamer ging dan tegenwoordig.",
               "To jest polski tekst o pogodzie i życiu ludzi na północy kraju podczas zimy. Kiedy nie ma słońca, rybacy siedzą wieczorami w domu."]
    assert langid.classify(foreign, model)[2].all()


def test_a_very_long_text(spark):
    docs, model = sf_model(spark)
    text = " ".join(r.text for r in docs.where("lang = 'fr'").limit(60).collect()) * 20
    assert len(text) > 1_000_000 and langid.classify([text], model)[0] == ["fr"] and not langid.classify([text], model)[2][0]


def test_trigrams_stay_within_words_and_rows():
    together = langid.trigram_counts(["ab cd", None, "AB"])
    assert together[1].sum() == 0 and together[0].sum() == 4 and together[2].sum() == 2
    assert (together[2] == langid.trigram_counts(["ab"])[0]).all()
