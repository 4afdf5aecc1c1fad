import numpy as np
from pyspark.sql import functions as F

import brute
from brute import SF
import corpus_pipeline as pipeline
from fleetrisk.llm import langid, packing
from fleetrisk.llm.common import table


def test_run_is_brute_force(spark):
    docs = table(spark, SF, "documents")
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    known = {r.doc_id for r in langid.identify(docs).where("not rejected").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in known]
    component = brute.near_components(rows, pipeline.NEAR_PERCENT)
    rows = [(i, t) for i, t in rows if component[i] == i and not brute.contamination(t, items)[3]]
    found = {}
    for r in pipeline.run(spark, SF).collect():
        assert len(r.ids) == 4 * r.length and r.offset == 0
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == {i for i, _ in rows}
    encode = packing.encoder(__import__("public_tokenizers").path(packing.TOKENIZER))
    for doc_id, text in rows:
        own = sorted(found[doc_id], key=lambda r: r.start)
        ids = b"".join(r.ids for r in own)
        spans = brute.base_spans(text)
        if not spans and not any(w in text.lower() for w in ("user", "login", "account", "client", "://", "pass", "secret", "token", "api")):
            assert ids == encode.whole(text) + np.array([1], "<u4").tobytes()
        for kind, s, e in spans:
            assert encode.whole(text[s:e]) not in ids


def test_stages_keep_columns_and_clean_rows(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert pipeline.STAGES[3][1](spark, docs, SF).count() == docs.count()


def test_empty_and_odd_rows_pass_through(spark):
    schema = table(spark, SF, "documents").schema
    empty = spark.createDataFrame([], schema)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "the cat of the house", "en", "s", 20), (2, "the cat of the house", "en", "s", 20)], schema)
    docs = odd
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert docs.where(F.col("doc_id") == 2).count() == 1


def test_near_dedup_links_from_0_8(spark):
    base = [f"w{k}" for k in range(204)]
    copy = base[:185] + [f"x{k}" for k in range(19)]  # 181 of 219 shingles: 0.826
    other = base[:176] + [f"y{k}" for k in range(28)]  # 172 of 228: 0.754
    schema = table(spark, SF, "documents").schema
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate((base, copy, other))], schema)
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, SF).collect()) == [0, 2]


def test_near_dedup_is_brute_force_at_0_8(spark):
    docs = table(spark, SF, "documents")
    component = brute.near_components([(r.doc_id, r.text) for r in docs.collect()], 80)
    assert {r.doc_id for r in pipeline.near_dedup(spark, docs, SF).collect()} == {i for i, v in component.items() if i == v}
