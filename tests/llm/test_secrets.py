import hashlib

import brute
from brute import SF
from fleetrisk.llm import secrets
from fleetrisk.llm.common import table

AKIA = "AKIA" + "Q7" * 8
ROWS = [
    (1, 'x password = "abcdefghijklmnop" y'), (2, "password:secret : abcdefghijklmn"), (3, f"😀 {AKIA} and {'0123456789abcdef' * 2} é TOKEN=zzzzzzzzzzzz"),
    (4, None), (5, ""), (6, "user=bob password=abc123"), (7, "user=bob and nothing else, password=abc123" + " far" * 200 + " https://db.example/x"),
    (8, "api_key 'short' apikey:'tooshort1' secret==x token = token = aaaaaaaaaaaaaaa"), (9, "AKIA123 deadbeef AKIAAKIA" + "A" * 14),
    (10, f"{AKIA} " + "Zz9+" * 10), (11, "Zz9+" * 10 + " alone"), (12, "login: amy " + "a" * 20), (None, "secret: 0123456789abcdef0"), (1, 'x password = "abcdefghijklmnop" y')]


def frame(spark):
    return spark.createDataFrame([(i, t, 3, "s", len(t or "")) for i, t in ROWS], "doc_id long, text string, kind int, start string, n_chars int")


def test_base_spans_are_brute_force(spark):
    found = secrets.report(frame(spark)).collect()
    assert len(found) == len(ROWS)
    expected = []
    for doc_id, text in ROWS:
        spans = brute.base_spans(text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        expected.append((doc_id or -1, *(sum(k == kind for k, *_ in spans) for kind in ("assign", "access", "hex")), hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found) == sorted(expected)


def test_weak_parts_need_complements(spark):
    spans = {r.doc_id: r.spans for r in secrets.report(frame(spark)).collect()}
    assert spans[6] == "ident:0:8,short:9:24" and "endpoint" not in spans[7] and spans[7].startswith("ident:0:8")
    assert spans[10].split(",")[1].startswith("blob:") and spans[11] == "" and spans[4] == spans[5] == ""
    assert spans[12] == "ident:0:10,hex:11:31" and spans[8] == ""


def test_given_table_base(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in secrets.report(docs).collect():
        spans = brute.base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def test_redaction_masks_spans_only(spark):
    docs = frame(spark)
    found = secrets.redact(docs)
    assert found.columns == docs.columns
    by_id = {r.doc_id: r for r in found.collect()}
    assert by_id[1].text == 'x [secret]" y' and by_id[1].n_chars == len(by_id[1].text) and by_id[4].text is None and by_id[11].text == dict(ROWS)[11]
    assert by_id[3].text == "😀 [secret] and [secret] é [secret]" and found.count() == len(ROWS)
    assert by_id[None].text == "[secret]"  # overlapping spans are one
    assert secrets.redact(docs.limit(0)).count() == 0 and secrets.report(docs.limit(0)).count() == 0


def test_many_matches_in_one_text(spark):
    text = " ".join(f"token=abcdefghijkl{k:04d}" for k in range(3000))
    r = secrets.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_assign == 3000 and r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in brute.base_spans(text)).encode()).hexdigest()


def test_redact_keeps_columns_of_its_own_names(spark):
    docs = spark.createDataFrame([(1, "password = abcdefgh12345678", 3, "h", "f"), (2, "clean", 4, "h", "f")], "doc_id long, text string, __id int, __hash string, __found string")
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    assert {(r.doc_id, r["__id"], "abcdefgh12345678" in r.text) for r in out.collect()} == {(1, 3, False), (2, 4, False)}
