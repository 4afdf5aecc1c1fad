import json
import os

from pyspark.sql import functions as F

from fleetrisk.streaming import scans as stream

META = "cve_id string, cvss_score double, severity string, published_date string, patch_age_days int, exploitation string, attack_vector string, attack_complexity string, privileges_required string, user_interaction string, scope string, confidentiality_impact string, integrity_impact string, availability_impact string"


def test_stream_ranks_new_scans(spark, tmp_path):
    land = tmp_path / "land"
    os.makedirs(land)
    doc = {"InstalledKbs": [], "MissingKbs": ["KB1", "KB2"],
           "KbEntries": [{"KB": "KB1", "Months": ["2026-Jan"], "Cves": ["CVE-2026-0001"], "Supersedes": []},
                         {"KB": "KB2", "Months": ["2026-Jan"], "Cves": ["CVE-2026-0002"], "Supersedes": []}]}
    (land / "scan_a.json").write_text(json.dumps(doc))
    from fleetrisk.operators import enrich
    dim = spark.createDataFrame([("CVE-2026-0001", 5.0, "Moderate", None, None, None, "N", "L", "N", "N", "U", "H", "N", "N"),
                                 ("CVE-2026-0002", 9.8, "Critical", None, None, None, "N", "L", "N", "N", "U", "H", "H", "H")], META)
    dim = enrich.score_dimension(dim)
    out = str(tmp_path / "out")
    q = stream.start_ranking_stream(spark, str(land), dim, out,
                                    checkpoint=str(tmp_path / "ckpt"), available_now=True)
    q.awaitTermination(120)
    got = [(r.scan_id, r["rank"], r.kb_id) for r in spark.read.parquet(out).orderBy("rank").collect()]
    assert got == [("land/scan_a", 1, "KB2"), ("land/scan_a", 2, "KB1")]
    # a second file arriving later is picked up by a restarted query; the first is not re-read
    (land / "scan_b.json").write_text(json.dumps(doc))
    q = stream.start_ranking_stream(spark, str(land), dim, out,
                                    checkpoint=str(tmp_path / "ckpt"), available_now=True)
    q.awaitTermination(120)
    counts = {r.scan_id: r["count"] for r in spark.read.parquet(out).groupBy("scan_id").count().collect()}
    assert counts == {"land/scan_a": 2, "land/scan_b": 2}


def test_a_batch_run_again_is_written_once(spark, tmp_path, monkeypatch):
    """foreachBatch is at least once: writing the same batch twice leaves it once."""
    rows = spark.createDataFrame([("h/a", 1)], "scan_id string, rank int")
    for _ in range(2):
        rows.write.mode("overwrite").parquet(f"{tmp_path}/out/batch_id=0")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
