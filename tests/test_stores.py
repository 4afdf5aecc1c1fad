import datetime
import gzip
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from fleetrisk.operators import baseline, correlate, sketches
from fleetrisk.sources import advisory_store, run_log, tables

META = "month string, pos long, cve_id string, severity string, base_score double, vector string, published_date string, exploitation string"


def meta(spark, rows):
    return spark.createDataFrame([(m, p, c, s, 1.0, None, None, None) for m, p, c, s in rows], META)


def held(spark, path):
    return {(r.month.isoformat()[:7], r.cve_id): r.severity for r in advisory_store.read(spark, path).collect()}


def files(spark, path):
    return {r[0] for r in advisory_store.read(spark, path).select("_metadata.file_path").distinct().collect()}


def test_a_load_rewrites_only_its_months(spark, tmp_path):
    path = str(tmp_path / "store")
    assert advisory_store.read(spark, path).count() == 0
    first = meta(spark, [("2026-Jan", 0, "CVE-2026-0001", "a"), ("2026-Jan", 1, "CVE-2026-0001", "b"), ("2026-Feb", 0, "CVE-2026-0001", "c"),
                         ("2026-Feb", 1, "CVE-2026-0002", "d"), ("2026-Feb", 2, "CVE-26-1", "no id"), ("odd", 0, "CVE-2026-0009", "no month")])
    assert advisory_store.upsert(first, path, 1) == [datetime.date(2026, 1, 1), datetime.date(2026, 2, 1)]
    assert held(spark, path) == {("2026-01", "CVE-2026-0001"): "b", ("2026-02", "CVE-2026-0001"): "c", ("2026-02", "CVE-2026-0002"): "d"}
    before = files(spark, path)
    second = meta(spark, [("2026-Feb", 0, "CVE-2026-0002", "new"), ("2026-Feb", 5, "CVE-2026-0003", "e")])
    for _ in range(2):  # a load that runs again gives the same store
        assert advisory_store.upsert(second, path, 2) == [datetime.date(2026, 2, 1)]
        assert held(spark, path) == {("2026-01", "CVE-2026-0001"): "b", ("2026-02", "CVE-2026-0001"): "c",
                                     ("2026-02", "CVE-2026-0002"): "new", ("2026-02", "CVE-2026-0003"): "e"}
    january = {f for f in before if "month=2026-01" in f}
    assert january and january <= files(spark, path) and not (before - january) & files(spark, path)
    assert advisory_store.upsert(second.limit(0), path, 3) == []


def test_windows_prune_months_when_they_run(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(f"{y}-{m}", k, f"CVE-{y}-{k:04d}", f"{y}{m}") for y in range(2020, 2026) for m in ("Jan", "Jul") for k in range(4)]
    rows += [(f"{y}-Jul", 9, "CVE-2000-0001", f"{y}") for y in range(2020, 2026)]
    advisory_store.upsert(meta(spark, rows), path, 1)
    base = spark.createDataFrame([(1, True, "2021-Jan", "2022-Aug"), (2, True, "2021-Jan", "2022-Aug"), (3, True, "2024-Jul", "2024-Jul"), (4, False, "2020-Jan", "2025-Jul")],
                                 "scan_id int, IsAdmin boolean, LcuMonthId string, MsrcLatestMonthId string")
    windows = baseline.month_window(base)[0]
    found = advisory_store.for_windows(advisory_store.read(spark, path), windows)
    got = {(r.scan_id, r.cve_id): r.severity for r in found.collect()}
    own = {f"CVE-{y}-{k:04d}": f"{y}Jul" for y in (2021, 2022) for k in range(4)} | {"CVE-2000-0001": "2022"}
    assert {c: s for (i, c), s in got.items() if i == 1} == own == {c: s for (i, c), s in got.items() if i == 2}
    assert {c for i, c in got if i == 3} == {f"CVE-2024-{k:04d}" for k in range(4)} | {"CVE-2000-0001"} and not any(i == 4 for i, _ in got)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_a_repeated_record_is_one(spark, tmp_path):
    path = str(tmp_path / "log")
    metrics = spark.createDataFrame([("rows", 5), ("bad", 0)], "metric string, value long")
    assert run_log.record(spark, path, "r1", "flatten", metrics, artefacts={"b": "x/y", "a": "z"})
    assert not run_log.record(spark, path, "r1", "flatten", metrics.limit(0))
    assert run_log.record(spark, path, "r1", "enrich", status=run_log.FAILED, message="lost")
    assert run_log.record(spark, path, "r2", "flatten", metrics.limit(1))
    log = run_log.read(spark, path)
    assert log.count() == 3
    status = {(r.run_id, r.stage): (r.status, r.attempts) for r in run_log.statuses(log, ["flatten", "enrich"]).collect()}
    assert status == {("r1", "flatten"): ("succeeded", 1), ("r1", "enrich"): ("failed", 1), ("r2", "flatten"): ("succeeded", 1), ("r2", "enrich"): ("missing", 0)}
    assert run_log.record(spark, path, "r1", "enrich", metrics, attempt=2)
    log = run_log.read(spark, path)
    assert {(r.stage, r.metric): r.value for r in run_log.metrics(log).where("run_id = 'r1'").collect()} == {
        ("flatten", "rows"): 5.0, ("flatten", "bad"): 0.0, ("enrich", "rows"): 5.0, ("enrich", "bad"): 0.0}
    assert [(r.name, r.path) for r in run_log.artefacts(log, "flatten").orderBy("name").collect()] == [("a", "z"), ("b", "x/y")]
    for bad in ("", "a/b", "_hidden", "k=v"):
        with pytest.raises(ValueError):
            run_log.record(spark, path, bad, "flatten")
    assert tables.write_summary(spark, "r9", "report", metrics, path) and not tables.write_summary(spark, "r9", "report", metrics, path)
    assert tables.read_summary(spark, path).where("run_id = 'r9'").count() == 2


def test_sketches_roll_up(spark):
    rnd = random.Random(4)
    rows = [(s, f"KB{rnd.randrange(3000)}", f"CVE-2024-{rnd.randrange(60000):05d}", f"2024-{m}") for s in range(5) for m in ("Jan", "Feb") for _ in range(4000)]
    flat = spark.createDataFrame(rows, "scan_id int, kb_id string, cve_id string, month string")
    parts = sketches.sketch(flat)
    for keys in ([], ["month"], ["scan_id"]):
        got = sketches.estimates(sketches.roll_up(parts, keys)).collect()
        for r in got:
            mine = [x for x in rows if all(x[{"scan_id": 0, "month": 3}[k]] == r[k] for k in keys)]
            assert r.rows == len(mine)
            for name, at in (("kb_id", 1), ("cve_id", 2)):
                exact = len({x[at] for x in mine})
                assert abs(r[f"{name}_estimate"] - exact) <= sketches.error_bound() * exact


def test_requests_are_merged(spark):
    months = spark.createDataFrame([("s", k + 1, f"m{k}") for k in range(5)] + [("t", 1, "m0")], "scan_id string, pos int, month_id string")
    asked = correlate.requests(months)
    assert {(r.scan_id, r.month): r.request for r in asked.collect()} == {("s", "m0"): 0, ("s", "m1"): 0, ("s", "m2"): 0, ("s", "m3"): 1, ("s", "m4"): 1, ("t", "m0"): 0}
    rows = spark.createDataFrame([("s", "m0", ["5001"], "CVE-2024-0001", None), ("s", "m1", ["5001"], "CVE-2024-0002", None), ("s", "m4", ["5001"], "CVE-2024-0003", "4999"),
                                  ("s", "m9", ["5002"], "CVE-2024-0004", None), ("t", "m4", ["5001"], "CVE-2024-0001", None)],
                                 "scan_id string, month string, kb_articles array<string>, cve string, supercedence string")
    returned = correlate.requested_entries(rows, asked)
    assert sorted((r.scan_id, r.request, r.kb_id, tuple(r.months)) for r in returned.collect()) == [("s", 0, "KB5001", ("m0", "m1")), ("s", 1, "KB5001", ("m4",))]
    entries = correlate.merge_entries(returned)
    e = entries.first()
    assert (e.months, e.cves, e.supersedes, e.update_type) == (["m0", "m1", "m4"], [f"CVE-2024-000{k}" for k in (1, 2, 3)], ["KB4999"], "Superseding")
    hosts = spark.createDataFrame([("s", None), ("t", "No KB data returned"), ("u", "why")], "scan_id string, reason string")
    installed = spark.createDataFrame([("s", "KB5001"), ("u", "KB1")], "scan_id string, kb_id string")
    got = {r.scan_id: r for r in correlate.scan_summary(correlate.correlate(entries, installed), hosts=hosts, raw=returned).collect()}
    assert (got["s"].raw_entries_returned, got["s"].expected_kbs, got["s"].logical_present_kbs, got["s"].missing_kbs) == (2, 1, 2, 0)
    assert (got["u"].reason, got["u"].installed_kbs, got["u"].expected_kbs) == ("why", 1, 0) and got["t"].missing_kbs == 0


def test_hand_overs_go_with_their_step(spark):
    """A step leaves what it returns and nothing else, also inside another one and if it fails."""
    from fleetrisk.operators import joins
    from fleetrisk.session import ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    there = lambda: {x for _, names, _ in os.walk(folder) for x in names if x.startswith("saved-")}
    before = there()
    out = joins.saved_alone(spark, lambda: joins.saved(joins.saved_alone(spark, lambda: joins.saved(spark.range(5))).where("id > 0")))
    assert len(there() - before) == 1 and sorted(r.id for r in out.collect()) == [1, 2, 3, 4]

    def fails():
        joins.saved(spark.range(3))
        raise ValueError("no")

    with pytest.raises(ValueError):
        joins.saved_alone(spark, fails)
    assert len(there() - before) == 1 and joins._steps == []


def test_shuffle_files_go_with_their_job(spark):
    from fleetrisk.operators import joins
    from fleetrisk.plans.queries import QUERIES

    QUERIES["host_constraints"](spark, "/root/testdata/sf0.001")
    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = files()
    rows = spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()
    assert joins.saved(rows).count() == 7 and rows.count() == 7 and len(rows.collect()) == len(rows.collect()) == 7
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before


def test_rankings_and_reports_are_written_compressed(spark, tmp_path):
    from fleetrisk.plans import report
    from fleetrisk.sources import tables

    made = spark.sparkContext.accumulator(0)

    def count(k):
        made.add(1)
        return k

    ranking = spark.range(40).select(F.lit("s").alias("scan_id"), F.udf(count, "int")(F.col("id").cast("int")).alias("rank"), F.concat(F.lit("KB"), F.col("id").cast("string")).alias("kb_id"))
    tables.write_ranking(ranking, str(tmp_path / "ranking"))
    assert sorted(r["rank"] for r in tables.read_ranking(spark, str(tmp_path / "ranking")).collect()) == list(range(40)) and made.value == 40
    lines = spark.range(40).select(F.lit("s").alias("scan_id"), F.lit(0).alias("section"), F.col("id").alias("k1"), F.lit(0).alias("k2"), F.lit(0).alias("k3"), F.col("id").cast("string").alias("line"))
    report.write_report(lines, str(tmp_path / "report"), 3)
    files = sorted(str(p) for p in (tmp_path / "report" / "scan_id=s").glob("part-*"))
    assert [line for p in files for line in gzip.open(p, "rt").read().split()] == [str(k) for k in range(40)]
    assert all(p.name.endswith(".json.gz") for p in (tmp_path / "ranking").rglob("part-*"))
