import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from fleetrisk import schemas
from fleetrisk.operators import correlate, flatten
from fleetrisk.sources import advisory, scan_files, scans, tables

# invented documents: no KB, link, build or product of a real scan
OLD = {  # older vintage: no MonthsWithEntries / MissingBreakdown / UpdateType
    "Baseline": {"OsName": "Example OS 11 Pro", "DisplayVersion": "99H1", "Build": "12345.6",
                 "Architecture": "x64", "IsAdmin": True, "LcuMonthId": "2031-Mar",
                 "LcuInstallTime": "/Date(1)/", "MsrcLatestMonthId": "2031-Apr",
                 "ProductNameHint": "Example 11 Version 99H1 for x64-based Systems"},
    "InstalledKbs": ["KB9000010", "kb9000001"],
    "MonthsRequested": ["2031-Mar", "2031-Apr"],
    "KbEntries": [
        {"KB": "KB9000010", "Months": ["2031-Apr"], "Cves": ["CVE-2031-0001", "CVE-2031-0002"], "Supersedes": ["KB9000008"]},
        {"KB": "KB9000020", "Months": ["2031-Apr"], "Cves": ["CVE-2031-0003"], "Supersedes": []},
        {"KB": "KB9000008", "Months": ["2031-Mar"], "Cves": ["CVE-2031-0004"], "Supersedes": []},
    ],
    "MissingKbs": ["KB9000020"],
}
NEW = {  # newer vintage with the optional fields
    "Baseline": {"OsName": "Example OS 11 Pro", "IsAdmin": True, "LcuMonthId": "2030-Dec"},
    "InstalledKbs": ["KB9000005"],
    "MonthsRequested": ["2030-Dec"], "MonthsWithEntries": ["2030-Dec"],
    "KbEntries": [
        {"KB": "KB9000005", "Months": ["2030-Dec"], "Cves": ["CVE-2030-1111"], "Supersedes": ["KB9000004"], "UpdateType": "Superseding"},
        {"KB": "KB9000004", "Months": ["2030-Dec"], "Cves": ["CVE-2030-2222"], "Supersedes": [], "UpdateType": "Standalone"},
    ],
    "MissingKbs": [], "MissingBreakdown": {"Superseding": 0, "Standalone": 0},
}


@pytest.fixture()
def scan_dir(tmp_path):
    for host, name, doc in (("h1", "scan_20310401_010203.json", OLD), ("h1", "scan_20310402_040506.json", NEW),
                            ("h2", "scan_20310401_070809.json", OLD)):
        os.makedirs(tmp_path / host, exist_ok=True)
        (tmp_path / host / name).write_text(json.dumps(doc, indent=2))
    (tmp_path / "h2" / "scan_broken.json").write_text("[1, 2, 3]")
    return str(tmp_path)


def test_read_scans_and_latest(spark, scan_dir):
    s = scans.read_scans(spark, scan_dir)
    assert s.count() == 4
    # Spark refuses queries that read only the corrupt-record column: read a data column too
    got = s.select("KbEntries", "_corrupt_record").collect()
    assert sum(r._corrupt_record is not None for r in got) == 1
    good = s.where("valid")
    latest = {r.host: r.scan_id for r in scans.latest_scans(good).collect()}
    assert latest == {"h1": "h1/scan_20310402_040506", "h2": "h2/scan_20310401_070809"}
    e = scans.kb_entries(good.where(F.col("scan_id") == "h1/scan_20310401_010203"))
    types = {r.kb_id: r.update_type for r in e.collect()}
    assert types == {"KB9000010": "Superseding", "KB9000020": "Standalone", "KB9000008": "Standalone"}


def test_scan_recomputed_missing_matches_stored(spark, scan_dir):
    s = scans.read_scans(spark, scan_dir).where("valid")
    c = correlate.correlate(scans.kb_entries(s), scans.installed(s))
    got = sorted(tuple(r) for r in c["missing"].collect())
    stored = sorted(tuple(r) for r in scans.stored_missing(s).collect())
    assert got == stored
    flat = flatten.flatten(scans.kb_entries(s), scans.stored_missing(s))
    assert sorted(r.cve_id for r in flat.collect()) == ["CVE-2031-0003", "CVE-2031-0003"]


def test_equal_file_names_on_two_hosts_stay_apart(spark, tmp_path):
    entries = [{"KB": "KB9", "Months": ["2031-Mar"], "Cves": ["CVE-2031-0009"], "Supersedes": []}]
    for host, have in (("h1", ["KB9"]), ("h2", [])):
        os.makedirs(tmp_path / host)
        (tmp_path / host / "scan.json").write_text(json.dumps({"InstalledKbs": have, "KbEntries": entries, "MissingKbs": []}))
    s = scans.read_scans(spark, str(tmp_path))
    c = correlate.correlate(scans.kb_entries(s), scans.installed(s))
    assert [tuple(r) for r in c["missing"].collect()] == [("h2/scan", "KB9")]


def test_missing_folder_raises(spark, tmp_path):
    os.makedirs(tmp_path / "empty", exist_ok=True)
    with pytest.raises(Exception):
        scans.read_scans(spark, str(tmp_path / "empty"))


def test_scan_source_equals_json_reader(spark, scan_dir):
    want = {r.scan_id: r for r in scans.read_scans(spark, scan_dir).collect()}
    got = {r.scan_id: r for r in scan_files.read(spark, scan_dir).collect()}
    assert set(got) == set(want) and {k for k, r in got.items() if not r.valid} == {"h2/scan_broken"}
    for k, r in got.items():
        assert (r.host, r.file_name, r.valid) == (want[k].host, want[k].file_name, want[k].valid)
        if r.valid:
            assert all(r[c] == want[k][c] for c in schemas.SCAN.names) and r.scan_ts == want[k].scan_ts
    assert got["h2/scan_broken"]._corrupt_record == "[1, 2, 3]"
    with pytest.raises(FileNotFoundError):
        scan_files.read(spark, scan_dir + "/h1/none") if os.makedirs(scan_dir + "/h1/none") is None else None


def test_only_the_newest_wanted_files_are_opened(scan_dir, monkeypatch):
    read, opened = [], scan_files.opened

    def counted(filesystem, path):
        read.append(os.path.relpath(path, scan_dir))
        return opened(filesystem, path)

    monkeypatch.setattr(scan_files, "opened", counted)

    def scan(latest, filters=()):
        read.clear()
        reader = scan_files.ScanReader(schemas.SCAN, {"path": scan_dir, "latest": latest, "partitionBytes": "1"})
        assert not list(reader.pushFilters(list(filters)))
        reader.schema = scan_files.SCHEMA
        rows = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
        return sorted(read), rows

    os.utime(scan_dir + "/h2/scan_broken.json", (0, 0))
    files, rows = scan("true")
    assert files == ["h1/scan_20310402_040506.json", "h2/scan_20310401_070809.json"] and [r["valid"] for r in rows] == [True, True]
    assert scan("true", [EqualTo(("host",), "h1")])[0] == ["h1/scan_20310402_040506.json"]
    late = datetime(2031, 4, 2)
    assert scan("false", [GreaterThanOrEqual(("scan_ts",), late)])[0] == ["h1/scan_20310402_040506.json"]
    # the newest scan first, then its time: h1's older scan does not step in
    assert scan("true", [LessThan(("scan_ts",), late)])[0] == ["h2/scan_20310401_070809.json"]


def test_predicates_reach_the_scan_source(spark, scan_dir):
    df = scan_files.read(spark, scan_dir)
    assert [r.scan_id for r in df.where("host = 'h1' and scan_ts >= timestamp'2031-04-02 00:00:00'").collect()] == ["h1/scan_20310402_040506"]
    early = df.where("host in ('h2', 'h3') and scan_ts < timestamp'2031-04-01 07:08:09'").collect()
    assert [r.scan_id for r in early] == ["h2/scan_broken"]  # its time is that of the file
    assert df.where("scan_ts <= timestamp'2031-04-01 07:08:09' and valid").count() == 2


def test_stream_and_batch_read_alike(spark, scan_dir, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("stream"))

    def run():
        q = (scan_files.stream(spark, scan_dir).writeStream.format("parquet").option("path", out + "/rows")
             .option("checkpointLocation", out + "/ckpt").trigger(availableNow=True).start())
        q.awaitTermination(120)
        return sorted(r.scan_id for r in spark.read.parquet(out + "/rows").select("scan_id").collect())

    assert run() == sorted(r.scan_id for r in scan_files.read(spark, scan_dir).select("scan_id").collect())
    os.makedirs(scan_dir + "/h9")
    with open(scan_dir + "/h9/scan_20310501_000000.json", "w") as f:
        json.dump(NEW, f)
    assert len(run()) == 5  # each file once


def exported(spark, scan_dir, out, rows):
    s = scans.read_scans(spark, scan_dir).where("valid")
    e, i = scans.kb_entries(s), scans.installed(s)
    m = correlate.correlate(e, i)["missing"]
    months = s.select("scan_id", F.posexplode("MonthsRequested").alias("pos", "month_id"))
    named = [f.withColumn("scan_id", F.replace("scan_id", F.lit("/"), F.lit("-"))) for f in (e, i, m, scans.baselines(s), months)]
    scans.export_scans(*named, out, F.lit("2031-06-01 00:00:00").cast("timestamp"), segment_rows=rows)
    return named


@pytest.mark.parametrize("rows", [2, 10_000])
def test_export_roundtrip(spark, scan_dir, tmp_path, rows):
    out = str(tmp_path / "export")
    e, i, m, b, months = exported(spark, scan_dir, out, rows)
    names = sorted(f for _, _, files in os.walk(out) for f in files if not f.startswith("."))
    assert len(names) == (3 if rows > 100 else len(names)) and all(f.startswith("scan_20310601_000000.") for f in names)
    assert rows > 100 or len(names) > 12
    back = scan_files.read(spark, out, latest=True).withColumn("scan_id", F.col("host"))
    listed = lambda df: sorted(map(str, df.collect()))
    assert listed(scans.kb_entries(back)) == listed(e.select(scans.kb_entries(back).columns))
    assert listed(scans.installed(back)) == listed(i) and listed(scans.stored_missing(back)) == listed(m)
    got = back.where("Baseline is not null").select("scan_id", "Baseline.*")
    assert listed(got) == listed(b.select(got.columns))
    if rows > 100:
        assert {r.scan_id: r.MonthsRequested for r in back.collect()}["h1-scan_20310401_010203"] == ["2031-Mar", "2031-Apr"]


def test_a_scan_counts_when_all_its_parts_are_there(spark, scan_dir, tmp_path):
    out = str(tmp_path / "export")
    exported(spark, scan_dir, out, 2)
    folder = out + "/h1-scan_20310401_010203"
    whole = scan_files.read(spark, out).select("host").distinct().count()
    os.rename(f"{folder}/{sorted(os.listdir(folder))[-1]}", f"{folder}/.gone")
    assert whole == 3 and scan_files.read(spark, out).select("host").distinct().count() == 2


def test_ranking_and_csv_and_summary_sinks(spark, tmp_path):
    ranking = spark.createDataFrame([("s1", 1, "KB1", 9.5, None, "High", None, None, 3, "critical CVSS", "critical CVSS",
                                      [("CVE-2024-0001", 9.5, None, "High", None, None, "critical CVSS", "critical CVSS")])],
                                    schemas.RANKING)
    tables.write_ranking(ranking, str(tmp_path / "rank"))
    back = tables.read_ranking(spark, str(tmp_path / "rank"))
    assert tables.read_ranking(spark, str(tmp_path / "rank")).count() == 1  # a second read works
    (tmp_path / "list.json").write_text('[{"scan_id": "s1", "kb_id": "KB1"}]')
    assert [x.kb_id for x in tables.read_ranking_list(spark, str(tmp_path / "list.json")).collect()] == ["KB1"]
    (tmp_path / "object.json").write_text('{"scan_id": "s1"}')
    with pytest.raises(ValueError):
        tables.read_ranking_list(spark, str(tmp_path / "object.json"))
    r = back.first()
    assert r.kb_id == "KB1" and r.cves[0].cve_id == "CVE-2024-0001"
    flat = spark.createDataFrame([("KB1", ["a", "b"], "NA")], "kb_id string, drivers array<string>, x string")
    tables.write_csv(flat, str(tmp_path / "csv"))
    got = tables.read_csv(spark, str(tmp_path / "csv"), flat.schema.__class__.fromJson(
        {"type": "struct", "fields": [{"name": "kb_id", "type": "string", "nullable": True, "metadata": {}},
                                      {"name": "drivers", "type": "string", "nullable": True, "metadata": {}},
                                      {"name": "x", "type": "string", "nullable": True, "metadata": {}}]}),
        na_tokens=("NA",)).first()
    assert (got.drivers, got.x) == ("a, b", None)
    metrics = spark.createDataFrame([("rows", 5)], "metric string, value long")
    tables.write_summary(spark, "run1", "flatten", metrics, str(tmp_path / "summary"))
    s = tables.read_summary(spark, str(tmp_path / "summary")).first()
    assert (s.run_id, s.stage, s.metric, s.value) == ("run1", "flatten", "rows", 5.0)


def test_advisory_last_wins(spark, tmp_path):
    def vuln(cve, score, sev, expl, date):
        return {"CVE": cve, "CVSSScoreSets": [{"BaseScore": score, "Vector": "CVSS:3.1/AV:N"}],
                "Threats": [{"Type": 0, "Description": {"Value": "x"}}, {"Type": 3, "Description": {"Value": sev}},
                            {"Type": 1, "Description": {"Value": expl}}],
                "RevisionHistory": [{"Date": date}, {"Date": "later"}]}
    for month, v in (("2026-Feb", [vuln("cve-2026-1000", 5.0, "Important", "Exploited:No", "2026-02-10T08:00:00Z")]),
                     ("2026-Jan", [vuln("CVE-2026-1000", 9.0, "Critical", "Exploited:Yes", "2026-01-13T08:00:00Z"),
                                   vuln("CVE-26-1", 1.0, "Low", "x", "2026-01-13")])):
        os.makedirs(tmp_path / f"month={month}", exist_ok=True)
        (tmp_path / f"month={month}" / "doc.json").write_text(json.dumps({"Vulnerability": v}))
    docs = advisory.read_advisories(spark, str(tmp_path), ["2026-Jan", "2026-Feb"])
    rows = advisory.metadata_rows(advisory.vulnerabilities(docs))
    by_time = advisory.last_wins(rows, "time").collect()
    by_text = advisory.last_wins(rows, "text").collect()
    assert [(r.cve_id, r.base_score, r.severity) for r in by_time] == [("CVE-2026-1000", 5.0, "Important")]
    assert [(r.cve_id, r.base_score, r.exploitation) for r in by_text] == [("CVE-2026-1000", 9.0, "Exploited:Yes")]
    assert advisory.read_advisories(spark, str(tmp_path), ["2026-Jan"]).count() == 1


def test_entry_groups_gather_one_set(spark):
    from fleetrisk.sources import derived

    lnk = spark.sql("""SELECT * FROM VALUES (1, 7L, 100L, DATE'1994-01-01', 'N', 'F'), (1, 7L, 100L, DATE'1994-01-01', 'R', 'F'),
        (1, 7L, 200000L, DATE'1994-01-01', 'R', 'F'), (1, 7L, -1L, DATE'1994-03-01', 'R', 'F'), (2, 7L, 5L, NULL, 'R', 'F')
        AS t(scan_id, partkey, bucket, month_start, l_returnflag, l_linestatus)""")
    groups = derived.entry_groups(lnk)
    found = {r["scan_id"]: (sorted(r["_buckets"]), sorted(map(str, r["_months"])), r["_installed"]) for r in groups.collect()}
    assert found == {1: ([-1, 100, 200000], ["1994-01-01", "1994-03-01"], True), 2: ([5], [], False)}
    assert groups._jdf.queryExecution().optimizedPlan().toString().count("collect_set") == 1
    number = lambda b: spark.sql(f"SELECT {b} AS b").select(derived.cve_of_bucket(F.col("b"), entries=False).alias("c")).first()["c"]
    for b in (0, 7, 99_999, 100_000, 1_234_567, -1, -12):
        assert number(f"{b}L") == "CVE-2024-%05d" % b


def test_report_lines_are_put_together_once(spark, tmp_path):
    from fleetrisk.plans import report

    made = spark.sparkContext.accumulator(0)

    def line(k):
        made.add(1)
        return f"line {k}"

    lines = spark.range(50).select(F.lit("1").alias("scan_id"), F.lit(0).alias("section"), F.col("id").alias("k1"), F.lit(0).alias("k2"), F.lit(0).alias("k3"),
                                   F.udf(line, "string")("id").alias("line"))
    report.write_report(lines, str(tmp_path / "report"), 2)
    assert spark.read.text(str(tmp_path / "report")).count() == 50
    assert made.value == 50


def test_text_groups_are_dealt_by_part_once(spark):
    from fleetrisk.sources import derived

    lnk = spark.sql("""SELECT * FROM VALUES (1, 7L, 100L, DATE'1994-01-01', 'N', 'F'), (1, 7L, 100L, DATE'1994-01-01', 'R', 'F'),
        (1, 7L, 3L, DATE'1994-03-01', 'R', 'F'), (2, 7L, 5L, NULL, 'R', 'F'), (NULL, 8L, 5L, DATE'1994-01-01', NULL, 'F')
        AS t(scan_id, partkey, bucket, month_start, l_returnflag, l_linestatus)""")
    groups = derived.text_groups(lnk)
    found = {r["scan_id"]: (r["cves"], r["months"], r["_installed"]) for r in groups.collect()}
    assert found == {1: (["CVE-2024-00003", "CVE-2024-00100"], ["1994-Jan", "1994-Mar"], True), 2: (["CVE-2024-00005"], [], False),
                     None: (["CVE-2024-00005"], ["1994-Jan"], None)}
    plan = groups._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and "lambdafunction" not in plan, plan


def test_superseded_ids_by_cases(spark):
    from fleetrisk.sources import derived

    rows = spark.sql("SELECT * FROM VALUES (1L, 0), (2L, 0), (3L, 0), (4L, 9), (61L, 0), (62L, 1), (182L, 0), (NULL, 1), (5L, NULL) AS t(p, size)")
    sup = derived.supersedes_of(F.col("p"), F.col("size"))
    found = {(r["p"], r["size"]): r["s"] for r in rows.select("p", "size", sup.alias("s")).collect()}
    kb = lambda *parts: [f"KB{5_000_000 + p}" for p in parts]
    assert found == {(1, 0): kb(0, 2), (2, 0): kb(1), (3, 0): [], (4, 9): [], (61, 0): kb(60, 62), (62, 1): kb(60, 61), (182, 0): kb(181),
                     (None, 1): [], (5, None): []}


def test_link_is_saved_for_several_readers(spark, tmp_path):
    from fleetrisk.sources import derived

    spark.sql("SELECT 8L AS l_orderkey, 3L AS l_partkey, TIMESTAMP'1994-02-03 04:05:06' AS l_shipdate, 'N' AS l_returnflag, 'F' AS l_linestatus").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT 8L AS o_orderkey, 1L AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT 1L AS c_custkey, 9 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    plain, once = derived.link(spark, str(tmp_path)), derived.saved_link(spark, str(tmp_path))
    assert once.columns == plain.columns and once.collect() == plain.collect()
    assert (once.first()["kb_id"], once.first()["cve_id"], once.first()["month"]) == ("KB5000003", "CVE-2024-00001", "1994-Feb")
    assert "Join" not in once._jdf.queryExecution().optimizedPlan().toString()


def test_entries_are_ranked_as_text(spark, monkeypatch):
    entries = spark.createDataFrame([(1, "KB1", ["2031-Jan"], ["CVE-2031-0001"], [], None), (1, "KB2", [], [], ["KB1"], 'a "b"')],
                                    "scan_id int, kb_id string, months array<string>, cves array<string>, supersedes array<string>, update_type string")
    none = spark.createDataFrame([], "scan_id int, kb_id string")
    asked = spark.createDataFrame([(1, 1, "2031-Jan")], "scan_id int, pos int, month_id string")
    base = spark.createDataFrame([(1, "h", "x")], "scan_id int, host string, OsName string")
    seen, rank_within = [], scans.rank_within
    monkeypatch.setattr(scans, "rank_within", lambda rows, *rest: seen.append(rows.schema["entry"].dataType.simpleString()) or rank_within(rows, *rest))
    doc = json.loads(scans.scan_documents(entries, none, none, base, asked, F.lit("2031-06-01").cast("timestamp")).first()["document"])
    assert seen == ["string"]
    assert doc == {"Baseline": {"OsName": "x"}, "InstalledKbs": [], "MonthsRequested": ["2031-Jan"], "MonthsWithEntries": ["2031-Jan"], "MissingKbs": [],
                   "KbEntries": [{"KB": "KB1", "Months": ["2031-Jan"], "Cves": ["CVE-2031-0001"], "Supersedes": []},
                                 {"KB": "KB2", "Months": [], "Cves": [], "Supersedes": ["KB1"], "UpdateType": 'a "b"'}]}


def test_scans_are_exported_compressed(spark, tmp_path):
    """Compressed documents are read back like others, by both readers; a broken one is a row that isn't valid."""
    entries = spark.createDataFrame([(1, "KB1", ["2031-Jan"], ["CVE-2031-0002"], []), (1, "KB1", ["2031-Jan"], ["CVE-2031-0001"], []), (2, "KB2", [], [], ["KB1"])],
                                    "scan_id int, kb_id string, months array<string>, cves array<string>, supersedes array<string>").withColumn("update_type", F.lit("x"))
    own = spark.createDataFrame([(1, "KB1")], "scan_id int, kb_id string")
    asked = spark.createDataFrame([(1, 1, "2031-Jan")], "scan_id int, pos int, month_id string")
    base = spark.createDataFrame([(1, "h", "x"), (2, "i", "y")], "scan_id int, host string, OsName string")
    out = {}
    for packed in (False, True):
        path = str(tmp_path / str(packed))
        scans.export_scans(entries, own, own, base, asked, path, F.lit("2031-06-01 00:00:00").cast("timestamp"), packed=packed)
        names = sorted(f for _, _, files in os.walk(path) for f in files if not f.startswith("."))
        assert names == ["scan_20310601_000000.json" + ".gz" * packed] * 2
        docs = scan_files.read(spark, path, latest=True)
        out[packed] = sorted(map(str, scans.kb_entries(docs).collect())), sorted(r.scan_id for r in scans.read_scans(spark, path).where("valid").collect())
        assert [r.cves for r in scans.kb_entries(docs.where("host = '1'")).collect()] == [["CVE-2031-0001"], ["CVE-2031-0002"]]  # by their texts
    assert out[True] == out[False] and out[True][1] == ["1/scan_20310601_000000", "2/scan_20310601_000000"]
    broken = tmp_path / "True" / "1" / "scan_20310601_000000.json.gz"
    broken.write_bytes(broken.read_bytes()[:-9])
    assert {r.host: r.valid for r in scan_files.read(spark, str(tmp_path / "True")).select("host", "valid").collect()} == {"1": False, "2": True}
