import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetrisk.operators import match, rank, text


SCORED = ("scan_id string, kb_id string, cve_id string, month string, policy_risk double, policy_priority string, "
          "top_driver string, policy_drivers array<string>")


def test_rollup_ties_and_priorities(spark):
    df = spark.createDataFrame([
        ("s", "KB1", "CVE-2024-0002", "2026-Jan", 7.0, "Medium", "high CVSS", ["high CVSS"]),
        ("s", "KB1", "CVE-2024-0001", "2026-Feb", 7.0, "Medium", "network attack vector", ["network attack vector"]),
        ("s", "KB1", "CVE-2024-0001", "2026-Jan", 7.0, None, "x", ["x", "y"]),
        ("s", "KB2", "CVE-2024-0003", "2026-Jan", 7.0, "Low", "y", ["y"]),
    ], SCORED)
    r = {x.kb_id: x for x in rank.kb_rollup(df).collect()}
    assert r["KB1"].cve_count == 3 and r["KB1"].policy_priority == "Medium"
    # tie on risk -> (cve_id, month) ascending; month ids compare as text, so 2026-Feb < 2026-Jan
    assert (r["KB1"].top_driver, r["KB1"].review_reason) == ("network attack vector", "network attack vector")
    ranked = {x.kb_id: x["rank"] for x in rank.rank_kbs(rank.kb_rollup(df)).collect()}
    assert ranked == {"KB1": 1, "KB2": 2}                                   # equal risk -> kb order


def test_highest_priority_unknown(spark):
    df = spark.createDataFrame([("a", None), ("a", "Low"), ("b", None)], "k string, p string")
    got = {r.k: r.h for r in df.groupBy("k").agg(rank.highest_priority("p").alias("h")).collect()}
    assert got == {"a": "Low", "b": "Unknown"}


def test_mode_lowest_on_ties(spark):
    df = spark.createDataFrame([("s", "KB1", "C1", "m", 1.0, "Low", "d", ["d"], 3.0, "Low", 3),
                                ("s", "KB1", "C2", "m", 1.0, "Low", "d", ["d"], 3.0, "High", 1)],
                               SCORED + ", ml_risk double, ml_priority string, cluster int")
    r = rank.kb_rollup(df, with_ml=True).first()
    assert (r.cluster, r.ml_priority, r.ml_risk) == (1, "High", 3.0)


def test_rank_within_matches_window(spark):
    rnd = random.Random(3)
    data = [(("hot" if rnd.random() < 0.6 else f"g{rnd.randint(0, 5)}"), f"k{i}", float(rnd.randint(0, 20)))
            for i in range(3000)]
    df = spark.createDataFrame(data, "g string, k string, v double").repartition(7)
    order = [F.col("v").desc(), F.col("k").asc()]
    ours = rank.rank_within(df, ["g"], order, num_partitions=9)
    ref = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert sorted(tuple(r) for r in ours.select("g", "k", "rank").collect()) == \
        sorted(tuple(r) for r in ref.select("g", "k", "rank").collect())
    glob = rank.rank_within(df, [], order, num_partitions=5)
    assert sorted(r["rank"] for r in glob.collect()) == list(range(1, 3001))


def test_cve_preview_hidden(spark):
    data = [("s", "KB1", f"CVE-2024-{i:04d}", "m", float(i), "Low", "d", ["d"]) for i in range(13)]
    out = rank.cve_preview(spark.createDataFrame(data, SCORED)).collect()
    assert len(out) == 10 and {r.hidden_count for r in out} == {3}
    assert min(r.policy_risk for r in out) == 3.0


TGT = "kb_id string, windows_gen string, display_version string, build_major string, catalog_arch string"
CAND = "update_id string, title string, candidate_pos int"


def test_candidate_scoring(spark):
    t = spark.createDataFrame([("KB500", "windows 11", "24h2", "26100", "x64"),
                               ("KB777", "windows 11", "", "", "x64"),
                               ("KB888", "windows 11", "24h2", "26100", "x64")], TGT)
    c = spark.createDataFrame([
        ("id1", "2026-01 Cumulative Update for Windows 11 Version 24H2 for x64-based Systems (KB5001234) (26100.1)", 0),
        ("id2", "Cumulative Update for Windows Server 2025 for x64-based Systems (KB5001234)", 1),
        ("id3", "Cumulative Update for Windows 11 Version 23H2 for arm64-based Systems (KB777)", 2),
        ("id4", "Cumulative Update for Windows 11 Version 23H2 for x64-based Systems (KB777) (22631.1)", 3),
        ("id5", "Update for Windows 11 (KB777)", 4),
    ], CAND)
    s = {(r.kb_id, r.update_id): r.score for r in match.score_candidates(t, c).collect()}
    assert s[("KB500", "id1")] == 50 + 40 + 25 + 25 + 10       # KB500 is a substring of KB5001234
    assert s[("KB500", "id2")] == match.REJECT_SCORE           # server
    assert s[("KB777", "id3")] == match.REJECT_SCORE           # wrong architecture
    assert s[("KB777", "id4")] == 50 + 40 + 25                 # no version / build set: no penalty
    assert s[("KB777", "id5")] == 90
    best = {r.kb_id: r for r in match.best_candidates(t, match.score_candidates(t, c)).collect()}
    assert best["KB500"].update_id == "id1"
    assert best["KB777"].update_id == "id4" and best["KB777"].candidates_matching == 2
    assert best["KB888"].reason == match.NO_CANDIDATE_REASON


def test_ambiguous_and_tie(spark):
    t = spark.createDataFrame([("KB1", "windows 11", "", "", "x64")], TGT)
    c = spark.createDataFrame([("a", "Windows 10 or 11 thing KB1 for x64-based", 0),
                               ("b", "Update KB1 x64-based", 1), ("c", "Update KB1 (x64-based)", 2)], CAND)
    best = match.best_candidates(t, match.score_candidates(t, c)).first()
    assert best.update_id is None and best.best_score == 75.0
    assert best.reason == "Ambiguous match below confidence threshold (75)"
    top = [r.update_id for r in match.top_candidates(match.score_candidates(t, c)).orderBy("pos").collect()]
    assert top == ["b", "c"]                                    # tie -> catalog order


HTML = """<html><table id="ctl00_catalogBody_updateMatches">
<tr id="headerRow"><td>x</td></tr>
<tr id="0a1b2c3d-0000-4000-8000-00000000abcd_R1"><td></td><td><a> 2026-01 Cumulative
 Update (KB5001234) </a></td><td>Windows 11</td><td>Security Updates</td><td>1/13/2026</td><td>n/a</td>
 <td>1.2 GB</td><td>x</td></tr>
<tr id="bad_R2"><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td><td>6</td><td>7</td><td>8</td></tr>
<tr id="0a1b2c3d-0000-4000-8000-00000000abce_R3"><td>too few</td></tr>
</table>
<a href="https://dl.example.com/a/windows11-kb5001234-x64.msu?x=1">a</a>
<a href="https://dl.example.com/a/windows11-kb5001234-x64.msu?x=1">again</a>
<a href="http://dl.example.com/b/b.CAB">b</a></html>"""


def test_text_extraction(spark):
    pages = spark.createDataFrame([(1, HTML)], "page_id long, html string")
    rows = text.result_rows(pages).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.update_id == "0a1b2c3d-0000-4000-8000-00000000abcd"
    assert (r.title, r.products, r.classification, r.last_updated, r.version, r.size) == (
        "2026-01 Cumulative Update (KB5001234)", "Windows 11", "Security Updates", "1/13/2026", "n/a", "1.2 GB")
    urls = [(u.pos, u.url, u.file_name) for u in text.extract_urls(pages).orderBy("pos").collect()]
    assert urls == [(0, "https://dl.example.com/a/windows11-kb5001234-x64.msu?x=1", "windows11-kb5001234-x64.msu"),
                    (1, "http://dl.example.com/b/b.CAB", "b.CAB")]


def test_result_rows_follow_markup(spark):
    """Nested tables, single quotes, entities and unclosed cells are read as a browser does."""
    update = "0a1b2c3d-0000-4000-8000-00000000abcd"
    page = (f"<table id='other'><tr id='{update}_R0'>" + "<td>x</td>" * 8 + "</tr></table>"
            f"<TABLE class=a id='{text.RESULT_TABLE_ID}'><tr id='{update}_R7'><td><td><table><tr><td>A &#38; B</td></tr></table>"
            "<td>p&#x2014;q<td>c<td>d<td>v<td>s<td>last</tr></TABLE>")
    pages = spark.createDataFrame([(1, page, "u"), (2, None, "u"), (3, "<table", "u")], "page_id long, html string, title string")
    rows = text.result_rows(pages).collect()
    assert [(r.page_id, r.candidate_pos, r.update_id, r.title, r.products, r.size) for r in rows] == [(1, 0, update, "A & B", "p\u2014q", "s")]


def test_title_keys_have_target_lengths_only(spark):
    df = spark.createDataFrame([("Update (KB5001234)",)], "title string")
    keys = df.select(match.title_kb_keys(F.col("title"), [7]).alias("k")).first().k
    assert keys == ["KB5001234"] and len(df.select(match.title_kb_keys(F.col("title")).alias("k")).first().k) == 7


def test_nested_lists_close_in_segments(spark):
    """One KB with a million CVE rows: its list is gathered in several tasks, in order, and nothing is lost."""
    n, size = 1_000_000, 150_000
    scored = spark.range(n, numPartitions=8).select(
        F.lit("s").alias("scan_id"), F.lit("KB1").alias("kb_id"), F.format_string("CVE-2024-%07d", F.col("id")).alias("cve_id"),
        F.lit("2024-Jan").alias("month"), (F.col("id") % 90 / 10).alias("policy_risk"), F.lit("Low").alias("policy_priority"),
        F.lit("d").alias("top_driver"), F.array(F.lit("d")).alias("policy_drivers"))
    ranking = spark.createDataFrame([("s", "KB1", 1), ("s", "KB2", 2)], "scan_id string, kb_id string, rank int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # at this size all would share a task
    try:
        out = rank.nested_ranking(ranking, scored, segment_rows=size).checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = {r.segment: r.n for r in out.where("kb_id = 'KB1'").select("segment", F.size("cves").alias("n")).collect()}
    assert sizes == {k: size for k in range(6)} | {6: n - 6 * size} and out.where("kb_id = 'KB2'").first().cves is None
    parts = out.where("kb_id = 'KB1'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1
    edge = out.where("kb_id = 'KB1'").select("segment", F.col("cves")[0]["policy_risk"].alias("a"), F.element_at("cves", -1)["policy_risk"].alias("b")).orderBy("segment").collect()
    assert all(x.a >= x.b for x in edge) and all(x.b >= y.a for x, y in zip(edge, edge[1:]))
    assert out.select(F.explode_outer("cves").alias("c")).select(F.countDistinct("c.cve_id")).first()[0] == n


def test_pairs_are_never_broadcast_by_estimate(spark, tmp_path):
    """Derived titles look small to Spark's estimate; neither the pairs nor the best of each target may go to the driver."""
    spark.range(2000).select(F.col("id").alias("p")).write.parquet(str(tmp_path / "p"))
    part = spark.read.parquet(str(tmp_path / "p"))
    kb = F.concat(F.lit("KB"), (F.lit(5000000) + F.col("p")).cast("string"))
    targets = part.select(kb.alias("kb_id"), *[F.lit(v).alias(c) for c, v in (
        ("windows_gen", "windows 11"), ("display_version", "22h2"), ("build_major", "19000"), ("catalog_arch", "x64"))])
    candidates = part.select(F.col("p").cast("string").alias("update_id"), F.concat(F.lit("Windows 11 ("), kb, F.lit(")")).alias("title"), F.lit(0).alias("candidate_pos"))
    scored = match.score_candidates(targets, candidates)
    for df in (scored, match.top_candidates(scored), match.best_candidates(targets, scored)):
        assert df.count() == 2000
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_result_rows_come_in_bounded_batches(spark, monkeypatch):
    """Many pages in one task: no batch holds them all."""
    row = "<tr id='{0:08d}-0000-4000-8000-{1:012d}_R1'>" + "<td>x</td>" * 8 + "</tr>"
    pages = spark.createDataFrame([(p, f'<table id="{text.RESULT_TABLE_ID}">' + "".join(row.format(p, k) for k in range(40)) + "</table>") for p in range(5000)],
                                  "page_id long, html string").coalesce(1)
    sizes = text.result_rows(pages).mapInArrow(lambda bs: bs, "page_id long, candidate_pos int, update_id string, " + ", ".join(f"{c} string" for c in text.CANDIDATE_FIELDS))
    assert sizes.select("update_id").distinct().count() == 200_000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20

    held = []

    class Frame:
        sparkSession = spark

        def select(self, *cols):
            return self

        schema = pages.select("html", "page_id").schema

        def mapInArrow(self, run, schema):
            import pyarrow as pa
            html = [r.html for r in pages.select("html").limit(500).collect()]
            batch = pa.RecordBatch.from_arrays([pa.array(html), pa.array(range(500))], names=["__html", "page_id"])
            held.extend(b.num_rows for b in run([batch]))

    text.result_rows(Frame())
    assert sum(held) == 20_000 and max(held) < text.ROWS_HELD + 41


def test_preview_reads_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def risk(k):
        made.add(1)
        return float(k)

    rows = spark.range(12).select(F.lit(1).alias("scan_id"), F.lit("KB1").alias("kb_id"), F.col("id").cast("string").alias("cve_id"), F.lit("m").alias("month"),
                                  F.udf(risk, "double")("id").alias("policy_risk"))
    out = rank.cve_preview(rows).collect()
    assert sorted(r.cve_id for r in out) == sorted(str(k) for k in range(2, 12)) and {r.hidden_count for r in out} == {2}
    assert made.value == 12


def test_rollup_sorts_by_kb_first(spark):
    df = spark.createDataFrame([("s", "KB1", "CVE-2024-0001", "m", 1.0, "Low", "d", ["d"]), ("t", "KB1", "CVE-2024-0001", "m", 2.0, "Low", "d", ["d"])], SCORED)
    out = rank.kb_rollup(df)
    assert out.columns[:3] == ["scan_id", "kb_id", "policy_risk"] and sorted((r.scan_id, r.policy_risk) for r in out.collect()) == [("s", 1.0), ("t", 2.0)]
    assert "Sort [kb_id" in out._jdf.queryExecution().executedPlan().toString()


def test_dimension_beyond_the_bound_is_hashed_by_partition(spark):
    from fleetrisk.operators import joins

    fact = spark.range(50).selectExpr("id % 7 AS k", "id")
    dim = spark.range(5).selectExpr("id AS k", "id * 2 AS v")
    size = joins.measured_bytes(dim)
    plan = lambda side: fact.join(side, "k", "left")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan(joins.sized(dim, size))
    assert "ShuffledHashJoin" in plan(joins.sized(dim, size - 1))
    assert "ShuffledHashJoin" not in plan(joins.sized(dim, 1))
    assert sorted(map(tuple, fact.join(joins.sized(dim, size - 1), "k", "left").collect()), key=str) == sorted(
        ((i % 7, i, 2 * (i % 7) if i % 7 < 5 else None) for i in range(50)), key=str)


def test_kbs_that_fit_a_task_are_nested_after_one_shuffle(spark, monkeypatch):
    """Same rows as by the distributed rank, and no shuffle but that by KB."""
    scored = spark.range(60).select(
        F.when(F.col("id") % 2 == 0, "s").otherwise("t").alias("scan_id"), F.concat(F.lit("KB"), (F.col("id") % 7).cast("string")).alias("kb_id"),
        F.format_string("CVE-2024-%05d", F.col("id")).alias("cve_id"), F.lit("2024-Jan").alias("month"), (F.col("id") % 5 / 2).alias("policy_risk"),
        F.lit("Low").alias("policy_priority"), F.lit("d").alias("top_driver"), F.array(F.lit("d"), F.lit("e")).alias("policy_drivers"))
    ranking = rank.saved(scored.groupBy("scan_id", "kb_id").agg(F.count("*").alias("cve_count")).withColumn("rank", F.lit(1)).unionByName(
        spark.sql("SELECT 's' AS scan_id, 'KB99' AS kb_id, 0L AS cve_count, 9 AS rank")))
    scored, threshold = rank.saved(scored), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = rank.nested_ranking(ranking, scored, segment_rows=2)
        plan = small._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Exchange hashpartitioning") == plan.count("Exchange") == 2, plan  # the rows and the ranking, by KB
        monkeypatch.setattr(rank, "GROUP_ROWS", 3)
        large = rank.nested_ranking(ranking.drop("cve_count"), scored, segment_rows=2)
        found = [sorted((r.scan_id, r.kb_id, r.segment, r["rank"], str(r.cves)) for r in df.collect()) for df in (small, large)]
        assert found[0] == found[1] and len(found[0]) > 2 * 14 and ("s", "KB99", 0, 9, "None") in found[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_report_lines_of_small_and_large_kbs_are_the_same(spark, monkeypatch):
    from fleetrisk.plans import report

    scored = spark.range(40).select(
        F.lit(1).alias("scan_id"), F.concat(F.lit("KB"), (F.col("id") % 3).cast("string")).alias("kb_id"), F.format_string("CVE-2024-%05d", F.col("id")).alias("cve_id"),
        F.lit("2024-Jan").alias("month"), (F.col("id") % 5 / 2).alias("policy_risk"), F.lit("Low").alias("policy_priority"), F.lit("d").alias("top_driver"),
        F.array(F.lit("d")).alias("policy_drivers"), F.lit("never shown").alias("vendor"))
    ranking = rank.saved(rank.rank_kbs(rank.kb_rollup(scored)))
    seen, within = [], rank.rank_within
    monkeypatch.setattr(rank, "rank_within", lambda rows, *rest: seen.append(rows.columns) or within(rows, *rest))
    lines = []
    for most in (100, 3):
        monkeypatch.setattr(rank, "GROUP_ROWS", most)
        lines.append(sorted(map(tuple, report.scan_report(ranking, scored, rank.ranking_summary(ranking)).collect())))
    assert lines[0] == lines[1] and sum("| CVE-2024" in line[-1] for line in lines[0]) == 40
    assert len(seen) == 1 and "vendor" not in seen[0]  # only the second time, and without columns that no line shows
