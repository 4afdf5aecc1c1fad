import os
import random

import pytest
from pyspark.sql import functions as F

from fleetrisk.operators import closure, correlate, flatten

ENTRY = "scan_id string, kb_id string, months array<string>, cves array<string>, supersedes array<string>, update_type string"
SMOKE = "/root/testdata/sf0.001"


def entries(spark, data):
    return spark.createDataFrame(data, ENTRY)


def test_flatten_cases(spark):
    e = entries(spark, [
        ("s1", "kb1", ["2026-Jan", "2026-Feb"], ["CVE-2024-0001", "cve-2024-0001", "bad"], [], None),
        ("s1", "KB2", [], ["CVE-2024-0002"], [], None),             # no months -> skipped
        ("s1", "KB3", ["2026-Jan"], [], [], None),                  # no CVEs -> skipped
        ("s1", None, ["2026-Jan"], ["CVE-2024-0003"], [], None),    # no KB -> skipped
        ("s2", "KB1", ["2026-Jan "], ["CVE-2024-0001"], [], None),  # same triple in another scan
    ])
    raw = flatten.flatten(e)
    assert raw.count() == 5  # 2 valid CVE occurrences x 2 months + 1
    d = flatten.dedupe(raw)
    assert sorted(tuple(r) for r in d.collect()) == [("KB1", "CVE-2024-0001", "2026-Feb"),
                                                      ("KB1", "CVE-2024-0001", "2026-Jan")]
    c = {r.metric: r.value for r in flatten.flatten_counters(e, d).collect()}
    assert c["raw_rows_created"] == 5 and c["rows_created"] == 2 and c["duplicate_rows_removed"] == 3
    assert c["skipped_kb_entries"] == 3 and c["skipped_non_cve_ids"] == 1


def test_runtime_restriction(spark):
    e = entries(spark, [("s1", "KB1", ["m"], ["CVE-2024-0001"], [], None),
                        ("s1", "KB2", ["m"], ["CVE-2024-0002"], [], None)])
    missing = spark.createDataFrame([("s1", " kb2 ")], "scan_id string, kb_id string")
    out = flatten.flatten(e, missing)
    assert [r.kb_id for r in out.collect()] == ["KB2"]
    c = {r.metric: r.value for r in flatten.flatten_counters(e, flatten.dedupe(out, flatten.RUNTIME_KEYS), missing).collect()}
    assert c["skipped_not_missing"] == 1 and c["missing_kbs_total"] == 1


def edges_df(spark, edges):
    return spark.createDataFrame(edges, "scan_id string, src string, dst string")


def roots_df(spark, roots):
    return spark.createDataFrame(roots, "scan_id string, kb_id string")


def reach(spark, edges, roots, **kw):
    out = closure.closure(edges_df(spark, edges), roots_df(spark, roots), **kw)
    return sorted(tuple(r) for r in out.collect())


def test_closure_shapes(spark):
    # chain a->b->c, diamond d->e,d->f,e->g,f->g, self loop h->h, two-cycle i<->j through root i
    edges = [("s", "A", "B"), ("s", "B", "C"), ("s", "D", "E"), ("s", "D", "F"), ("s", "E", "G"),
             ("s", "F", "G"), ("s", "H", "H"), ("s", "I", "J"), ("s", "J", "I"), ("t", "A", "Z")]
    got = reach(spark, edges, [("s", "A"), ("s", "D"), ("s", "H"), ("s", "I"), ("s", "X")])
    assert got == sorted([("s", "A", "B"), ("s", "A", "C"), ("s", "D", "E"), ("s", "D", "F"), ("s", "D", "G"),
                          ("s", "H", "H"), ("s", "I", "J"), ("s", "I", "I")])


def test_two_roots_and_status(spark):
    e = entries(spark, [("s", "KB3", ["m"], ["CVE-2024-0001"], ["KB1"], "Superseding"),
                        ("s", "KB2", ["m"], ["CVE-2024-0001"], ["KB1"], "Superseding"),
                        ("s", "KB1", ["m"], ["CVE-2024-0002"], [], "Standalone"),
                        ("s", "KB4", ["m"], ["CVE-2024-0003"], [], "Standalone")])
    inst = roots_df(spark, [("s", "KB2"), ("s", "KB3"), ("s", "KB9")])
    c = correlate.correlate(e, inst)
    status = {r.kb_id: r.status for r in c["status"].collect()}
    assert status == {"KB1": "Superseded by KB2, KB3", "KB2": "Installed", "KB3": "Installed", "KB4": "Missing"}
    assert sorted(r.kb_id for r in c["missing"].collect()) == ["KB4"]
    s = c and correlate.scan_summary(c).first()
    assert (s.expected_kbs, s.installed_kbs, s.logical_present_kbs, s.superseded_mappings, s.missing_kbs) == (4, 3, 4, 1, 1)


def bfs(edges, roots):
    adj = {}
    for s, a, b in edges:
        adj.setdefault((s, a), set()).add(b)
    out = set()
    for s, r in roots:
        seen, stack = {r}, [r]
        while stack:
            cur = stack.pop()
            for nxt in adj.get((s, cur), ()):
                out.add((s, r, nxt))
                if nxt not in seen:
                    seen.add(nxt)
                    stack.append(nxt)
    return sorted(out)


def test_closure_matches_bfs_on_random_graphs(spark):
    rnd = random.Random(7)
    edges, roots = set(), set()
    for scan in ("s1", "s2", "s3"):
        nodes = [f"K{i}" for i in range(30)]
        for _ in range(45):
            edges.add((scan, rnd.choice(nodes), rnd.choice(nodes)))
        for n in rnd.sample(nodes, 5):
            roots.add((scan, n))
    want = bfs(edges, roots)
    assert reach(spark, sorted(edges), sorted(roots)) == want
    # one hop a job, with block merges, and without broadcast edges
    assert reach(spark, sorted(edges), sorted(roots), hops=1, merge_every=2) == want
    assert reach(spark, sorted(edges), sorted(roots), hops=3, broadcast_bytes=0) == want
    # present + missing covers expected, and they are disjoint
    data = [(s, k, [], ["CVE-2024-0001"], sorted({b for (s2, a, b) in edges if s2 == s and a == k}), None)
            for s in ("s1", "s2", "s3") for k in [f"K{i}" for i in range(30)]]
    c = correlate.correlate(entries(spark, data), roots_df(spark, sorted(roots)))
    expected = {tuple(r) for r in c["expected"].collect()}
    present = {tuple(r) for r in c["present"].collect()}
    missing = {tuple(r) for r in c["missing"].collect()}
    assert expected <= present | missing and not (present & missing)


def test_merge_and_product_map(spark):
    b = spark.createDataFrame([
        ("s", " kb1", ["2026-Feb"], ["CVE-2024-0001"], ["kb9"]),
        ("s", "KB1", ["2026-Jan", "2026-Feb"], ["CVE-2024-0002"], None),
    ], "scan_id string, kb_id string, months array<string>, cves array<string>, supersedes array<string>")
    m = correlate.merge_entries(b).first()
    assert (m.kb_id, m.months, m.cves, m.supersedes, m.update_type) == (
        "KB1", ["2026-Feb", "2026-Jan"], ["CVE-2024-0001", "CVE-2024-0002"], ["KB9"], "Superseding")
    rows = spark.createDataFrame([
        ("s", "2026-Jan", "Windows 11 Version 24H2 for x64-based Systems", ["5001"], "CVE-2024-0001", "4999"),
        ("s", "2026-Feb", "windows 11 version 24h2 for x64-based systems", ["KB5001"], "CVE-2024-0002", None),
        ("s", "2026-Feb", "Windows 10", ["5002"], "CVE-2024-0003", None),
    ], "scan_id string, month string, full_product_name string, kb_articles array<string>, cve string, supercedence string")
    kb = correlate.product_kb_map(rows, "Windows 11 Version 24H2 for x64-based Systems").collect()
    assert len(kb) == 1 and kb[0].kb_id == "KB5001" and kb[0].supersedes == ["KB4999"]
    assert kb[0].months == ["2026-Feb", "2026-Jan"] and kb[0].cves == ["CVE-2024-0001", "CVE-2024-0002"]


def test_equal_edge_sets_are_closed_once(spark):
    chain = [("KB5", "KB4"), ("KB4", "KB3"), ("KB3", "KB5"), ("KB2", "KB1")]
    edges = [(s, a, b) for s in ("s1", "s2", "s3", "s4") for a, b in (chain if s != "s2" else reversed(chain))] + [("s5", "KB5", "KB4")]
    roots = [("s1", "KB4"), ("s2", "KB4"), ("s3", "KB2"), ("s4", "KB4"), ("s4", "KB7"), ("s5", "KB9"), ("s6", "KB5")]
    r = closure.Reachability(edges_df(spark, edges), roots_df(spark, roots))
    graphs = {x.scan_id: x.graph for x in r.graph_of.collect()}
    assert set(graphs) == {"s1", "s2", "s3", "s4", "s5"} and len(set(graphs.values())) == 2
    assert r.edges.count() == 4 + 1
    profiles = {x.scan_id: x.profile for x in r.profile_of.collect()}
    # KB7 replaces nothing, so s4 is as s1; s5 and s6 have no root
    assert set(profiles) == {"s1", "s2", "s3", "s4"} and len(set(profiles.values())) == 2 and profiles["s1"] == profiles["s2"] == profiles["s4"]
    assert r._present.count() == 3 + 1 and r._pairs.count() == 3 + 1
    want = bfs(edges, roots)
    assert sorted(map(tuple, r.pairs().collect())) == want
    assert sorted(map(tuple, r.reached().collect())) == sorted({(s, k) for s, _, k in want})
    lists = {(x.scan_id, x.kb_id): x.replaced_by for x in r.roots_of().collect()}
    assert lists == {(s, k): sorted(a for s2, a, b in want if (s2, b) == (s, k)) for s, _, k in want}


def test_long_paths_and_dense_graphs(spark):
    """A path of 100 edges takes 100 / hops jobs; a dense graph has 2 ** 40 paths but each hop is deduplicated."""
    path = [("s", f"K{i}", f"K{i + 1}") for i in range(100)]
    dense = [("t", f"K{i}", f"K{j}") for i in range(42) for j in range(i)]
    r = closure.Reachability(edges_df(spark, path + dense), roots_df(spark, [("s", "K0"), ("t", "K41")]), hops=12, merge_every=3)
    got = r.reached().groupBy("scan_id").count().collect()
    assert {x.scan_id: x["count"] for x in got} == {"s": 100, "t": 41}
    with pytest.raises(RuntimeError):
        closure.Reachability(edges_df(spark, path), roots_df(spark, [("s", "K0")]), max_jobs=2).reached().collect()


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="test tables not present")
def test_closure_hops_agree_on_tables(spark):
    from fleetrisk.sources import derived as dv
    groups = dv.entry_groups(dv.link(spark, SMOKE))
    edges = closure.edges_from_entries(dv.kb_entries(spark, SMOKE, groups=groups))
    roots = dv.installed(spark, SMOKE, groups=groups)
    plain = sorted(map(tuple, closure.closure(edges, roots).collect()))
    assert plain and plain == sorted(map(tuple, closure.closure(edges, roots, hops=2, merge_every=3).collect()))


def test_scope_counts_builds_the_rows_once(spark):
    entries = spark.createDataFrame([(1, "KB1", ["2024-Jan", "2024-Feb"], ["CVE-2024-0001", "CVE-2024-0002"]), (2, "KB1", ["2024-Jan"], ["CVE-2024-0001"])],
                                    "scan_id int, kb_id string, months array<string>, cves array<string>")
    out = flatten.scope_counts(flatten.dedupe(flatten.flatten(entries)))
    assert tuple(out.first()) == (1, 2, 2, 4)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_cached_edges_keep_their_order(spark):
    """A merge join on the keys of a cached side neither shuffles nor sorts that side."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        edges = spark.range(200).selectExpr("id % 3 AS graph", "concat('KB', id) AS kb_id", "concat('KB', id + 1) AS dst")
        steps, n = closure._co_partitioned(edges, 4, ["graph", "kb_id"])
        assert n == 200
        joined = edges.select("graph", "kb_id").hint("merge").join(steps, ["graph", "kb_id"])
        assert joined.count() == 200
        plan = joined._jdf.queryExecution().executedPlan().toString().split("(1) Final")[0]
        assert plan.split("InMemoryTableScan")[0].count("Sort ") == 1, plan
        steps.unpersist()
    finally:
        spark.conf.set(key, before)


def test_status_joins_move_no_arrays(spark):
    from fleetrisk.operators import correlate
    entries = spark.createDataFrame([(1, "KB1", ["2024-Jan"], ["CVE-2024-0001"], ["KB2"], None), (1, "KB2", None, None, None, "Standalone")],
                                    "scan_id int, kb_id string, months array<string>, cves array<string>, supersedes array<string>, update_type string")
    status = correlate.correlate(entries, spark.createDataFrame([(1, "KB1")], "scan_id int, kb_id string"))["status"]
    assert sorted(map(tuple, status.collect())) == [(1, "KB1", "Mapped", "Installed", "2024-Jan", 1), (1, "KB2", "Standalone", "Superseded by KB1", "-", 0)]
    plan = status._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("size(cves") > plan.index("Join"), plan
