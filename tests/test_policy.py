import pytest
from pyspark.sql import functions as F

from fleetrisk.operators import policy

COLS = ("cvss_score double, exploitation string, attack_vector string, privileges_required string, "
        "user_interaction string, confidentiality_impact string, integrity_impact string, "
        "availability_impact string, patch_age_days int")


def score(spark, *row):
    df = spark.createDataFrame([row], COLS)
    return policy.apply_policy(df).first()


@pytest.mark.parametrize("row, risk, drivers", [
    ((None, None, None, None, None, None, None, None, None), 0.0, ["baseline CVSS exposure"]),
    ((5.0, "Exploited:Yes", None, None, None, None, None, None, None), 7.0, ["exploitation signal"]),
    ((5.0, None, "n", None, None, None, None, None, None), 6.0, ["network attack vector"]),
    ((5.0, None, None, "N", None, None, None, None, None), 5.5, ["no privileges required"]),
    ((5.0, None, None, None, "N", None, None, None, None), 5.5, ["no user interaction"]),
    ((5.0, None, None, None, None, "L", "h", "L", None), 5.5, ["high impact"]),
    ((5.0, None, None, None, None, None, None, None, 89), 5.99, ["baseline CVSS exposure"]),
    ((5.0, None, None, None, None, None, None, None, 90), 6.0, ["patch age exposure"]),
    ((5.0, None, None, None, None, None, None, None, 181), 7.0, ["patch age exposure"]),
    ((5.0, None, None, None, None, None, None, None, -10), 5.0, ["baseline CVSS exposure"]),
    ((9.0, None, None, None, None, None, None, None, None), 9.0, ["critical CVSS"]),
    ((7.0, None, None, None, None, None, None, None, None), 7.0, ["high CVSS"]),
])
def test_each_bonus(spark, row, risk, drivers):
    r = score(spark, *row)
    assert r["policy_risk"] == pytest.approx(risk)
    assert r["policy_drivers"] == drivers
    assert r["top_driver"] == drivers[0]


def test_priority_thresholds(spark):
    df = spark.createDataFrame([(5.99,), (6.0,), (8.99,), (9.0,)], "r double")
    got = [x[0] for x in df.select(policy.priority_label(F.col("r"))).collect()]
    assert got == ["Low", "Medium", "Medium", "High"]


def test_all_drivers_order(spark):
    r = score(spark, 9.8, "Exploited:Yes", "N", "N", "N", "H", "H", "H", 400)
    assert r["policy_risk"] == pytest.approx(9.8 + 2 + 1 + 0.5 + 0.5 + 0.5 + 2.0)
    assert r["policy_drivers"] == ["critical CVSS", "exploitation signal", "network attack vector",
                                   "no privileges required", "no user interaction", "high impact",
                                   "patch age exposure"]
    assert r["policy_priority"] == "High"


def test_validate_and_counters(spark):
    df = spark.createDataFrame([
        ("kb1", "cve-2024-0001", "2026-Jan", 5.0, "N"),
        ("KB1 ", "CVE-2024-0001", "2026-Jan", 5.0, "N"),     # duplicate after normalisation
        ("KB1", "CVE-24-1", "2026-Jan", 5.0, "N"),           # not a CVE id
        ("KB1", "CVE-2024-0002", "2026-Jan", None, "N"),     # missing score
        ("KB1", "CVE-2024-0003", "2026-Jan", 5.0, None),     # missing vector
    ], "kb_id string, cve_id string, month string, cvss_score double, attack_vector string")
    v = policy.validate(df)
    assert [(r.kb_id, r.cve_id) for r in v.collect()] == [("KB1", "CVE-2024-0001")]
    c = {r.metric: r.value for r in policy.validation_counters(df).collect()}
    assert c == {"rows_before": 5, "non_cve_rows_removed": 1, "rows_missing_required_fields": 2,
                 "rows_after": 1, "duplicate_rows_removed": 1, "rows_dropped": 4}
    rej = {r.cve_id: r.reject_reason for r in policy.rejected(df).collect()}
    assert rej == {"CVE-24-1": "not a CVE id", "CVE-2024-0002": "missing required field",
                   "CVE-2024-0003": "missing required field"}


def test_ensure_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    out = policy.ensure_columns(df, {"a": "int", "attack_vector": "string"})
    assert out.columns == ["a", "attack_vector"] and out.first()["attack_vector"] is None


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

metric = st.sampled_from([None, "N", "n", "L", "H", "h", "R", " N "])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.floats(0, 10).map(lambda x: round(x, 1))),
                          st.sampled_from([None, "Exploited:Yes", "Exploited:No"]), metric, metric, metric,
                          metric, metric, metric, st.one_of(st.none(), st.integers(-400, 400))),
                min_size=1, max_size=20))
def test_score_bounds(spark, rows):
    out = policy.apply_policy(spark.createDataFrame(rows, COLS)).collect()
    for r in out:
        base = r.cvss_score or 0.0
        assert base - 1e-9 <= r.policy_risk <= base + 6.5 + 1e-9
        assert r.policy_priority in ("High", "Medium", "Low") and len(r.policy_drivers) >= 1
