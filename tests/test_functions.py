from pyspark.sql import functions as F

from fleetrisk.functions import cvss, display, ids, months, platform
from tests.conftest import rows


def one(spark, value, expr, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr(F.col("v")).alias("o")).first()["o"]


def test_normalise_id(spark):
    assert one(spark, None, ids.normalise_id) is None
    assert one(spark, "  ", ids.normalise_id) == ""
    assert one(spark, "\tkb123\t", ids.normalise_id) == "KB123"
    assert one(spark, "cve-2024-0001 ", ids.normalise_id) == "CVE-2024-0001"


def test_is_cve_id(spark):
    cases = {"CVE-2024-12345": True, "cve-2024-0001 ": True, "CVE-2024-123": False,
             "CVE-24-1234": False, "CVE-2024-1234-5": False, None: False, "": False}
    for value, expected in cases.items():
        assert one(spark, value, ids.is_cve_id) is expected, value


def test_loose_cve(spark):
    assert one(spark, " cve-1 ", ids.loose_cve_id) == "CVE-1"
    assert one(spark, "XCVE-1", ids.loose_cve_id) is None


def test_kb_extraction(spark):
    assert one(spark, "KB 123", ids.kb_id_loose) is None
    assert one(spark, "kb5001234", ids.kb_id_loose) == "KB5001234"
    assert one(spark, "Update 5001234 x", ids.kb_id_loose) == "KB5001234"
    assert one(spark, "1234567890", ids.kb_id_loose) == "KB12345678"
    assert one(spark, "Package_for_kb5001234~31bf", ids.kb_id_strict) == "KB5001234"
    assert one(spark, "5001234", ids.kb_id_strict) is None


def test_month_list(spark):
    assert one(spark, "2026-Feb, 2026-Jan  2026-Feb,,", ids.month_list) == ["2026-Feb", "2026-Jan"]
    assert one(spark, None, ids.month_list) == []


def test_safe_double_and_metric(spark):
    assert one(spark, "abc", ids.safe_double) == 0.0
    assert one(spark, "NaN", ids.safe_double) == 0.0
    assert one(spark, " 7.5 ", ids.safe_double) == 7.5
    assert one(spark, None, ids.safe_string) == ""
    assert one(spark, " n ", lambda c: ids.metric_is(c, "N")) is True
    assert one(spark, None, lambda c: ids.metric_is(c, "N")) is False


def test_cvss_parse(spark):
    df = spark.createDataFrame(
        [(1, None), (2, ""), (3, "AV:N/AC:L"), (4, "CVSS:3.1/AV:N/AV:L"), (5, "CVSS:3.1/AVN/AC:H"),
         (6, "CVSS:3.1/AC:L"), (7, "CVSS:3.1/A:x:y"), (8, "CVSS:3.1/XAV:N")], "id int, v string")
    out = df.select("id", *[c.alias(n) for n, c in cvss.parse_cvss(F.col("v")).items()]).orderBy("id")
    got = {r["id"]: r for r in out.collect()}
    assert got[1]["attack_vector"] is None and got[2]["attack_vector"] is None
    assert got[3]["attack_vector"] == "N" and got[3]["attack_complexity"] == "L"
    assert got[4]["attack_vector"] == "L"          # duplicate metric: last wins
    assert got[5]["attack_vector"] is None and got[5]["attack_complexity"] == "H"
    assert got[6]["attack_vector"] is None
    assert got[7]["availability_impact"] == "x:y"
    assert got[8]["attack_vector"] is None          # key that ends in another key


def test_exploited(spark):
    assert one(spark, "Publicly Disclosed:No;Exploited:Yes", cvss.exploited) is True
    assert one(spark, "exploited:yes", cvss.exploited) is False
    assert one(spark, None, cvss.exploited) is False


def test_patch_age(spark):
    as_of = F.lit("2026-03-01 00:00:00").cast("timestamp")
    age = lambda c: cvss.patch_age_days(c, as_of)
    assert one(spark, "2026-02-10T08:00:00Z", age) == 18
    assert one(spark, "2026-02-10T08:00:00+05:00", age) == 18   # offset discarded, not applied
    assert one(spark, "2026-02-28", age) == 1
    assert one(spark, "/Date(1)/", age) is None
    assert one(spark, "garbage", age) is None
    assert one(spark, "2026-03-02T12:00:00", age) == -2          # future: floored, negative


def test_month_ids(spark):
    assert str(one(spark, "2026-FEB", months.parse_month_id)) == "2026-02-01"
    assert one(spark, "2026-13", months.parse_month_id) is None
    df = spark.createDataFrame([("2025-Nov", "2026-Feb"), ("2026-Mar", "2026-Feb"), ("2026-Feb", "2026-Feb"),
                                ("2020-Jan", "2026-Feb")], "s string, e string")
    out = [r[0] for r in df.select(months.month_range(F.col("s"), F.col("e"))).collect()]
    assert out[0] == ["2025-Nov", "2025-Dec", "2026-Jan", "2026-Feb"]   # year boundary
    assert out[1] == ["2026-Feb"] and out[2] == ["2026-Feb"]           # start clamped / same month
    assert len(out[3]) == 48 and out[3][0] == "2020-Jan"                # oldest 48 kept


def test_display(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), (None, "b"), ("a", None), (None, None)], "s string, e string")
    assert [r[0] for r in df.select(display.window_text("s", "e")).collect()] == ["a to b", "a", "b", "a", "-"]
    df2 = spark.createDataFrame([(["x", "y", "z"],), ([],)], "m array<string>")
    assert [r[0] for r in df2.select(display.range_text("m")).collect()] == ["x to z", "-"]
    assert [r[0] for r in df2.select(display.join_list("m")).collect()] == ["x, y, z", "-"]
    assert one(spark, "a|b\nc", display.md_escape) == "a\\|b c"


def test_platform(spark):
    df = spark.createDataFrame([("Microsoft Windows 11 Pro", "AMD64", "26200.7623", "25H2"),
                                ("Windows 10 Home", "32-bit", "19045.1", "22H2"),
                                ("Server", "ARM64", "", None)], "OsName string, Architecture string, Build string, DisplayVersion string")
    df = df.withColumn("scan_id", F.monotonically_increasing_id())
    got = rows(platform.constraints(df).orderBy("scan_id"), "windows_gen", "build_major", "catalog_arch", "display_version")
    assert got == [("windows 11", "26200", "x64", "25H2"), ("windows 10", "19045", "x86", "22H2"), ("", "", "arm64", "")]


def test_patch_age_ignores_session_time_zone(spark):
    df = spark.createDataFrame([("2001-03-01T00:00:00Z",), ("2001-08-31T23:30:00",), ("2000-11-05",)], "p string")
    as_of = F.lit("2001-09-01 00:00:00")
    expected = [184, 0, 300]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/Los_Angeles", "Europe/Warsaw"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            assert [r[0] for r in df.select(cvss.patch_age_days(F.col("p"), as_of)).collect()] == expected, tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_seven_digit_fractions_are_cut(spark):
    from fleetrisk.functions.cvss import patch_age_days
    df = spark.createDataFrame([("2024-01-01T00:00:00.1234567Z",), ("2024-01-01T00:00:00.1234567890+02:00",)], "d string")
    ages = [r.a for r in df.select(patch_age_days(F.col("d"), F.lit("2024-01-11 12:00:00")).alias("a")).collect()]
    assert ages == [10, 10]


def test_hosts_keep_their_rows(spark):
    from fleetrisk.operators import baseline
    b = spark.createDataFrame([("a", True, "2024-Jan", "nonsense"), ("b", True, "2024-Jan", "2024-Feb")],
                              "scan_id string, IsAdmin boolean, LcuMonthId string, MsrcLatestMonthId string")
    months, rejects = baseline.month_window(b)
    assert {r.scan_id for r in months.collect()} == {"b"} and [tuple(r) for r in rejects.collect()] == [("a", baseline.REASON_BAD_END)]
    hosts = spark.createDataFrame([("a", None, "24H2", "x64", None), ("b", "Windows 11", "24H2", "x64", "2024-02-01")],
                                  "scan_id string, family string, display_version string, arch_token string, latest_month string")
    hosts = hosts.withColumn("latest_month", F.to_date("latest_month"))
    products = spark.createDataFrame([("2024-01-01", "Windows 11 Version 24H2 for x64-based Systems")], "month string, product_name string")
    found = {r.scan_id: (r.product_name_hint, r.match_rank) for r in baseline.resolve_product(hosts, products.withColumn("month", F.to_date("month"))).collect()}
    assert found == {"a": (None, None), "b": ("Windows 11 Version 24H2 for x64-based Systems", 1)}


def test_month_id_of_a_date_is_that_of_the_formatter(spark):
    dates = spark.sql("SELECT d FROM VALUES (DATE'1998-01-31'), (DATE'2024-12-01'), (DATE'0999-05-02'), (DATE'9999-07-01'), (NULL) AS t(d)")
    for got, expected in rows(dates.select(months.month_id_of_date("d").alias("a"), months.month_id("d").alias("b")), "a", "b"):
        assert got == expected


def test_md_escape_uses_the_pattern_only_for_broken_lines(spark):
    cases = {"a|b||": r"a\|b\|\|", "a\r\n\nb|": r"a b\|", "a\rb": "a b", "": "", None: "", r"a\1$": r"a\1$"}
    for value, expected in cases.items():
        assert one(spark, value, display.md_escape) == expected, value
    plan = spark.range(1).select(display.md_escape(F.col("id")).alias("o"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == 1 and "CASE WHEN" in plan
