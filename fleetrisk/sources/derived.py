"""Domain tables derived from the driver's TPC-H-like test tables.

Hosts are nations, KBs are parts, CVEs are order-key buckets, months come from
ship dates (see FIXTURES.md section 3). Everything is a Spark job over the whole
tables, so the derived volume grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetrisk.functions.ids import update_type
from fleetrisk.functions.months import month_id, month_id_of_date
from fleetrisk.operators.joins import saved
from fleetrisk.sources.tables import read_table

# fixed values: derivation constants (FIXTURES.md section 3)
KB_BASE = 5000000
CVE_PREFIX = "CVE-2024-"
ORDERS_PER_CVE = 8  # consecutive order keys share a CVE, so CVEs grow with the data
BAD_CVE_PREFIX = "ADV-2024-"
BAD_CVE = (97, 13)  # CVE numbers with this modulus and remainder are not CVE ids in the entries
NO_METADATA = (101, 7)  # ... have no metadata
ODD_DATE = (89, 3)  # ... have a publication date that isn't ISO
LATE_DATE = (83, 5)  # ... are published LATE_YEARS later (negative age)
LATE_YEARS = 10
BLANK_KB = (211, 17)  # parts whose KB entry has a blank id
MAPPED_KB = (37, 11)  # parts whose KB entry has no update type
CYCLE = 60  # parts with remainder 1 and 2 also replace each other
AS_OF = "2001-09-01 00:00:00"
VECTOR_NULL_MODULUS = 17
AV_LETTERS = "NALP"
PR_LETTERS = "NLH"
UI_LETTERS = "NR"
C_LETTERS = "HLN"
EXPLOITED_TEXT = "Publicly Disclosed:No;Exploited:Yes"
NOT_EXPLOITED_TEXT = "Publicly Disclosed:No;Exploited:No"
URGENT_PRIORITY = "1-URGENT"


def kb_of(partkey) -> Column:
    return F.concat(F.lit("KB"), (F.lit(KB_BASE) + partkey).cast("string"))


def bucket_of(orderkey) -> Column:
    return F.floor(orderkey / ORDERS_PER_CVE).cast("long")


def _is(value, rule: tuple[int, int]) -> Column:
    return value % rule[0] == rule[1]


def cve_of_bucket(bucket, entries: bool = True) -> Column:
    """CVE id of a CVE number; in ``entries`` some numbers are advisories that aren't CVEs."""
    text = bucket.cast("string")
    # the formatter parses its pattern for every value: only numbers below 0 and nulls go through it
    number = F.when(bucket >= 100_000, text).when(bucket >= 0, F.lpad(text, 5, "0")).otherwise(F.format_string("%05d", bucket))
    prefix = F.when(_is(bucket, BAD_CVE), BAD_CVE_PREFIX).otherwise(CVE_PREFIX) if entries else F.lit(CVE_PREFIX)
    return F.concat(prefix, number)


def cve_of(orderkey) -> Column:
    return cve_of_bucket(bucket_of(orderkey))


def link(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line item: numeric keys (scan_id, partkey, bucket, month_start) plus
    the formatted ids (kb_id, cve_id, month) as lazy projections, so consumers that
    aggregate on the numeric keys never format strings per line item."""
    li = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_shipdate", "l_returnflag", "l_linestatus")
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    cust = read_table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    # orders meet customers first, so line items, the largest table, are shuffled once
    placed = orders.join(cust, orders.o_custkey == cust.c_custkey)
    j = li.join(placed, li.l_orderkey == placed.o_orderkey)
    return _with_ids(j.select(
        F.col("c_nationkey").alias("scan_id"),
        F.col("l_partkey").alias("partkey"),
        bucket_of(F.col("o_orderkey")).alias("bucket"),
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month_start"),
        "l_returnflag", "l_linestatus", "l_shipdate",
    ))


def _with_ids(numbers: DataFrame) -> DataFrame:
    return numbers.select("scan_id", "partkey", "bucket", "month_start", kb_of(F.col("partkey")).alias("kb_id"),
                          cve_of_bucket(F.col("bucket")).alias("cve_id"), month_id_of_date(F.col("month_start")).alias("month"),
                          "l_returnflag", "l_linestatus", "l_shipdate")


def saved_link(spark: SparkSession, folder: str) -> DataFrame:
    """``link`` for several readers: its numbers are saved once, so they don't each join the tables again."""
    return _with_ids(saved(link(spark, folder).drop("kb_id", "cve_id", "month")))


def supersedes_of(partkey, size) -> Column:
    """Edge part -> part-(1+size%5) for parts not divisible by 3 with a non-negative target,
    and a cycle between the parts of remainder 1 and 2 modulo CYCLE."""
    target = partkey - (F.lit(1) + size % 5)
    forward = F.when((partkey % 3 != 0) & (target >= 0), kb_of(target))
    back = kb_of(F.when(partkey % CYCLE == 1, partkey + 1).when(partkey % CYCLE == 2, partkey - 1))
    # by cases: dropping nulls from an array is interpreted
    return (F.when(forward.isNull() & back.isNull(), F.array().cast("array<string>")).when(back.isNull() | (forward == back), F.array(forward))
            .when(forward.isNull(), F.array(back)).otherwise(F.array(forward, back)))


def installed_line() -> Column:
    """A line item that marks its KB installed: returned-N, status-F."""
    return (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")


def entry_groups(lnk: DataFrame) -> DataFrame:
    """One row per (scan_id, partkey): the CVE buckets, month starts and whether any
    line item marks the KB installed, in numbers (``text_groups``: in texts).

    Buckets and months are gathered as one set of pairs: most of the time of this aggregate goes into
    the sets of its groups, which it keeps as objects and writes out one by one."""
    pairs = lnk.groupBy("scan_id", "partkey").agg(
        F.collect_set(F.struct("bucket", "month_start")).alias("_pairs"), F.max(installed_line()).alias("_installed"))
    return pairs.select("scan_id", "partkey", F.array_distinct("_pairs.bucket").alias("_buckets"),
                        F.array_compact(F.array_distinct("_pairs.month_start")).alias("_months"), "_installed")


def text_groups(lnk: DataFrame) -> DataFrame:
    """One row per (scan_id, partkey): sorted CVE ids and months as an entry has them, and ``_installed``.
    Both kb_entries and installed derive from it, so the link join is read once for both.

    Ids are formatted line item by line item, in generated code: a function over the elements of a gathered
    array is interpreted. Line items are dealt out by part as narrow rows, so they are grouped and meet
    their part where they are, and no gathered arrays are shuffled. The part leads the grouping keys: the
    aggregate sorts by them, and only the first one is compared as a number."""
    rows = lnk.select("scan_id", "partkey", cve_of_bucket(F.col("bucket")).alias("cve_id"),
                      month_id_of_date(F.col("month_start")).alias("month"), installed_line().alias("_installed"))
    return rows.repartition("partkey").groupBy("partkey", "scan_id").agg(
        F.sort_array(F.collect_set("cve_id")).alias("cves"), F.sort_array(F.collect_set("month")).alias("months"),
        F.max("_installed").alias("_installed"))


def kb_entries(spark: SparkSession, folder: str, lnk: DataFrame | None = None,
               groups: DataFrame | None = None) -> DataFrame:
    """kb_entry(scan_id, kb_id, months, cves, supersedes, update_type): the expected KBs per host."""
    if groups is None:
        groups = entry_groups(lnk if lnk is not None else link(spark, folder))  # model inputs are summed in the order of these rows
    return described(spark, folder, groups).select(*ENTRY_COLUMNS)


ENTRY_COLUMNS = ("scan_id", "kb_id", "months", "cves", "supersedes", "update_type")


def described(spark: SparkSession, folder: str, groups: DataFrame) -> DataFrame:
    """Entry groups with the entry columns of their part, beside ``partkey`` and ``_installed``."""
    if "cves" not in groups.columns:
        groups = groups.select("scan_id", "partkey", F.sort_array(F.transform("_buckets", lambda b: cve_of_bucket(b))).alias("cves"),
                               F.sort_array(F.transform("_months", lambda m: month_id_of_date(m))).alias("months"), "_installed")
    part = read_table(spark, folder, "part").select("p_partkey", "p_size")
    j = groups.join(part, groups.partkey == part.p_partkey)
    sup = supersedes_of(F.col("p_partkey"), F.col("p_size"))
    return j.select(
        "scan_id", F.when(_is(F.col("partkey"), BLANK_KB), F.lit("  ")).otherwise(kb_of(F.col("partkey"))).alias("kb_id"),
        "months", "cves", sup.alias("supersedes"),
        F.when(~_is(F.col("partkey"), MAPPED_KB), update_type(sup)).alias("update_type"), "partkey", "_installed")


def installed(spark: SparkSession, folder: str, lnk: DataFrame | None = None,
              groups: DataFrame | None = None) -> DataFrame:
    """installed(scan_id, kb_id): expected KBs whose line items are returned-N / status-F."""
    if groups is not None:
        return groups.where("_installed").select("scan_id", kb_of(F.col("partkey")).alias("kb_id"))
    lnk = lnk if lnk is not None else link(spark, folder)
    return (lnk.where(installed_line())
            .select("scan_id", "partkey").distinct()
            .select("scan_id", kb_of(F.col("partkey")).alias("kb_id")))


def _pick(letters: str, idx: Column) -> Column:
    return F.get(F.array(*[F.lit(ch) for ch in letters]), idx.cast("int"))


def cve_meta(spark: SparkSession, folder: str) -> DataFrame:
    """cve_meta(cve_id, severity, base_score, vector, published_date, exploitation).

    The newest order of each CVE number describes the CVE; some numbers have no
    metadata, some an odd or a late date. The pick is a ``max(struct)`` aggregate, so
    partial aggregation keeps one row per number and task before the shuffle.
    """
    o = read_table(spark, folder, "orders").select(
        "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    newest = (o.withColumn("bucket", bucket_of(F.col("o_orderkey"))).where(~_is(F.col("bucket"), NO_METADATA)).groupBy("bucket")
              .agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice", "o_orderpriority")).alias("n")))
    k = F.col("n.o_orderkey")
    score = (F.floor(F.col("n.o_totalprice")).cast("bigint") % 101).cast("double") / 10
    vector = F.when(k % VECTOR_NULL_MODULUS != 0, F.concat(
        F.lit("CVSS:3.1/AV:"), _pick(AV_LETTERS, k % 4),
        F.lit("/AC:L/PR:"), _pick(PR_LETTERS, k % 3),
        F.lit("/UI:"), _pick(UI_LETTERS, k % 2),
        F.lit("/S:U/C:"), _pick(C_LETTERS, k % 3),
        F.lit("/I:N/A:N")))
    return newest.select(
        cve_of_bucket(F.col("bucket"), entries=False).alias("cve_id"),
        severity_of(score).alias("severity"),
        score.alias("base_score"),
        vector.alias("vector"),
        published_text(F.col("n.o_orderdate"), F.col("bucket")).alias("published_date"),
        F.when(F.col("n.o_orderpriority") == URGENT_PRIORITY, F.lit(EXPLOITED_TEXT))
        .otherwise(F.lit(NOT_EXPLOITED_TEXT)).alias("exploitation"),
    )


def published_text(date, bucket) -> Column:
    """Publication text; late numbers have seven fraction digits, odd ones are not ISO."""
    late = F.date_format(date + F.expr(f"INTERVAL {LATE_YEARS} YEAR"), "yyyy-MM-dd'T'HH:mm:ss")
    return (F.when(_is(bucket, ODD_DATE), F.lit("/Date(0)/"))
            .when(_is(bucket, LATE_DATE), F.concat(late, F.lit(".0000000Z")))
            .otherwise(F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'")))


def severity_of(score: Column) -> Column:
    """Vendor-style severity text from the base score (fixture rule)."""
    return (F.when(score >= 9.0, "Critical").when(score >= 7.0, "Important")
            .when(score >= 4.0, "Moderate").otherwise("Low"))


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


# fixed values: fixture host and catalog rules
DISPLAY_VERSIONS = ("22H2", "23H2", "24H2")
ARCHITECTURES = ("AMD64", "ARM64", "x86", "32-bit", "x64")
CANDIDATE_VERSIONS = ("22H2", "23H2", "24H2", "24H2")
CANDIDATE_ARM_VARIANT = 3
NON_ADMIN_MODULUS = 7
NON_ADMIN_REMAINDER = 3


def baselines(spark: SparkSession, folder: str, lnk: DataFrame | None = None) -> DataFrame:
    """One baseline row per host (nation): OS, version, build, architecture, admin flag,
    LCU month (earliest installed ship month) and latest feed month (latest ship month)."""
    lnk = lnk if lnk is not None else link(spark, folder)
    inst = installed_line()
    months = lnk.groupBy("scan_id").agg(
        F.min(F.when(inst, F.col("l_shipdate"))).alias("_lcu"), F.max("l_shipdate").alias("_latest"))
    nation = read_table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("scan_id"), F.col("n_name").alias("host"), "n_regionkey")
    k = F.col("scan_id")
    out = nation.join(months, "scan_id", "left")
    return out.select(
        "scan_id", "host",
        F.concat(F.lit("Microsoft Windows 1"), (k % 2).cast("string"), F.lit(" Pro")).alias("OsName"),
        F.lit("Professional").alias("OsEdition"),
        F.get(F.array(*[F.lit(v) for v in DISPLAY_VERSIONS]), (k % 3).cast("int")).alias("DisplayVersion"),
        F.concat((F.lit(19000) + F.lit(10) * (k % 4)).cast("string"), F.lit("."),
                 (F.lit(1000) + k).cast("string")).alias("Build"),
        F.get(F.array(*[F.lit(v) for v in ARCHITECTURES]), F.col("n_regionkey")).alias("Architecture"),
        (k % NON_ADMIN_MODULUS != NON_ADMIN_REMAINDER).alias("IsAdmin"),
        month_id("_lcu").alias("LcuMonthId"),
        month_id("_latest").alias("MsrcLatestMonthId"),
    )


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog candidates: four title variants per part (FIXTURES.md section 3)."""
    part = read_table(spark, folder, "part").select("p_partkey")
    v = F.col("v")
    c = part.select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("v"))
    version = F.get(F.array(*[F.lit(x) for x in CANDIDATE_VERSIONS]), v)
    arch = F.when(v == CANDIDATE_ARM_VARIANT, "arm64").otherwise("x64")
    title = F.concat(
        F.lit("Cumulative Update for Windows 1"), (F.col("p_partkey") % 2).cast("string"),
        F.lit(" Version "), version, F.lit(" for "), arch, F.lit("-based Systems ("),
        kb_of(F.col("p_partkey")), F.lit(") ("), (F.lit(19000) + F.lit(10) * v).cast("string"), F.lit(".1)"))
    update_id = F.concat(F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit("-0000-4000-8000-"),
                         F.lpad(v.cast("string"), 12, "0"))
    return c.select(update_id.alias("update_id"), title.alias("title"), v.alias("candidate_pos"))


CANDIDATES_PER_PAGE = 40


def catalog_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog search pages (page_id, html): the candidates as rows of a result table, some
    with quotes, entities and a table inside a cell."""
    c = candidates(spark, folder).withColumn("part", F.substring("update_id", 1, 8).cast("long"))
    cell = lambda text: F.concat(F.lit("<td>"), text, F.lit("</td>"))
    title = F.replace("title", F.lit(" for "), F.lit("&#32;for<br/>"))
    title = F.when(F.col("part") % 5 == 0, F.concat(F.lit("<table><tr><td>"), title, F.lit("</td></tr></table>"))).otherwise(title)
    row = F.concat(F.lit("<tr id='"), F.col("update_id"), F.lit("_R"), F.col("candidate_pos").cast("string"), F.lit("'>"),
                   F.lit("<td></td>"), cell(title), cell(F.lit("Windows 11 &amp; later")), cell(F.lit("Security Updates")),
                   cell(F.lit("1/9/2024")), cell(F.lit("n/a")), cell(F.lit("1.0 GB")), F.lit("<td><input/></td></tr>"))
    rows = c.select(F.floor(F.col("part") / (CANDIDATES_PER_PAGE // 4)).cast("long").alias("page_id"),
                    F.struct("part", "candidate_pos", row.alias("row")).alias("r"))
    pages = rows.groupBy("page_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))  # CANDIDATES_PER_PAGE rows a page
    return pages.select("page_id", F.concat(F.lit('<html><body><table id="ctl00_catalogBody_updateMatches"><tr id="headerRow"><th>Title</th></tr>'),
                                            F.array_join(F.transform("rs", lambda x: x["row"]), ""), F.lit("</table></body></html>")).alias("html"))


def download_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Download dialogs (page_id, html), one per part: a package link given twice, for every third part a
    cabinet in upper case, and a link that is no package."""
    p = F.col("p_partkey")
    name = F.concat(F.lit("kb"), (F.lit(KB_BASE) + p).cast("string"))
    line = lambda number, url: F.concat(F.lit(f'downloadInformation[0].files[{number}].url = "'), url, F.lit('";\n'))
    package = F.concat(F.lit("https://dl.example.org/d/"), name, F.lit("-x64.msu?part="), p.cast("string"))
    cabinet = F.concat(F.lit("HTTP://dl.example.org/c/"), F.upper(name), F.lit(".CAB"))
    return read_table(spark, folder, "part").select(p.cast("long").alias("page_id"), F.concat(
        F.lit("<html><script>\n"), line(0, package), line(1, F.concat(F.lit("https://dl.example.org/"), name, F.lit(".txt"))),
        F.when(p % 3 == 0, line(2, cabinet)).otherwise(""), line(3, package), F.lit("</script></html>")).alias("html"))


def targets(spark: SparkSession, folder: str) -> DataFrame:
    """Per part the KB to find and the host constraints it must satisfy."""
    part = read_table(spark, folder, "part").select("p_partkey", "p_size")
    return part.select(
        kb_of(F.col("p_partkey")).alias("kb_id"),
        F.concat(F.lit("windows 1"), (F.col("p_size") % 2).cast("string")).alias("windows_gen"),
        F.lit("22h2").alias("display_version"), F.lit("19000").alias("build_major"),
        F.lit("x64").alias("catalog_arch"))


# fixed values: fixture product, hot-fix and package rules
PRODUCT_ARCHES = ("x64", "ARM64", "32-bit")
PACKAGE_KEY = "~31bf3856ad364e35~amd64~~"


def product_rows(spark: SparkSession, folder: str, lnk: DataFrame | None = None) -> DataFrame:
    """Affected-software rows (month, product, KB articles, CVE, superseded KB) per line item.

    Product names vary by part: family from the part key, a version for three
    of four parts (generic name otherwise), and an architecture token.
    """
    lnk = lnk if lnk is not None else link(spark, folder)
    part = read_table(spark, folder, "part").select("p_partkey", "p_size")
    j = lnk.join(part, lnk.partkey == part.p_partkey)
    p = F.col("partkey")
    arch = F.get(F.array(*[F.lit(a) for a in PRODUCT_ARCHES]), (p % 3).cast("int"))
    arch_text = F.when(arch == "32-bit", F.lit(" for 32-bit Systems")).otherwise(
        F.concat(F.lit(" for "), arch, F.lit("-based Systems")))
    version = F.when(p % 4 != 0, F.concat(F.lit(" Version "),
                                          F.get(F.array(*[F.lit(v) for v in DISPLAY_VERSIONS]), (p % 3).cast("int"))))
    name = F.concat(F.lit("Windows 1"), (p % 2).cast("string"), F.coalesce(version, F.lit("")), arch_text)
    target = p - (F.lit(1) + F.col("p_size") % 5)
    digits = lambda part: (F.lit(KB_BASE) + part).cast("string")
    # only the first number of a value counts; some parts have a second article, some CVE texts are untidy
    sup = F.when((p % 3 != 0) & (target >= 0), F.when(p % 7 == 4, F.concat(F.lit("kb"), digits(target), F.lit("; "), digits(p)))
                 .otherwise(digits(target)))
    articles = F.when(p % 11 == 4, F.array(digits(p), F.concat(F.lit("see KB"), digits(p + 1)), F.lit("Release Notes"))).otherwise(
        F.array(digits(p)))
    cve = F.when(p % 5 == 2, F.concat(F.lit(" "), F.lower("cve_id"), F.lit("\t"))).otherwise(F.col("cve_id"))
    return j.select("scan_id", "month", F.date_trunc("month", "l_shipdate").cast("date").alias("month_start"),
                    name.alias("full_product_name"),
                    articles.alias("kb_articles"), cve.alias("cve"), sup.alias("supercedence"))


def hotfixes(spark: SparkSession, folder: str, lnk: DataFrame | None = None) -> DataFrame:
    """Hot-fix inventory rows: installed line items of even parts."""
    lnk = lnk if lnk is not None else link(spark, folder)
    inst = installed_line()
    return lnk.where(inst & (F.col("partkey") % 2 == 0)).select(
        "scan_id", F.lower(F.col("kb_id")).alias("hotfix_id"))


def packages(spark: SparkSession, folder: str, lnk: DataFrame | None = None) -> DataFrame:
    """Package inventory rows: installed line items of odd parts; parts divisible by 5
    are cumulative (RollupFix) packages whose KB is only in the description."""
    lnk = lnk if lnk is not None else link(spark, folder)
    inst = installed_line()
    p = F.col("partkey")
    rollup = p % 5 == 0
    name = F.when(rollup, F.concat(F.lit("Package_for_RollupFix" + PACKAGE_KEY), (F.lit(19000) + p).cast("string"), F.lit(".1")))\
        .otherwise(F.concat(F.lit("Package_for_"), F.col("kb_id"), F.lit(PACKAGE_KEY), F.lit("10.0.1.1")))
    desc = F.when(rollup, F.concat(F.lit("Security Update ("), F.col("kb_id"), F.lit(")"))).otherwise(F.lit("Update"))
    return lnk.where(inst & (p % 2 == 1)).select(
        "scan_id", name.alias("package_name"), desc.alias("description"),
        F.col("l_shipdate").cast("timestamp").alias("install_time"))


def advisory_vulnerabilities(spark: SparkSession, folder: str) -> DataFrame:
    """Advisory vulnerability rows (month, pos, v) as they come out of exploded month
    documents: one per order, CVE of its bucket (odd orders in lower case), one CVSS
    set, a severity threat (type 3), an exploitation threat (type 1), one revision."""
    o = read_table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    k = F.col("o_orderkey")
    score = (F.floor(F.col("o_totalprice")).cast("bigint") % 101).cast("double") / 10
    vector = F.when(k % VECTOR_NULL_MODULUS != 0, F.concat(
        F.lit("CVSS:3.1/AV:"), _pick(AV_LETTERS, k % 4), F.lit("/AC:L/PR:"), _pick(PR_LETTERS, k % 3),
        F.lit("/UI:"), _pick(UI_LETTERS, k % 2), F.lit("/S:U/C:"), _pick(C_LETTERS, k % 3), F.lit("/I:N/A:N")))
    own = cve_of_bucket(bucket_of(k), entries=False)
    cve = F.when(k % 2 == 1, F.lower(own)).otherwise(own)
    expl = F.when(F.col("o_orderpriority") == URGENT_PRIORITY, F.lit(EXPLOITED_TEXT)).otherwise(F.lit(NOT_EXPLOITED_TEXT))
    threat = lambda t, text: F.struct(F.lit(t).alias("Type"), F.struct(text.alias("Value")).alias("Description"))
    v = F.struct(
        cve.alias("CVE"),
        F.array(F.struct(score.alias("BaseScore"), vector.alias("Vector"))).alias("CVSSScoreSets"),
        F.array(threat(3, severity_of(score)), threat(1, expl)).alias("Threats"),
        F.array(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Date"))).alias("RevisionHistory"))
    return o.select(month_id("o_orderdate").alias("month"), k.alias("pos"), v.alias("v"))
