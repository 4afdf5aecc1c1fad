"""DuckDB oracle SQL for the registered queries.

Each statement recomputes the query from the driver's tables with plain SQL
(tables are pre-registered views), so the driver can compare results.
Shared building blocks are CTE fragments, composed per query.
"""

from __future__ import annotations

LINK = """link AS (
  SELECT c.c_nationkey AS scan_id, l.l_partkey AS partkey,
         'KB' || CAST(5000000 + l.l_partkey AS VARCHAR) AS kb_id,
         CASE WHEN (o.o_orderkey // 8) % 97 = 13 THEN 'ADV' ELSE 'CVE' END || '-2024-' || printf('%05d', o.o_orderkey // 8) AS cve_id,
         strftime(l.l_shipdate, '%Y-%b') AS month, l.l_returnflag, l.l_linestatus, l.l_shipdate
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey)"""

# every (entry CVE) x (entry month) pair per (scan, KB): the flatten cross product
RAW = """elink AS (SELECT * FROM link WHERE partkey % 211 <> 17),
entry_cve AS (SELECT DISTINCT scan_id, kb_id, cve_id FROM elink),
entry_month AS (SELECT DISTINCT scan_id, kb_id, month FROM elink),
raw AS (SELECT c.scan_id, c.kb_id, c.cve_id, m.month FROM entry_cve c JOIN entry_month m
        ON c.scan_id = m.scan_id AND c.kb_id = m.kb_id WHERE c.cve_id LIKE 'CVE-%'),
flat AS (SELECT DISTINCT kb_id, cve_id, month FROM raw)"""

CVE_META = """cve_meta AS (
  SELECT 'CVE-2024-' || printf('%05d', o_orderkey // 8) AS cve_id,
         CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS DOUBLE) / 10 AS base_score,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE
           'CVSS:3.1/AV:' || substr('NALP', CAST(1 + o_orderkey % 4 AS INTEGER), 1)
           || '/AC:L/PR:' || substr('NLH', CAST(1 + o_orderkey % 3 AS INTEGER), 1)
           || '/UI:' || substr('NR', CAST(1 + o_orderkey % 2 AS INTEGER), 1)
           || '/S:U/C:' || substr('HLN', CAST(1 + o_orderkey % 3 AS INTEGER), 1) || '/I:N/A:N' END AS vector,
         CASE WHEN (o_orderkey // 8) % 89 = 3 THEN '/Date(0)/'
              WHEN (o_orderkey // 8) % 83 = 5 THEN strftime(o_orderdate + INTERVAL 10 YEAR, '%Y-%m-%dT%H:%M:%S.0000000Z')
              ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS published_date,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'Publicly Disclosed:No;Exploited:Yes'
              ELSE 'Publicly Disclosed:No;Exploited:No' END AS exploitation,
         CASE WHEN (o_orderkey // 8) % 89 = 3 THEN NULL
              WHEN (o_orderkey // 8) % 83 = 5 THEN o_orderdate + INTERVAL 10 YEAR ELSE o_orderdate END AS published_ts
  FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey // 8
                                     ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) t
  WHERE rn = 1 AND (o_orderkey // 8) % 101 <> 7)"""

_METRIC = "NULLIF(regexp_extract(vector, '(^|/){k}:([^/]*)', 2), '')"

DIM = """dim0 AS (
  SELECT cve_id, base_score AS cvss_score,
         CASE WHEN base_score >= 9.0 THEN 'Critical' WHEN base_score >= 7.0 THEN 'Important'
              WHEN base_score >= 4.0 THEN 'Moderate' ELSE 'Low' END AS severity,
         published_date,
         CAST(date_diff('day', published_ts, TIMESTAMP '2001-09-01 00:00:00') AS DOUBLE) AS patch_age_days,
         exploitation, """ + ",\n         ".join(
    _METRIC.format(k=k) + " AS " + name for name, k in (
        ("attack_vector", "AV"), ("attack_complexity", "AC"), ("privileges_required", "PR"),
        ("user_interaction", "UI"), ("scope", "S"), ("confidentiality_impact", "C"),
        ("integrity_impact", "I"), ("availability_impact", "A"))) + """
  FROM cve_meta),
dim1 AS (
  SELECT *,
    coalesce(CAST(cvss_score AS DOUBLE), 0.0) AS _cvss,
    coalesce(contains(exploitation, 'Exploited:Yes'), false) AS _expl,
    coalesce(upper(trim(attack_vector)) = 'N', false) AS _net,
    coalesce(upper(trim(privileges_required)) = 'N', false) AS _npr,
    coalesce(upper(trim(user_interaction)) = 'N', false) AS _nui,
    coalesce(upper(trim(confidentiality_impact)) = 'H' OR upper(trim(integrity_impact)) = 'H'
             OR upper(trim(availability_impact)) = 'H', false) AS _imp,
    least(CAST(greatest(coalesce(patch_age_days, 0), 0) AS DOUBLE) / 90.0, 2.0) AS _age
  FROM dim0),
dim AS (
  SELECT cve_id, cvss_score, severity, published_date, patch_age_days, exploitation,
    attack_vector, attack_complexity, privileges_required, user_interaction, scope,
    confidentiality_impact, integrity_impact, availability_impact,
    round(_cvss + (CASE WHEN _expl THEN 2.0 ELSE 0.0 END) + (CASE WHEN _net THEN 1.0 ELSE 0.0 END)
          + (CASE WHEN _npr THEN 0.5 ELSE 0.0 END) + (CASE WHEN _nui THEN 0.5 ELSE 0.0 END)
          + (CASE WHEN _imp THEN 0.5 ELSE 0.0 END) + _age, 2) AS policy_risk,
    coalesce(CASE WHEN _cvss >= 9.0 THEN 'critical CVSS' WHEN _cvss >= 7.0 THEN 'high CVSS' END,
             CASE WHEN _expl THEN 'exploitation signal' END, CASE WHEN _net THEN 'network attack vector' END,
             CASE WHEN _npr THEN 'no privileges required' END, CASE WHEN _nui THEN 'no user interaction' END,
             CASE WHEN _imp THEN 'high impact' END, CASE WHEN _age >= 1.0 THEN 'patch age exposure' END,
             'baseline CVSS exposure') AS top_driver,
    coalesce(NULLIF(concat_ws(', ',
             CASE WHEN _cvss >= 9.0 THEN 'critical CVSS' WHEN _cvss >= 7.0 THEN 'high CVSS' END,
             CASE WHEN _expl THEN 'exploitation signal' END, CASE WHEN _net THEN 'network attack vector' END,
             CASE WHEN _npr THEN 'no privileges required' END, CASE WHEN _nui THEN 'no user interaction' END,
             CASE WHEN _imp THEN 'high impact' END, CASE WHEN _age >= 1.0 THEN 'patch age exposure' END), ''),
             'baseline CVSS exposure') AS policy_drivers
  FROM dim1),
dim_scored AS (
  SELECT *, CASE WHEN policy_risk >= 9.0 THEN 'High' WHEN policy_risk >= 6.0 THEN 'Medium' ELSE 'Low' END
            AS policy_priority FROM dim)"""

ENRICHED = """enriched AS (
  SELECT f.kb_id, f.cve_id, f.month, d.cvss_score, d.severity, d.published_date, d.patch_age_days,
         d.exploitation, d.attack_vector, d.attack_complexity, d.privileges_required, d.user_interaction,
         d.scope, d.confidentiality_impact, d.integrity_impact, d.availability_impact,
         coalesce(d.policy_risk, 0.0) AS policy_risk, coalesce(d.policy_priority, 'Low') AS policy_priority,
         coalesce(d.policy_drivers, 'baseline CVSS exposure') AS policy_drivers,
         coalesce(d.top_driver, 'baseline CVSS exposure') AS top_driver
  FROM flat f LEFT JOIN dim_scored d ON f.cve_id = d.cve_id),
validated AS (
  SELECT *, policy_risk AS risk_score, policy_priority AS priority_label FROM enriched
  WHERE cvss_score IS NOT NULL AND attack_vector IS NOT NULL)"""


def with_(*blocks: str) -> str:
    return "WITH " + ",\n".join(blocks) + "\n"


TRAINING = with_(LINK, RAW, CVE_META, DIM, ENRICHED)

ORACLE: dict[str, str] = {}

ORACLE["flatten_training"] = with_(LINK, RAW) + "SELECT kb_id, cve_id, month FROM flat"

ORACLE["flatten_counters"] = with_(LINK, RAW) + """
SELECT metric, value FROM (
  SELECT 'raw_rows_created' AS metric, (SELECT count(*) FROM raw) AS value
  UNION ALL SELECT 'skipped_not_missing', 0
  UNION ALL SELECT 'skipped_incomplete', (SELECT count(*) FROM (SELECT DISTINCT scan_id, partkey FROM link WHERE partkey % 211 = 17) x)
  UNION ALL SELECT 'skipped_kb_entries', (SELECT count(*) FROM (SELECT DISTINCT scan_id, partkey FROM link WHERE partkey % 211 = 17) x)
  UNION ALL SELECT 'skipped_non_cve_ids', (SELECT count(*) FROM entry_cve WHERE cve_id NOT LIKE 'CVE-%')
  UNION ALL SELECT 'rows_created', (SELECT count(*) FROM flat)
  UNION ALL SELECT 'duplicate_rows_removed', (SELECT count(*) FROM raw) - (SELECT count(*) FROM flat))"""

ORACLE["scope_counts"] = with_(LINK, RAW) + """
SELECT count(DISTINCT kb_id) AS unique_kbs, count(DISTINCT cve_id) AS unique_cves,
       count(DISTINCT month) AS unique_months, count(*) AS rows FROM flat"""

ORACLE["cve_dimension"] = with_(CVE_META, DIM) + "SELECT * FROM dim_scored"

ORACLE["enriched"] = TRAINING + "SELECT * FROM enriched"

ORACLE["enrich_counters"] = TRAINING + """
, req AS (SELECT DISTINCT cve_id FROM flat)
SELECT metric, value FROM (
  SELECT 'metadata_cves_returned' AS metric, (SELECT count(*) FROM dim_scored) AS value
  UNION ALL SELECT 'requested_cves', (SELECT count(*) FROM req)
  UNION ALL SELECT 'matched_cves', (SELECT count(*) FROM req WHERE cve_id IN (SELECT cve_id FROM dim_scored))
  UNION ALL SELECT 'missing_metadata_cves', (SELECT count(*) FROM req WHERE cve_id NOT IN (SELECT cve_id FROM dim_scored))
  UNION ALL SELECT 'rows_enriched', (SELECT count(*) FROM enriched)
  UNION ALL SELECT 'rows_with_cvss_score', (SELECT count(cvss_score) FROM enriched)
  UNION ALL SELECT 'rows_with_attack_vector', (SELECT count(attack_vector) FROM enriched)
  UNION ALL SELECT 'rows_with_model_metadata',
    (SELECT count(*) FROM enriched WHERE cvss_score IS NOT NULL AND attack_vector IS NOT NULL))"""
ORACLE["enrich_counters"] = ORACLE["enrich_counters"].replace("\n, req AS", ", req AS", 1)

ORACLE["unmatched_cves"] = TRAINING + """
SELECT DISTINCT cve_id FROM flat WHERE cve_id NOT IN (SELECT cve_id FROM dim_scored) ORDER BY cve_id LIMIT 10"""

ORACLE["validated"] = TRAINING + "SELECT * FROM validated"

ORACLE["validation_counters"] = TRAINING + """
SELECT metric, value FROM (
  SELECT 'rows_before' AS metric, (SELECT count(*) FROM enriched) AS value
  UNION ALL SELECT 'non_cve_rows_removed', (SELECT count(*) FROM enriched WHERE NOT regexp_matches(cve_id, '^CVE-[0-9]{4}-[0-9]{4,}$'))
  UNION ALL SELECT 'rows_missing_required_fields',
    (SELECT count(*) FROM enriched WHERE cvss_score IS NULL OR attack_vector IS NULL)
  UNION ALL SELECT 'rows_after', (SELECT count(*) FROM validated)
  UNION ALL SELECT 'duplicate_rows_removed',
    (SELECT count(*) FROM validated) - (SELECT count(*) FROM (SELECT DISTINCT kb_id, cve_id, month FROM validated) x)
  UNION ALL SELECT 'rows_dropped', (SELECT count(*) FROM enriched) - (SELECT count(*) FROM validated))"""

ORACLE["label_distribution"] = TRAINING + """
SELECT priority_label AS label, count(*) AS count FROM validated GROUP BY priority_label"""

ORACLE["score_range"] = TRAINING + """
SELECT priority_label, round(min(policy_risk), 2) AS risk_min, round(max(policy_risk), 2) AS risk_max,
       round(avg(policy_risk), 2) AS risk_mean, count(*) AS rows FROM validated GROUP BY priority_label"""

ROLLUP_TRAINING = """rolled AS (
  SELECT kb_id, max(policy_risk) AS policy_risk,
    CASE max(CASE policy_priority WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END)
      WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' ELSE 'Unknown' END AS policy_priority,
    count(*) AS cve_count FROM validated GROUP BY kb_id),
toprow AS (
  SELECT kb_id, top_driver, policy_drivers AS review_reason FROM (
    SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY policy_risk DESC, cve_id, month) AS rn
    FROM validated) t WHERE rn = 1)"""

ORACLE["kb_ranking"] = TRAINING + ", " + ROLLUP_TRAINING + """
SELECT CAST(row_number() OVER (ORDER BY r.policy_risk DESC, r.kb_id) AS INTEGER) AS rank, r.kb_id,
       r.policy_risk, r.policy_priority, r.cve_count, t.top_driver, t.review_reason
FROM rolled r JOIN toprow t ON r.kb_id = t.kb_id"""


# ---------------------------------------------------------------- closure and correlation

def with_rec(*blocks: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(blocks) + "\n"


CORR = """expected AS (SELECT DISTINCT scan_id, partkey, kb_id FROM elink),
edges AS (
  SELECT e.scan_id, e.kb_id AS src,
         'KB' || CAST(5000000 + p.p_partkey - (1 + p.p_size % 5) AS VARCHAR) AS dst
  FROM expected e JOIN part p ON e.partkey = p.p_partkey
  WHERE p.p_partkey % 3 <> 0 AND p.p_partkey - (1 + p.p_size % 5) >= 0
  UNION
  SELECT scan_id, kb_id, 'KB' || CAST(5000000 + partkey + CASE partkey % 60 WHEN 1 THEN 1 ELSE -1 END AS VARCHAR)
  FROM expected WHERE partkey % 60 IN (1, 2)),
installed AS (SELECT DISTINCT scan_id, kb_id FROM link WHERE l_returnflag = 'N' AND l_linestatus = 'F'),
reach(scan_id, root_kb, kb_id) AS (
  SELECT i.scan_id, i.kb_id, e.dst FROM installed i JOIN edges e ON e.scan_id = i.scan_id AND e.src = i.kb_id
  UNION
  SELECT r.scan_id, r.root_kb, e.dst FROM reach r JOIN edges e ON e.scan_id = r.scan_id AND e.src = r.kb_id),
present AS (SELECT scan_id, kb_id FROM installed UNION SELECT scan_id, kb_id FROM reach),
missing AS (SELECT scan_id, kb_id FROM expected EXCEPT SELECT scan_id, kb_id FROM present),
etype AS (
  SELECT x.scan_id, x.kb_id,
         CASE WHEN p.p_partkey % 37 = 11 THEN NULL
              WHEN p.p_partkey % 3 <> 0 AND p.p_partkey - (1 + p.p_size % 5) >= 0 OR p.p_partkey % 60 IN (1, 2)
              THEN 'Superseding' ELSE 'Standalone' END AS update_type
  FROM expected x JOIN part p ON x.partkey = p.p_partkey),
supby AS (
  SELECT scan_id, kb_id, string_agg(root_kb, ', ' ORDER BY root_kb) AS replaced
  FROM (SELECT DISTINCT scan_id, kb_id, root_kb FROM reach) t GROUP BY scan_id, kb_id)"""

STATUS = """status AS (
  SELECT x.scan_id, x.kb_id, coalesce(t.update_type, 'Mapped') AS type,
         CASE WHEN i.kb_id IS NOT NULL THEN 'Installed'
              WHEN s.replaced IS NOT NULL THEN 'Superseded by ' || s.replaced ELSE 'Missing' END AS status,
         mo.months, CAST(cc.cve_count AS INTEGER) AS cve_count
  FROM expected x
  JOIN etype t ON t.scan_id = x.scan_id AND t.kb_id = x.kb_id
  LEFT JOIN installed i ON i.scan_id = x.scan_id AND i.kb_id = x.kb_id
  LEFT JOIN supby s ON s.scan_id = x.scan_id AND s.kb_id = x.kb_id
  JOIN (SELECT scan_id, kb_id, string_agg(month, ', ' ORDER BY month) AS months
        FROM entry_month GROUP BY scan_id, kb_id) mo ON mo.scan_id = x.scan_id AND mo.kb_id = x.kb_id
  JOIN (SELECT scan_id, kb_id, count(*) AS cve_count FROM entry_cve GROUP BY scan_id, kb_id) cc
    ON cc.scan_id = x.scan_id AND cc.kb_id = x.kb_id)"""

CORRELATION = with_rec(LINK, RAW, CORR)

ORACLE["closure_pairs"] = CORRELATION + "SELECT scan_id, root_kb, kb_id FROM reach"
ORACLE["logical_present"] = CORRELATION + "SELECT scan_id, kb_id FROM present"
ORACLE["missing_kbs"] = CORRELATION + """
SELECT m.scan_id, m.kb_id, coalesce(t.update_type, 'Unknown') AS update_type
FROM missing m LEFT JOIN etype t ON t.scan_id = m.scan_id AND t.kb_id = m.kb_id"""
ORACLE["kb_status"] = with_rec(LINK, RAW, CORR, STATUS) + "SELECT * FROM status"
ORACLE["scan_documents"] = with_rec(LINK, RAW, CORR, STATUS) + """
SELECT scan_id, kb_id, months, cve_count, status = 'Missing' AS missing FROM status"""
ORACLE["kb_table_top10"] = with_rec(LINK, RAW, CORR, STATUS) + """
SELECT * FROM (
  SELECT scan_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY kb_id) AS INTEGER) AS pos, kb_id, type,
         status, months, cve_count, CAST(greatest(count(*) OVER (PARTITION BY scan_id) - 10, 0) AS BIGINT) AS remaining
  FROM status) t WHERE pos <= 10"""
ORACLE["scan_summary"] = CORRELATION + """
SELECT e.scan_id, w.n AS raw_entries_returned, e.expected_kbs, coalesce(i.n, 0) AS installed_kbs, coalesce(p.n, 0) AS logical_present_kbs,
       coalesce(s.n, 0) AS superseded_mappings, coalesce(m.n, 0) AS missing_kbs,
       e.expected_kbs - coalesce(m.n, 0) AS present_among_expected
FROM (SELECT scan_id, count(*) AS expected_kbs FROM expected GROUP BY scan_id) e
LEFT JOIN (SELECT scan_id, count(*) AS n FROM entry_month GROUP BY scan_id) w ON w.scan_id = e.scan_id
LEFT JOIN (SELECT scan_id, count(*) AS n FROM installed GROUP BY scan_id) i ON i.scan_id = e.scan_id
LEFT JOIN (SELECT scan_id, count(*) AS n FROM present GROUP BY scan_id) p ON p.scan_id = e.scan_id
LEFT JOIN (SELECT scan_id, count(*) AS n FROM supby GROUP BY scan_id) s ON s.scan_id = e.scan_id
LEFT JOIN (SELECT scan_id, count(*) AS n FROM missing GROUP BY scan_id) m ON m.scan_id = e.scan_id"""
ORACLE["missing_breakdown"] = CORRELATION + """
SELECT m.scan_id, count(*) FILTER (WHERE t.update_type = 'Superseding') AS Superseding,
       count(*) FILTER (WHERE t.update_type = 'Standalone') AS Standalone
FROM missing m JOIN etype t ON t.scan_id = m.scan_id AND t.kb_id = m.kb_id GROUP BY m.scan_id"""
ORACLE["source_summary"] = CORRELATION + """
SELECT e.scan_id, e.kb_entries, coalesce(m.n, 0) AS missing_kbs
FROM (SELECT scan_id, count(DISTINCT partkey) AS kb_entries FROM link GROUP BY scan_id) e
LEFT JOIN (SELECT scan_id, count(*) AS n FROM missing GROUP BY scan_id) m ON m.scan_id = e.scan_id"""
ORACLE["months_with_entries"] = with_(LINK, RAW) + """
SELECT scan_id, string_agg(month, ', ' ORDER BY month) AS months_with_entries
FROM (SELECT DISTINCT scan_id, month FROM link) t GROUP BY scan_id"""

RUNTIME = """rt_flat AS (
  SELECT DISTINCT r.scan_id, r.kb_id, r.cve_id, r.month FROM raw r
  JOIN missing ms ON ms.scan_id = r.scan_id AND ms.kb_id = r.kb_id),
rt_valid AS (
  SELECT f.scan_id, f.kb_id, f.cve_id, f.month, d.cvss_score, d.attack_vector, d.policy_risk,
         d.policy_priority, d.policy_drivers, d.top_driver
  FROM rt_flat f JOIN dim_scored d ON f.cve_id = d.cve_id
  WHERE d.cvss_score IS NOT NULL AND d.attack_vector IS NOT NULL),
rt_rolled AS (
  SELECT scan_id, kb_id, max(policy_risk) AS policy_risk,
    CASE max(CASE policy_priority WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END)
      WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' ELSE 'Unknown' END AS policy_priority,
    count(*) AS cve_count FROM rt_valid GROUP BY scan_id, kb_id),
rt_top AS (
  SELECT scan_id, kb_id, top_driver, policy_drivers AS review_reason FROM (
    SELECT *, row_number() OVER (PARTITION BY scan_id, kb_id ORDER BY policy_risk DESC, cve_id, month) AS rn
    FROM rt_valid) t WHERE rn = 1),
rt_ranked AS (
  SELECT r.scan_id, CAST(row_number() OVER (PARTITION BY r.scan_id ORDER BY r.policy_risk DESC, r.kb_id) AS INTEGER)
         AS rank, r.kb_id, r.policy_risk, r.policy_priority, r.cve_count, t.top_driver, t.review_reason
  FROM rt_rolled r JOIN rt_top t ON r.scan_id = t.scan_id AND r.kb_id = t.kb_id)"""

FLEET = with_rec(LINK, RAW, CORR, CVE_META, DIM, RUNTIME)

ORACLE["runtime_flatten"] = CORRELATION + """
SELECT DISTINCT r.scan_id, r.kb_id, r.cve_id, r.month FROM raw r
JOIN missing ms ON ms.scan_id = r.scan_id AND ms.kb_id = r.kb_id"""
ORACLE["fleet_ranking"] = FLEET + "SELECT * FROM rt_ranked"
ORACLE["ranking_summary"] = FLEET + """
SELECT scan_id, count(*) AS kb_count, CAST(sum(cve_count) AS BIGINT) AS cves_reviewed, max(policy_risk) AS highest_policy_risk,
  CASE max(CASE policy_priority WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END)
    WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' ELSE 'Unknown' END AS highest_policy_priority
FROM rt_ranked GROUP BY scan_id"""
ORACLE["cve_preview"] = FLEET + """
SELECT * FROM (
  SELECT scan_id, kb_id, CAST(row_number() OVER (PARTITION BY scan_id, kb_id
           ORDER BY policy_risk DESC, cve_id, month) AS INTEGER) AS cve_rank,
         cve_id, month, policy_risk, policy_priority, top_driver,
         count(*) OVER (PARTITION BY scan_id, kb_id) AS cve_total,
         greatest(count(*) OVER (PARTITION BY scan_id, kb_id) - 10, 0) AS hidden_count
  FROM rt_valid) t WHERE cve_rank <= 10"""


# ---------------------------------------------------------------- hosts, months, candidates, text

HOSTS = """b AS (
  SELECT scan_id, min(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN l_shipdate END) AS lcu,
         max(l_shipdate) AS latest FROM link GROUP BY scan_id),
h AS (SELECT n.n_nationkey AS scan_id, n.n_regionkey, b.lcu, b.latest FROM nation n LEFT JOIN b ON b.scan_id = n.n_nationkey)"""

ORACLE["host_constraints"] = """
SELECT n_nationkey AS scan_id, 'windows 1' || CAST(n_nationkey % 2 AS VARCHAR) AS windows_gen,
  CASE n_nationkey % 3 WHEN 0 THEN '22H2' WHEN 1 THEN '23H2' ELSE '24H2' END AS display_version,
  CAST(19000 + 10 * (n_nationkey % 4) AS VARCHAR) AS build_major,
  CASE n_regionkey WHEN 0 THEN 'x64' WHEN 1 THEN 'arm64' WHEN 2 THEN 'x86' WHEN 3 THEN 'x86' ELSE 'x64' END AS catalog_arch,
  CASE n_regionkey WHEN 0 THEN 'x64' WHEN 1 THEN 'ARM64' WHEN 2 THEN 'x86' WHEN 3 THEN 'x86' ELSE 'x64' END AS arch_label,
  CASE n_regionkey WHEN 0 THEN 'x64' WHEN 1 THEN 'ARM64' WHEN 2 THEN '32-bit' WHEN 3 THEN '32-bit' ELSE 'x64' END AS feed_arch
FROM nation"""

ORACLE["month_window"] = with_(LINK, HOSTS) + """, w AS (
  SELECT scan_id, CAST(date_trunc('month', least(lcu, latest)) AS DATE) AS s, CAST(date_trunc('month', latest) AS DATE) AS e
  FROM h WHERE scan_id % 7 <> 3 AND lcu IS NOT NULL),
m AS (SELECT scan_id, unnest(generate_series(s, e, INTERVAL 1 MONTH)) AS m, e FROM w)
SELECT scan_id, CAST(pos AS INTEGER) AS pos, strftime(m, '%Y-%b') AS month_id, truncated FROM (
  SELECT scan_id, m, row_number() OVER (PARTITION BY scan_id ORDER BY m) AS pos,
         count(*) OVER (PARTITION BY scan_id) > 48 AS truncated FROM m) t WHERE pos <= 48"""

ORACLE["month_window_rejects"] = with_(LINK, HOSTS) + """
SELECT scan_id, CASE WHEN scan_id % 7 = 3 THEN 'Baseline collected without administrative privileges'
                     ELSE 'Baseline did not provide LcuMonthId' END AS reason
FROM h WHERE scan_id % 7 = 3 OR lcu IS NULL"""

ORACLE["latest_month"] = with_(LINK) + """
SELECT scan_id, arg_max(month, strptime(month, '%Y-%b')) AS latest_month_id FROM link GROUP BY scan_id"""

CANDIDATES = """cand AS (
  SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '-0000-4000-8000-' || lpad(CAST(v AS VARCHAR), 12, '0') AS update_id,
    'Cumulative Update for Windows 1' || CAST(p_partkey % 2 AS VARCHAR) || ' Version '
    || CASE v WHEN 0 THEN '22H2' WHEN 1 THEN '23H2' ELSE '24H2' END || ' for '
    || CASE WHEN v = 3 THEN 'arm64' ELSE 'x64' END || '-based Systems (KB' || CAST(5000000 + p_partkey AS VARCHAR)
    || ') (' || CAST(19000 + 10 * v AS VARCHAR) || '.1)' AS title, CAST(v AS INTEGER) AS candidate_pos
  FROM part, range(4) r(v)),
tgt AS (SELECT 'KB' || CAST(5000000 + p_partkey AS VARCHAR) AS kb_id,
               'windows 1' || CAST(p_size % 2 AS VARCHAR) AS gen FROM part),
pairs AS (
  SELECT t.kb_id, c.update_id, c.candidate_pos, c.title, lower(c.title) AS lt, t.gen FROM tgt t JOIN cand c
  ON contains(lower(c.title), lower(t.kb_id))),
scored AS (
  SELECT kb_id, update_id, candidate_pos, title, CASE
    WHEN (gen = 'windows 10' AND contains(lt, 'windows 11')) OR (gen = 'windows 11' AND contains(lt, 'windows 10'))
      OR contains(lt, 'server') OR contains(lt, 'arm64-based') OR contains(lt, 'x86-based') OR contains(lt, '32-bit')
    THEN -10000 ELSE 50 + (CASE WHEN contains(lt, gen) THEN 40 ELSE 0 END)
      + (CASE WHEN contains(lt, 'x64-based') THEN 25 ELSE 0 END)
      + (CASE WHEN contains(lt, '22h2') THEN 25 ELSE 0 END)
      + (CASE WHEN regexp_matches(lt, '\\b\\d{2}h[12]\\b') AND NOT contains(lt, '22h2') THEN -15 ELSE 0 END)
      + (CASE WHEN regexp_extract(lt, '\\(\\s*(\\d{5})\\.', 1) = '' THEN 0
              WHEN regexp_extract(lt, '\\(\\s*(\\d{5})\\.', 1) = '19000' THEN 10 ELSE -5 END) END AS score
  FROM pairs)"""

ORACLE["candidate_scores"] = with_(CANDIDATES) + "SELECT kb_id, update_id, candidate_pos, score FROM scored"
ORACLE["best_candidate"] = with_(CANDIDATES) + """, best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY score DESC, candidate_pos) AS r
                 FROM scored WHERE score >= 0) t WHERE r = 1),
cnt AS (SELECT kb_id, count(*) AS n FROM scored WHERE score >= 0 GROUP BY kb_id)
SELECT t.kb_id, CASE WHEN b.score >= 90 THEN b.update_id END AS update_id,
       CASE WHEN b.score >= 90 THEN b.title END AS title, CAST(b.score AS DOUBLE) AS best_score,
       coalesce(c.n, 0) AS candidates_matching,
       CASE WHEN b.score IS NULL THEN 'No candidate matched baseline constraints'
            WHEN b.score < 90 THEN 'Ambiguous match below confidence threshold (' || CAST(b.score AS VARCHAR) || ')'
       END AS reason
FROM tgt t LEFT JOIN best b ON b.kb_id = t.kb_id LEFT JOIN cnt c ON c.kb_id = t.kb_id"""
ORACLE["candidate_top3"] = with_(CANDIDATES) + """
SELECT kb_id, CAST(pos AS INTEGER) AS pos, score, update_id, title FROM (
  SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY score DESC, candidate_pos) AS pos
  FROM scored WHERE score >= 0) t WHERE pos <= 3"""

ORACLE["package_urls"] = """
SELECT page_id, CAST(pos AS INTEGER) AS pos, url, split_part(split_part(url, '/', -1), '?', 1) AS file_name FROM (
  SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY first_at) - 1 AS pos FROM (
    SELECT page_id, u.url, min(u.i) AS first_at FROM (
      SELECT page_id, unnest(regexp_extract_all(html, '(?i)https?://[^"]+\\.(?:msu|cab)(?:\\?[^"]*)?')) AS url,
             unnest(range(len(regexp_extract_all(html, '(?i)https?://[^"]+\\.(?:msu|cab)(?:\\?[^"]*)?')))) AS i
      FROM pages) u GROUP BY page_id, u.url) t) t2"""
ORACLE["page_links"] = """
SELECT page_id, CAST(pos AS INTEGER) AS pos, url, split_part(split_part(url, '/', -1), '?', 1) AS file_name FROM (
  SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY first_at) - 1 AS pos FROM (
    SELECT page_id, url, min(i) AS first_at FROM (
      SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url,
             unnest(range(len(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS i
      FROM pages) u GROUP BY page_id, url) t) t2"""


# ---------------------------------------------------------------- model metrics on fixed pairs

ORACLE["regression_metrics_baseline"] = TRAINING + """, a AS (
  SELECT count(*) AS n, sum(policy_risk) AS sy, sum(policy_risk * policy_risk) AS syy,
         sum(abs(policy_risk - cvss_score)) AS sae, sum((policy_risk - cvss_score) * (policy_risk - cvss_score)) AS sse
  FROM validated)
SELECT 'mae' AS metric, round(sae / n, 6) AS value FROM a
UNION ALL SELECT 'rmse', round(sqrt(sse / n), 6) FROM a
UNION ALL SELECT 'r2', round(1.0 - sse / (syy - sy * sy / n), 6) FROM a"""

ORACLE["classification_metrics_baseline"] = TRAINING + """, pr AS (
  SELECT priority_label AS t, CASE severity WHEN 'Critical' THEN 'High' WHEN 'Important' THEN 'Medium' ELSE 'Low' END AS p
  FROM validated),
cls AS (SELECT t AS c FROM pr UNION SELECT p FROM pr),
per AS (
  SELECT c, (SELECT count(*) FROM pr WHERE t = c) AS support, (SELECT count(*) FROM pr WHERE p = c) AS predicted,
         (SELECT count(*) FROM pr WHERE t = c AND p = c) AS tp FROM cls)
SELECT 'accuracy' AS metric, round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS value FROM per
UNION ALL
SELECT 'weighted_f1', round(sum(CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0 END * support)
                            / sum(support), 6) FROM per"""


# ---------------------------------------------------------------- feed products, inventory, product names

PRODUCTS = """prod AS (
  SELECT l.scan_id, l.month, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS month_start, l.cve_id AS cve,
    'Windows 1' || CAST(l.partkey % 2 AS VARCHAR)
    || CASE WHEN l.partkey % 4 <> 0 THEN ' Version ' || CASE l.partkey % 3 WHEN 0 THEN '22H2' WHEN 1 THEN '23H2' ELSE '24H2' END ELSE '' END
    || CASE l.partkey % 3 WHEN 0 THEN ' for x64-based Systems' WHEN 1 THEN ' for ARM64-based Systems' ELSE ' for 32-bit Systems' END
      AS product, unnest(CASE WHEN l.partkey % 11 = 4 THEN [l.partkey, l.partkey + 1] ELSE [l.partkey] END) AS article,
    CASE WHEN p.p_partkey % 3 <> 0 AND p.p_partkey - (1 + p.p_size % 5) >= 0
         THEN 'KB' || CAST(5000000 + p.p_partkey - (1 + p.p_size % 5) AS VARCHAR) END AS sup
  FROM link l JOIN part p ON l.partkey = p.p_partkey)"""

ORACLE["product_kb_map"] = with_(LINK, PRODUCTS) + """
SELECT scan_id, 'KB' || CAST(5000000 + article AS VARCHAR) AS kb_id, string_agg(DISTINCT month, ', ' ORDER BY month) AS months,
       coalesce(string_agg(DISTINCT cve, ', ' ORDER BY cve) FILTER (cve LIKE 'CVE-%'), '') AS cves, coalesce(string_agg(DISTINCT sup, ', ' ORDER BY sup), '') AS supersedes,
       CASE WHEN count(sup) > 0 THEN 'Superseding' ELSE 'Standalone' END AS update_type
FROM prod WHERE lower(product) = lower('Windows 10 Version 23H2 for ARM64-based Systems') GROUP BY scan_id, article"""

ORACLE["installed_inventory"] = with_(LINK) + """
SELECT DISTINCT scan_id, kb_id FROM link
WHERE l_returnflag = 'N' AND l_linestatus = 'F' AND (partkey % 2 = 0 OR scan_id % 7 <> 3)"""

ORACLE["lcu_context"] = with_(LINK) + """, pk AS (
  SELECT scan_id, 'Package_for_RollupFix~31bf3856ad364e35~amd64~~' || CAST(19000 + partkey AS VARCHAR) || '.1' AS package_name,
         l_shipdate AS install_time
  FROM link WHERE l_returnflag = 'N' AND l_linestatus = 'F' AND partkey % 2 = 1 AND partkey % 5 = 0),
best AS (SELECT scan_id, package_name, install_time,
                row_number() OVER (PARTITION BY scan_id ORDER BY install_time DESC, package_name DESC) AS r FROM pk)
SELECT n.n_nationkey AS scan_id,
       CASE WHEN n.n_nationkey % 7 <> 3 THEN strftime(b.install_time, '%Y-%b') END AS lcu_month_id,
       CASE WHEN n.n_nationkey % 7 <> 3 THEN b.package_name END AS lcu_package_name,
       CASE WHEN n.n_nationkey % 7 <> 3 THEN b.install_time END AS lcu_install_time
FROM nation n LEFT JOIN (SELECT * FROM best WHERE r = 1) b ON b.scan_id = n.n_nationkey"""

HINTS = """hosts AS (
  SELECT n.n_nationkey AS scan_id,
    CASE WHEN n.n_nationkey % 23 <> 9 THEN 'windows 1' || CAST(n.n_nationkey % 2 AS VARCHAR) END AS fam,
    lower(CASE n.n_nationkey % 3 WHEN 0 THEN '22H2' WHEN 1 THEN '23H2' ELSE '24H2' END) AS dv,
    CASE n.n_regionkey WHEN 1 THEN 'arm64' WHEN 2 THEN '32-bit' WHEN 3 THEN '32-bit' ELSE 'x64' END AS arch,
    CAST(date_trunc('month', m.latest) AS DATE) AS latest
  FROM nation n JOIN (SELECT scan_id, max(l_shipdate) AS latest FROM link GROUP BY scan_id) m ON m.scan_id = n.n_nationkey),
names AS (SELECT DISTINCT month_start AS month, product AS product_name FROM prod),
cand AS (
  SELECT h.scan_id, n.month, n.product_name, lower(n.product_name) AS ln, h.fam, h.dv, h.arch,
    CASE WHEN h.arch = '32-bit' THEN ' for 32-bit systems' ELSE ' for ' || h.arch || '-based systems' END AS suffix
  FROM hosts h JOIN names n ON starts_with(lower(n.product_name), h.fam || ' ')
  WHERE date_diff('month', n.month, h.latest) BETWEEN 0 AND 5),
ranked AS (
  SELECT scan_id, month, product_name, CASE
    WHEN ln = fam || ' version ' || dv || suffix THEN 1 WHEN ln = fam || suffix THEN 2
    WHEN (arch = '32-bit' AND contains(ln, '32-bit')) OR (arch <> '32-bit' AND contains(ln, arch || '-based')) THEN 3
    ELSE 4 END AS match_rank FROM cand),
hint AS (
  SELECT h.scan_id, r.product_name AS product_name_hint, r.match_rank, r.month
  FROM hosts h LEFT JOIN (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY month DESC, match_rank, product_name) AS r FROM ranked) t
    WHERE r = 1) r ON r.scan_id = h.scan_id)"""

ORACLE["product_name_hint"] = with_(LINK, PRODUCTS, HINTS) + """
SELECT scan_id, product_name_hint, CAST(match_rank AS DOUBLE) AS match_rank, strftime(month, '%Y-%b') AS resolved_month_id FROM hint"""

ORACLE["scanner_summary"] = with_rec(LINK, HOSTS, PRODUCTS, HINTS) + """, win AS (
  SELECT scan_id, CAST(date_trunc('month', least(lcu, latest)) AS DATE) AS s, CAST(date_trunc('month', latest) AS DATE) AS e
  FROM h WHERE scan_id % 7 <> 3 AND lcu IS NOT NULL),
wm AS (SELECT scan_id, unnest(generate_series(s, e, INTERVAL 1 MONTH)) AS mo FROM win),
req AS (SELECT scan_id, strftime(mo, '%Y-%b') AS month, (pos - 1) // 3 AS request FROM (
  SELECT scan_id, mo, row_number() OVER (PARTITION BY scan_id ORDER BY mo) AS pos FROM wm) t WHERE pos <= 48),
own AS (SELECT p.scan_id, p.month, r.request, 'KB' || CAST(5000000 + p.article AS VARCHAR) AS kb_id, p.sup FROM prod p
  JOIN hint i ON i.scan_id = p.scan_id AND lower(i.product_name_hint) = lower(p.product)
  JOIN req r ON r.scan_id = p.scan_id AND r.month = p.month),
expected AS (SELECT DISTINCT scan_id, kb_id FROM own),
edges AS (SELECT DISTINCT scan_id, kb_id AS src, sup AS dst FROM own WHERE sup IS NOT NULL),
installed AS (SELECT DISTINCT scan_id, kb_id FROM link WHERE l_returnflag = 'N' AND l_linestatus = 'F'
  AND (partkey % 2 = 0 OR scan_id % 7 <> 3)),
reach(scan_id, root_kb, kb_id) AS (
  SELECT i.scan_id, i.kb_id, e.dst FROM installed i JOIN edges e ON e.scan_id = i.scan_id AND e.src = i.kb_id
  UNION
  SELECT r.scan_id, r.root_kb, e.dst FROM reach r JOIN edges e ON e.scan_id = r.scan_id AND e.src = r.kb_id),
present AS (SELECT scan_id, kb_id FROM installed UNION SELECT scan_id, kb_id FROM reach),
missing AS (SELECT scan_id, kb_id FROM expected EXCEPT SELECT scan_id, kb_id FROM present)
SELECT h.scan_id,
       CASE WHEN h.scan_id % 7 = 3 THEN 'Baseline collected without administrative privileges' WHEN h.lcu IS NULL THEN 'Baseline did not provide LcuMonthId'
            WHEN t.product_name_hint IS NULL THEN 'No product name resolved' WHEN e.expected_kbs IS NULL THEN 'No KB data returned' END AS reason,
       coalesce(w.n, 0) AS raw_entries_returned, coalesce(e.expected_kbs, 0) AS expected_kbs, coalesce(i.n, 0) AS installed_kbs,
       coalesce(p.n, 0) AS logical_present_kbs, coalesce(s.n, 0) AS superseded_mappings, coalesce(m.n, 0) AS missing_kbs,
       coalesce(e.expected_kbs, 0) - coalesce(m.n, 0) AS present_among_expected
FROM h LEFT JOIN hint t ON t.scan_id = h.scan_id
LEFT JOIN (SELECT scan_id, count(*) AS expected_kbs FROM expected GROUP BY scan_id) e ON e.scan_id = h.scan_id
LEFT JOIN (SELECT scan_id, count(*) AS n FROM (SELECT DISTINCT scan_id, kb_id, request FROM own) x GROUP BY scan_id) w ON w.scan_id = h.scan_id
LEFT JOIN (SELECT scan_id, count(*) AS n FROM installed GROUP BY scan_id) i ON i.scan_id = h.scan_id
LEFT JOIN (SELECT scan_id, count(*) AS n FROM present GROUP BY scan_id) p ON p.scan_id = h.scan_id
LEFT JOIN (SELECT scan_id, count(DISTINCT kb_id) AS n FROM reach GROUP BY scan_id) s ON s.scan_id = h.scan_id
LEFT JOIN (SELECT scan_id, count(*) AS n FROM missing GROUP BY scan_id) m ON m.scan_id = h.scan_id"""


# ---------------------------------------------------------------- advisories

_ADV = """
SELECT 'CVE-2024-' || printf('%05d', o_orderkey // 8) AS cve_id,
  CASE WHEN s >= 9.0 THEN 'Critical' WHEN s >= 7.0 THEN 'Important' WHEN s >= 4.0 THEN 'Moderate' ELSE 'Low' END AS severity,
  s AS base_score,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE
    'CVSS:3.1/AV:' || substr('NALP', CAST(1 + o_orderkey % 4 AS INTEGER), 1)
    || '/AC:L/PR:' || substr('NLH', CAST(1 + o_orderkey % 3 AS INTEGER), 1)
    || '/UI:' || substr('NR', CAST(1 + o_orderkey % 2 AS INTEGER), 1)
    || '/S:U/C:' || substr('HLN', CAST(1 + o_orderkey % 3 AS INTEGER), 1) || '/I:N/A:N' END AS vector,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS published_date,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Publicly Disclosed:No;Exploited:Yes'
       ELSE 'Publicly Disclosed:No;Exploited:No' END AS exploitation
FROM (SELECT *, CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS DOUBLE) / 10 AS s,
             row_number() OVER (PARTITION BY o_orderkey // 8 ORDER BY {key} DESC, o_orderkey DESC) AS rn
      FROM orders) t WHERE rn = 1"""
ORACLE["advisory_metadata"] = _ADV.format(key="date_trunc('month', o_orderdate)")
ORACLE["advisory_metadata_text_order"] = _ADV.format(key="strftime(o_orderdate, '%Y-%b')")


# ---------------------------------------------------------------- report lines

ORACLE["report_lines"] = FLEET + """, summ AS (
  SELECT scan_id, count(*) AS kb_count, CAST(sum(cve_count) AS BIGINT) AS cves_reviewed, max(policy_risk) AS hi,
    CASE max(CASE policy_priority WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END)
      WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' ELSE 'Unknown' END AS hp
  FROM rt_ranked GROUP BY scan_id),
fixed(section, k1, k2, line) AS (VALUES
  (0, 0, 0, '# Patch Risk Review'), (0, 0, 1, ''),
  (1, 0, 0, '## Runtime Summary'), (1, 99, 0, ''),
  (4, 0, 0, '## Ranked Remediation'), (4, 0, 1, ''),
  (4, 0, 2, '| Rank | KB | Policy Risk | ML Risk | Priority | ML Priority | Cluster | CVEs | Top Driver |'),
  (4, 0, 3, '|---:|---|---:|---:|---|---|---:|---:|---|'), (4, 1099511627776, 0, ''),
  (5, 0, 0, '## Review Drivers'), (5, 0, 1, ''), (5, 1099511627776, 0, ''),
  (6, 0, 0, '## Ranking Review'), (6, 0, 1, '')),
cves AS (
  SELECT v.*, r.rank, row_number() OVER (PARTITION BY v.scan_id, v.kb_id ORDER BY v.policy_risk DESC, v.cve_id, v.month) AS p
  FROM rt_valid v JOIN rt_ranked r ON r.scan_id = v.scan_id AND r.kb_id = v.kb_id),
lines AS (
  SELECT s.scan_id, f.section, f.k1, f.k2, 0 AS k3, f.line FROM summ s, fixed f
  UNION ALL SELECT scan_id, 1, 1, 0, 0, '- Missing KBs reviewed: ' || CAST(kb_count AS VARCHAR) FROM summ
  UNION ALL SELECT scan_id, 1, 2, 0, 0, '- CVEs reviewed: ' || CAST(cves_reviewed AS VARCHAR) FROM summ
  UNION ALL SELECT scan_id, 1, 3, 0, 0, '- Highest policy risk: ' || printf('%.2f', hi) FROM summ
  UNION ALL SELECT scan_id, 1, 4, 0, 0, '- Highest ML risk: 0.00' FROM summ
  UNION ALL SELECT scan_id, 1, 5, 0, 0, '- Highest priority: ' || hp FROM summ
  UNION ALL SELECT scan_id, 4, rank, 0, 0, '| ' || CAST(rank AS VARCHAR) || ' | ' || kb_id || ' | ' || printf('%.2f', policy_risk)
      || ' | 0.00 | ' || policy_priority || ' | Unknown | 0 | ' || CAST(cve_count AS VARCHAR) || ' | ' || top_driver || ' |' FROM rt_ranked
  UNION ALL SELECT scan_id, 5, rank, 0, 0, '- **' || kb_id || '**: ' || review_reason FROM rt_ranked
  UNION ALL SELECT scan_id, 6, rank, 0, 0, '### ' || kb_id FROM rt_ranked
  UNION ALL SELECT scan_id, 6, rank, 1, 0, '' FROM rt_ranked
  UNION ALL SELECT scan_id, 6, rank, 2, 0,
      '| CVE | Policy Risk | ML Risk | Policy Priority | ML Priority | Cluster | Driver | Policy Drivers |' FROM rt_ranked
  UNION ALL SELECT scan_id, 6, rank, 3, 0, '|---|---:|---:|---|---|---:|---|---|' FROM rt_ranked
  UNION ALL SELECT scan_id, 6, rank, 4, p, '| ' || cve_id || ' | ' || printf('%.2f', policy_risk) || ' | 0.00 | '
      || policy_priority || ' | Unknown | 0 | ' || top_driver || ' | ' || policy_drivers || ' |' FROM cves
  UNION ALL SELECT scan_id, 6, rank, 5, 0, '' FROM rt_ranked)
SELECT CAST(scan_id AS VARCHAR) AS scan_id, CAST(section AS INTEGER) AS section, CAST(k1 AS BIGINT) AS k1,
       CAST(k2 AS INTEGER) AS k2, CAST(k3 AS BIGINT) AS k3, line FROM lines"""


# ---------------------------------------------------------------- nested ranking, counters, candidates, models

ORACLE["cve_counts"] = FLEET + """
SELECT scan_id, kb_id, count(*) AS cve_rows, count(DISTINCT cve_id) AS distinct_cves FROM rt_valid GROUP BY scan_id, kb_id"""

ORACLE["nested_ranking"] = FLEET + """
SELECT r.scan_id, r.rank, r.kb_id, count(*) AS cve_rows,
       string_agg(v.cve_id || '|' || printf('%.2f', v.policy_risk) || '|' || v.policy_priority || '|' || v.policy_drivers, '; '
                  ORDER BY v.policy_risk DESC, v.cve_id, v.month) AS cves
FROM rt_ranked r JOIN rt_valid v ON v.scan_id = r.scan_id AND v.kb_id = r.kb_id GROUP BY r.scan_id, r.rank, r.kb_id"""

ORACLE["runtime_flatten_counters"] = CORRELATION + """, mx AS (SELECT DISTINCT scan_id, kb_id FROM missing),
blank AS (SELECT DISTINCT scan_id, partkey FROM link WHERE partkey % 211 = 17),
own AS (SELECT e.*, m.kb_id IS NOT NULL AS kept FROM expected e LEFT JOIN mx m ON m.scan_id = e.scan_id AND m.kb_id = e.kb_id),
rr AS (SELECT r.* FROM raw r JOIN mx ON mx.scan_id = r.scan_id AND mx.kb_id = r.kb_id)
SELECT metric, value FROM (
  SELECT 'raw_rows_created' AS metric, (SELECT count(*) FROM rr) AS value
  UNION ALL SELECT 'skipped_not_missing', (SELECT count(*) FROM own WHERE NOT kept) + (SELECT count(*) FROM blank)
  UNION ALL SELECT 'skipped_incomplete', 0
  UNION ALL SELECT 'skipped_kb_entries', (SELECT count(*) FROM own WHERE NOT kept) + (SELECT count(*) FROM blank)
  UNION ALL SELECT 'skipped_non_cve_ids', (SELECT count(*) FROM entry_cve c JOIN mx ON mx.scan_id = c.scan_id AND mx.kb_id = c.kb_id WHERE c.cve_id NOT LIKE 'CVE-%')
  UNION ALL SELECT 'missing_kbs_total', (SELECT count(*) FROM mx)
  UNION ALL SELECT 'rows_created', (SELECT count(*) FROM (SELECT DISTINCT scan_id, kb_id, cve_id, month FROM rr) x)
  UNION ALL SELECT 'duplicate_rows_removed', (SELECT count(*) FROM rr) - (SELECT count(*) FROM (SELECT DISTINCT scan_id, kb_id, cve_id, month FROM rr) x))"""

ORACLE["result_rows"] = with_(CANDIDATES) + """
SELECT CAST(left(update_id, 8) AS BIGINT) // 10 AS page_id,
       CAST(row_number() OVER (PARTITION BY CAST(left(update_id, 8) AS BIGINT) // 10 ORDER BY update_id) AS INTEGER) AS candidate_pos,
       update_id, title, 'Windows 11 & later' AS products, 'Security Updates' AS classification, '1/9/2024' AS last_updated,
       'n/a' AS version, '1.0 GB' AS size FROM cand"""

ORACLE["missing_update_candidates"] = with_rec(LINK, RAW, CORR, CANDIDATES) + """, cons AS (
  SELECT n_nationkey AS scan_id, 'windows 1' || CAST(n_nationkey % 2 AS VARCHAR) AS gen,
    CASE n_nationkey % 3 WHEN 0 THEN '22h2' WHEN 1 THEN '23h2' ELSE '24h2' END AS dv,
    CAST(19000 + 10 * (n_nationkey % 4) AS VARCHAR) AS bm,
    CASE n_regionkey WHEN 0 THEN 'x64' WHEN 1 THEN 'arm64' WHEN 2 THEN 'x86' WHEN 3 THEN 'x86' ELSE 'x64' END AS arch FROM nation),
want AS (SELECT m.scan_id, m.kb_id, c.gen, c.dv, c.bm, c.arch FROM missing m JOIN cons c ON c.scan_id = m.scan_id),
ct AS (SELECT update_id, title, lower(title) AS lt, 'KB' || CAST(5000000 + CAST(left(update_id, 8) AS BIGINT) AS VARCHAR) AS kb_id,
       regexp_extract(lower(title), '\\(\\s*(\\d{5})\\.', 1) AS build FROM cand),
sc AS (SELECT w.scan_id, w.kb_id, c.update_id, CASE
    WHEN (w.gen = 'windows 10' AND contains(lt, 'windows 11')) OR (w.gen = 'windows 11' AND contains(lt, 'windows 10')) OR contains(lt, 'server')
      OR (w.arch = 'x64' AND (contains(lt, 'arm64-based') OR contains(lt, 'x86-based') OR contains(lt, '32-bit')))
      OR (w.arch = 'arm64' AND (contains(lt, 'x64-based') OR contains(lt, 'x86-based') OR contains(lt, '32-bit')))
      OR (w.arch = 'x86' AND (contains(lt, 'x64-based') OR contains(lt, 'arm64-based'))) THEN -10000
    ELSE 50 + (CASE WHEN contains(lt, w.gen) THEN 40 ELSE 0 END)
      + (CASE WHEN (w.arch IN ('x64', 'arm64') AND contains(lt, w.arch || '-based')) OR (w.arch = 'x86' AND (contains(lt, 'x86-based') OR contains(lt, '32-bit'))) THEN 25 ELSE 0 END)
      + (CASE WHEN contains(lt, w.dv) THEN 25 ELSE 0 END)
      + (CASE WHEN regexp_matches(lt, '\\b\\d{2}h[12]\\b') AND NOT contains(lt, w.dv) THEN -15 ELSE 0 END)
      + (CASE WHEN build = '' THEN 0 WHEN build = w.bm THEN 10 ELSE -5 END) END AS score
  FROM want w JOIN ct c ON c.kb_id = w.kb_id),
bst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, kb_id ORDER BY score DESC, update_id) AS r,
               count(*) OVER (PARTITION BY scan_id, kb_id) AS n FROM sc WHERE score >= 0) t WHERE r = 1)
SELECT w.scan_id, w.kb_id, CASE WHEN b.score >= 90 THEN b.update_id END AS update_id, CAST(b.score AS DOUBLE) AS best_score,
       coalesce(b.n, 0) AS candidates_matching,
       CASE WHEN b.score IS NULL THEN 'No candidate matched baseline constraints'
            WHEN b.score < 90 THEN 'Ambiguous match below confidence threshold (' || CAST(b.score AS VARCHAR) || ')' END AS reason
FROM want w LEFT JOIN bst b ON b.scan_id = w.scan_id AND b.kb_id = w.kb_id"""

ORACLE["months_with_entries_batch"] = with_(LINK, HOSTS) + """, w AS (
  SELECT scan_id, CAST(date_trunc('month', least(lcu, latest)) AS DATE) AS s, CAST(date_trunc('month', latest) AS DATE) AS e
  FROM h WHERE scan_id % 7 <> 3 AND lcu IS NOT NULL),
m AS (SELECT scan_id, unnest(generate_series(s, e, INTERVAL 1 MONTH)) AS m FROM w),
req AS (SELECT scan_id, strftime(m, '%Y-%b') AS month, row_number() OVER (PARTITION BY scan_id ORDER BY m) AS pos FROM m),
req48 AS (SELECT scan_id, month, (pos - 1) // 3 AS b FROM req WHERE pos <= 48),
hit AS (SELECT DISTINCT r.scan_id, r.b FROM req48 r JOIN (SELECT DISTINCT scan_id, month FROM link) l ON l.scan_id = r.scan_id AND l.month = r.month)
SELECT r.scan_id, string_agg(r.month, ', ' ORDER BY r.month) AS months_with_entries
FROM req48 r JOIN hit ON hit.scan_id = r.scan_id AND hit.b = r.b GROUP BY r.scan_id"""

_FILLED = """, med AS (SELECT quantile_cont(patch_age_days, 0.5) AS age, quantile_cont(cvss_score, 0.5) AS score,
  quantile_cont(CASE WHEN contains(exploitation, 'Exploited:Yes') THEN 1.0 ELSE 0.0 END, 0.5) AS flag FROM validated),
fil AS (SELECT coalesce(patch_age_days, age) AS a, coalesce(cvss_score, score) AS s,
  CASE WHEN contains(exploitation, 'Exploited:Yes') THEN 1.0 ELSE 0.0 END AS f FROM validated, med)"""
ORACLE["ml_scaling"] = TRAINING + _FILLED + """
SELECT 'cvss_score' AS feature, round((SELECT score FROM med), 6) AS median, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS deviation FROM fil
UNION ALL SELECT 'patch_age_days', round((SELECT age FROM med), 6), round(avg(a), 6), round(stddev_pop(a), 6) FROM fil
UNION ALL SELECT 'exploited_flag', round((SELECT CAST(flag AS DOUBLE) FROM med), 6), round(avg(f), 6), round(stddev_pop(f), 6) FROM fil"""
ORACLE["ml_split_sizes"] = TRAINING + """
SELECT priority_label, CAST(n - ceil(n * 20 / 100.0) AS BIGINT) AS train_rows, CAST(ceil(n * 20 / 100.0) AS BIGINT) AS test_rows
FROM (SELECT priority_label, count(*) AS n FROM validated GROUP BY priority_label) t"""
_CATEGORIES = ("severity", "attack_vector", "attack_complexity", "privileges_required", "user_interaction", "scope",
               "confidentiality_impact", "integrity_impact", "availability_impact")
ORACLE["ml_total_sum_of_squares"] = TRAINING + ", cat AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS c, {c} AS v, count(*) AS n FROM validated WHERE {c} IS NOT NULL GROUP BY {c}" for c in _CATEGORIES) + """),
total AS (SELECT count(*) AS n, count(DISTINCT cvss_score) AS d1, count(DISTINCT patch_age_days) AS d2, count(DISTINCT exploitation) AS d3 FROM validated)
SELECT round((SELECT sum(cat.n - CAST(cat.n AS DOUBLE) * cat.n / total.n) FROM cat, total)
             + (SELECT n * ((CASE WHEN d1 > 1 THEN 1 ELSE 0 END) + (CASE WHEN d2 > 1 THEN 1 ELSE 0 END) + (CASE WHEN d3 > 1 THEN 1 ELSE 0 END)) FROM total), 3) AS wcss"""


# ---------------------------------------------------------------- advisory store, run log, sketches

ORACLE["window_advisories"] = with_(LINK, HOSTS) + """, w AS (
  SELECT scan_id, CAST(date_trunc('month', least(lcu, latest)) AS DATE) AS s, CAST(date_trunc('month', latest) AS DATE) AS e
  FROM h WHERE scan_id % 7 <> 3 AND lcu IS NOT NULL),
win AS (SELECT scan_id, s, least(e, CAST(s + INTERVAL 47 MONTH AS DATE)) AS e FROM w),
o AS (SELECT o_orderkey, o_orderkey // 8 AS bucket, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, o_orderpriority,
             CAST(floor(o_totalprice) AS BIGINT) % 101 AS tenths,
             CASE WHEN date_trunc('month', o_orderdate) >= DATE '1994-01-01' AND o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS load FROM orders),
best AS (SELECT win.scan_id, o.*, row_number() OVER (PARTITION BY win.scan_id, o.bucket ORDER BY o.m DESC, o.load DESC, o.o_orderkey DESC) AS r
         FROM win JOIN o ON o.m BETWEEN win.s AND win.e)
SELECT scan_id, count(*) AS cves, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS exploited, CAST(sum(tenths) AS BIGINT) AS score_tenths
FROM best WHERE r = 1 GROUP BY scan_id"""

ORACLE["run_status"] = ("SELECT 'flatten' AS stage, 'succeeded' AS status, 1 AS attempts, metric, CAST(value AS DOUBLE) AS value FROM (" + ORACLE["flatten_counters"]
                        + ") a UNION ALL SELECT 'enrich', 'succeeded', 2, metric, CAST(value AS DOUBLE) FROM (" + ORACLE["enrich_counters"]
                        + ") b UNION ALL SELECT 'report', 'missing', 0, NULL, NULL")

ORACLE["scope_estimates"] = with_(LINK, RAW) + """, own AS (SELECT DISTINCT scan_id, kb_id, cve_id, month FROM raw)
SELECT month, count(*) AS rows, count(DISTINCT kb_id) AS unique_kbs, count(DISTINCT cve_id) AS unique_cves, true AS kb_id_near, true AS cve_id_near
FROM own GROUP BY month
UNION ALL SELECT 'all', count(*), count(DISTINCT kb_id), count(DISTINCT cve_id), true, true FROM own"""


# ---------------------------------------------------------------- fixed predictions, saved rankings, download dialogs

_FIXED = """{name} AS (SELECT *, CAST(split_part(cve_id, '-', -1) AS BIGINT) % 5 AS cluster,
  CASE CAST(split_part(cve_id, '-', -1) AS BIGINT) % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS mlp FROM {source})"""
_FIXED_RANK = FLEET + ", " + _FIXED.format(name="fx", source="rt_valid") + """,
modal AS (SELECT scan_id, kb_id, cluster FROM (SELECT scan_id, kb_id, cluster, row_number() OVER (PARTITION BY scan_id, kb_id ORDER BY count(*) DESC, cluster) AS r
  FROM fx GROUP BY scan_id, kb_id, cluster) t WHERE r = 1),
top_ml AS (SELECT scan_id, kb_id, max(cvss_score) AS ml_risk, max(mlp) AS p FROM fx GROUP BY scan_id, kb_id)
"""
_PRIORITY = "CASE {p} WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' ELSE 'Unknown' END"
ORACLE["fixed_model_ranking"] = _FIXED_RANK + f"""
SELECT r.scan_id, r.rank, r.kb_id, r.policy_risk, t.ml_risk, {_PRIORITY.format(p='t.p')} AS ml_priority, CAST(m.cluster AS INTEGER) AS cluster
FROM rt_ranked r JOIN top_ml t ON t.scan_id = r.scan_id AND t.kb_id = r.kb_id JOIN modal m ON m.scan_id = r.scan_id AND m.kb_id = r.kb_id"""
ORACLE["fixed_model_summary"] = _FIXED_RANK + f"""
SELECT scan_id, count(*) AS kb_count, max(ml_risk) AS highest_ml_risk, {_PRIORITY.format(p='max(p)')} AS highest_ml_priority FROM top_ml GROUP BY scan_id"""
ORACLE["fixed_cluster_profile"] = TRAINING + ", " + _FIXED.format(name="fx", source="validated") + """
SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS size, round(avg(risk_score), 2) AS mean_risk FROM fx GROUP BY cluster"""
ORACLE["fixed_cluster_scatter"] = TRAINING + ", " + _FIXED.format(name="fx", source="validated") + """
SELECT round(cvss_score) AS cvss_bin, round(risk_score) AS risk_bin, CAST(cluster AS INTEGER) AS cluster, count(*) AS rows FROM fx GROUP BY ALL"""
ORACLE["saved_ranking"] = FLEET + """
SELECT r.scan_id, r.rank, r.kb_id, r.policy_risk, r.cve_count, count(*) AS cve_rows, max(v.policy_risk) AS highest_cve_risk
FROM rt_ranked r JOIN rt_valid v ON v.scan_id = r.scan_id AND v.kb_id = r.kb_id GROUP BY ALL"""
ORACLE["download_urls"] = """
SELECT p_partkey AS page_id, 0 AS pos, 'https://dl.example.org/d/kb' || (5000000 + p_partkey) || '-x64.msu?part=' || p_partkey AS url,
       'kb' || (5000000 + p_partkey) || '-x64.msu' AS file_name FROM part
UNION ALL SELECT p_partkey, 1, 'HTTP://dl.example.org/c/KB' || (5000000 + p_partkey) || '.CAB', 'KB' || (5000000 + p_partkey) || '.CAB' FROM part WHERE p_partkey % 3 = 0"""

ORACLE["saved_report"] = "SELECT scan_id, line FROM (" + ORACLE["report_lines"] + ") r"
ORACLE["feature_profiles"] = TRAINING + """
SELECT cvss_score, severity, patch_age_days, attack_vector, attack_complexity, privileges_required, user_interaction, scope,
       confidentiality_impact, integrity_impact, availability_impact, count(*) AS rows FROM validated GROUP BY ALL"""
