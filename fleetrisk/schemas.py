"""Explicit schemas: scan documents, stage tables, ranking output.

One superset schema per document type, every field nullable, so scan files of
different vintages read into one DataFrame without inference.
"""

from pyspark.sql import types as T

S = T.StringType()

BASELINE = T.StructType([
    T.StructField(name, S) for name in (
        "OsName", "OsEdition", "DisplayVersion", "Build", "Architecture")
] + [T.StructField("IsAdmin", T.BooleanType())] + [
    T.StructField(name, S) for name in (
        "LcuMonthId", "LcuPackageName", "LcuInstallTime", "MsrcLatestMonthId",
        "ResolvedProductMonthId", "ProductNameHint")
])

KB_ENTRY = T.StructType([
    T.StructField("KB", S),
    T.StructField("Months", T.ArrayType(S)),
    T.StructField("Cves", T.ArrayType(S)),
    T.StructField("Supersedes", T.ArrayType(S)),
    T.StructField("UpdateType", S),
])

SCAN = T.StructType([
    T.StructField("Baseline", BASELINE),
    T.StructField("InstalledKbs", T.ArrayType(S)),
    T.StructField("MonthsRequested", T.ArrayType(S)),
    T.StructField("MonthsWithEntries", T.ArrayType(S)),
    T.StructField("RawKbEntriesReturned", T.LongType()),
    T.StructField("KbEntries", T.ArrayType(KB_ENTRY)),
    T.StructField("MissingKbs", T.ArrayType(S)),
    T.StructField("MissingBreakdown", T.StructType([
        T.StructField("Superseding", T.LongType()),
        T.StructField("Standalone", T.LongType()),
    ])),
    T.StructField("_corrupt_record", S),
])

# kb_entry table: one row per (scan, KB) after exploding KbEntries
KB_ENTRY_TABLE = T.StructType([
    T.StructField("scan_id", S),
    T.StructField("kb_id", S),
    T.StructField("months", T.ArrayType(S)),
    T.StructField("cves", T.ArrayType(S)),
    T.StructField("supersedes", T.ArrayType(S)),
    T.StructField("update_type", S),
])

CVE_META = T.StructType([
    T.StructField("cve_id", S),
    T.StructField("severity", S),
    T.StructField("base_score", T.DoubleType()),
    T.StructField("vector", S),
    T.StructField("published_date", S),
    T.StructField("exploitation", S),
])

CVSS_METRICS = (
    "attack_vector", "attack_complexity", "privileges_required", "user_interaction",
    "scope", "confidentiality_impact", "integrity_impact", "availability_impact",
)

RANKED_CVE = T.StructType([
    T.StructField("cve_id", S),
    T.StructField("policy_risk", T.DoubleType()),
    T.StructField("ml_risk", T.DoubleType()),
    T.StructField("policy_priority", S),
    T.StructField("ml_priority", S),
    T.StructField("cluster", T.IntegerType()),
    T.StructField("top_driver", S),
    T.StructField("drivers", S),
])

RANKING = T.StructType([
    T.StructField("scan_id", S),
    T.StructField("rank", T.IntegerType()),
    T.StructField("kb_id", S),
    T.StructField("policy_risk", T.DoubleType()),
    T.StructField("ml_risk", T.DoubleType()),
    T.StructField("policy_priority", S),
    T.StructField("ml_priority", S),
    T.StructField("cluster", T.IntegerType()),
    T.StructField("cve_count", T.LongType()),
    T.StructField("top_driver", S),
    T.StructField("review_reason", S),
    T.StructField("cves", T.ArrayType(RANKED_CVE)),
])

# advisory documents (landed vendor feed), one row per month document
ADVISORY = T.StructType([
    T.StructField("month", S),
    T.StructField("Vulnerability", T.ArrayType(T.StructType([
        T.StructField("CVE", S),
        T.StructField("CVSSScoreSets", T.ArrayType(T.StructType([
            T.StructField("BaseScore", T.DoubleType()),
            T.StructField("Vector", S),
        ]))),
        T.StructField("Threats", T.ArrayType(T.StructType([
            T.StructField("Type", T.IntegerType()),
            T.StructField("Description", T.StructType([T.StructField("Value", S)])),
        ]))),
        T.StructField("RevisionHistory", T.ArrayType(T.StructType([
            T.StructField("Date", S),
        ]))),
    ]))),
])
